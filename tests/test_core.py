"""The small fixtures of the operators, with literal results."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinweave.functions.ids import is_and, is_basic, is_or, is_recurrent
from kinweave.functions.measures import MEASURES, measure
from kinweave.functions.special import beta_quantile_values, digamma, trigamma
from kinweave.operators import clustering, concepts, contexts, counts, graph, predict, stats
from kinweave.operators.clustering import Parameters
from kinweave.operators.components import connected_components
from kinweave.operators.concepts import atom, both, either, minimal_cnf
from kinweave.operators.graph import EdgeData
from kinweave.operators.numbering import gapless
from pyspark.sql import functions as F

D = [[0, 1, 2], [0, 3, 4], [3, 4, 5]]
R = [[0, 1, 2, 1, 1], [0, 3, 4, 1, 1], [3, 4, 5, 5, 1, 1]]


def ctx(spark, rows):
    return spark.createDataFrame([(i, c) for i, r in enumerate(rows) for c in r], "context_id long, concept_id long")


def tuples(df, *cols):
    return {tuple(r) for r in (df.select(*cols) if cols else df).collect()}


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, weight double")


def groups(df):
    out = {}
    for c, k in tuples(df, "concept_id", "cluster_id"):
        out.setdefault(k, set()).add(c)
    return sorted(map(sorted, out.values()))


def test_contexts_round_trip(spark):
    back = {r.context_id: r.concepts for r in contexts.collected(ctx(spark, D)).collect()}
    assert back == dict(enumerate(D))


def test_marginals(spark):
    assert tuples(counts.concept_counts(ctx(spark, D))) == {(0, 2), (1, 1), (2, 1), (3, 2), (4, 2), (5, 1)}
    assert tuples(counts.concept_counts(ctx(spark, D), 2)) == {(0, 2), (3, 2), (4, 2)}
    assert tuples(counts.existence_counts(ctx(spark, R))) >= {(1, 3), (5, 1)}


PAIRS = {(0, 1, 1, 2, 1), (0, 2, 1, 2, 1), (1, 2, 1, 1, 1), (0, 3, 1, 2, 2), (0, 4, 1, 2, 2), (3, 4, 2, 2, 2), (3, 5, 1, 2, 1), (4, 5, 1, 2, 1)}


def test_pairs(spark):
    d = ctx(spark, D)
    assert tuples(counts.pair_counts(d)) == PAIRS
    assert tuples(counts.pair_counts(d.limit(0), added=d)) == PAIRS
    assert tuples(counts.coexistence_counts(ctx(spark, [[0, 1, 2, 1, 1], [0, 3, 4], [3, 4, 5]]))) == PAIRS
    assert counts.coexistence_counts(d, added=ctx(spark, [[10, 11], [12, 13], [14, 1]])).count() == 21


def test_pairs_from_context_counts(spark):
    n = {0: 1, 1: 4, 2: 2, 3: 1, 4: 5}
    make = lambda rows: spark.createDataFrame([(c, x, n[x]) for c, xs in rows.items() for x in xs], "concept_id long, context_id long, context_count long")
    a, b = make({0: [0, 1, 4], 1: [0]}), make({2: [3], 3: [1, 2, 3, 4], 4: [1, 4]})
    want = {(0, 3, 9, 9, 11), (0, 4, 9, 9, 9), (3, 4, 9, 11, 9)}
    assert tuples(counts.pair_counts_from_contexts(a, 2, added=b)) == want
    assert tuples(counts.pair_counts_from_contexts(a.unionByName(b), 2)) == want


def test_recurrences(spark):
    r = ctx(spark, R)
    assert tuples(counts.recurrence_counts(r)) == {(1, 2, 2, 3), (1, 3, 1, 3), (5, 2, 1, 1)}
    assert tuples(concepts.find_recurrent(r)) == {(1, 2), (5, 2), (1, 3)}
    rec = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 5, 2)], "rec_id long, concept_id long, n long")
    assert tuples(concepts.activate_recurrent(r, rec), "context_id", "concept_id") == {(2, 10), (0, 10), (1, 10), (0, 11), (2, 12)}


def parents(spark, groups):
    return spark.createDataFrame([(c, p) for p, cs in groups.items() for c in cs], "child_id long, parent_id long")


def test_activation(spark):
    d, ors, ands = ctx(spark, D), parents(spark, {10: [1, 2], 11: [4, 6], 12: [6, 7]}), parents(spark, {13: [1, 2], 14: [4, 6], 15: [6, 7]})
    assert tuples(concepts.activate_or(d, ors), "context_id", "concept_id") == {(0, 10), (2, 11), (1, 11)}
    assert tuples(concepts.activate_and(d, ands), "context_id", "concept_id") == {(0, 13)}
    assert tuples(concepts.activate_and(d, ands, unique=True), "context_id", "concept_id") == {(0, 13)}
    assert tuples(concepts.activate_all(d, ands, ors), "context_id", "concept_id") == tuples(d) | {(0, 10), (2, 11), (1, 11), (0, 13)}


def counted(spark, rows):
    return spark.createDataFrame([(c, x, n) for c, xs in rows.items() for x, n in xs], "concept_id long, context_id long, context_count long")


def test_activation_from_counts(spark):
    ors = spark.createDataFrame([(0, 3), (0, 4), (1, 3), (2, 5)], "child_id long, parent_id long")
    got = tuples(concepts.activate_or_counts(counted(spark, {0: [(0, 0), (1, 2)], 1: [(0, 0), (2, 3)]}), ors))
    assert got == {(4, 1, 2), (3, 1, 2), (3, 2, 3), (3, 0, 0), (4, 0, 0)}
    rows = counted(spark, {0: [(0, 0), (1, 2)], 1: [(0, 0), (2, 3), (1, 2)], 2: [(3, 2), (1, 2), (4, 3)]})
    ands = parents(spark, {4: [0, 1], 5: [0, 1, 2], 6: [2, 3]})
    assert tuples(concepts.activate_and_counts(rows, ands)) == {(4, 0, 0), (4, 1, 2), (5, 1, 2)}
    assert tuples(concepts.project_and(rows, ands)) == {(1, 2, 3), (2, 3, 2), (2, 4, 3), (4, 0, 0), (4, 1, 2), (5, 1, 2)}
    assert tuples(concepts.project_and(rows, ands, everywhere=True)) == {(4, 0, 0), (4, 1, 2), (5, 1, 2)}
    assert tuples(concepts.project_or(rows, ors.where("parent_id = 5"))) == {(0, 0, 0), (0, 1, 2), (1, 0, 0), (1, 2, 3), (1, 1, 2), (5, 3, 2), (5, 1, 2), (5, 4, 3)}


MEASURED = {
    "existence": (1, 1), "pairwiseCount": (3, 3), "weightedCount": (0.45, 0.45), "overlap": (0.75, 0.75), "sorensenDice": (0.666667, 0.666667), "jaccard": (0.5, 0.5), "condprob": (0.6, 0.75),
    "pwmi": (1.098612, 1.098612), "normpwmi": (0.579095, 0.579095), "mutualinfo": (0.148452, 0.148452),
}
BAYES = {
    ("bpwmi", None): (0.959064, 0.959064), ("bpwmi", 0.6): (0.625137, 0.625137), ("bpwmi", 0.9): (0, 0), ("bmi", None): (0.143591, 0.143591), ("bmi", 0.9): (0.047446, 0.047446),
    ("bcondprob", None): (0.571429, 0.666667), ("bcondprob", 0.9): (0.333194, 0.416110), ("normbpwmi", None): (math.nan, math.nan),
}


def test_measures(spark):
    row = spark.createDataFrame([(3, 5, 4, 20)], "a long, b long, c long, n long")
    cols = [F.col(x) for x in "abcn"]
    for name, want in MEASURED.items():
        got = row.select(*[c.alias(k) for k, c in zip("xy", measure(name)(*cols), strict=True)]).first()
        assert tuple(got) == pytest.approx(want, abs=1e-6), name
    for (name, confidence), want in BAYES.items():
        got = row.select(*[c.alias(k) for k, c in zip("xy", measure(name, 2.0, confidence)(*cols), strict=True)]).first()
        assert tuple(got) == pytest.approx(want, abs=1e-6, nan_ok=True), (name, confidence)
    with pytest.raises(ValueError, match="unknown"):
        measure("nope")
    assert len(MEASURES) == 14


def test_conditional_probabilities(spark):
    got = {(r.src, r.dst): r.weight for r in graph.correlations(counts.pair_counts(ctx(spark, D)), measure("condprob"), 3).collect()}
    want = {(0, 1): (0.5, 1), (0, 2): (0.5, 1), (1, 2): (1, 1), (0, 3): (0.5, 0.5), (0, 4): (0.5, 0.5), (3, 4): (1, 1), (3, 5): (0.5, 1), (4, 5): (0.5, 1)}
    assert got == {k: v for (a, b), (x, y) in want.items() for k, v in (((a, b), x), ((b, a), y))}


def test_special_functions(spark):
    row = spark.createDataFrame([(1.0, 0.5, 100.0, -1.0)], "a double, b double, c double, d double").select(*[digamma(F.col(c)).alias(c) for c in "abcd"], *[trigamma(F.col(c)).alias("t" + c) for c in "ab"]).first()
    assert (row.a, row.b, row.c) == pytest.approx((-0.5772156649015329, -1.9635100260214235, 4.600161852738087), abs=1e-11)
    assert (row.ta, row.tb) == pytest.approx((math.pi**2 / 6, math.pi**2 / 2), abs=1e-10) and row.d is None
    assert beta_quantile_values(np.array([1.0, 2.0]), np.array([1.0, 1.0]), 0.25) == pytest.approx([0.25, 0.5], abs=1e-9)


def test_similarity(spark):
    data = EdgeData.of(edges_of(spark, [(0, 1, 1), (0, 2, 5), (0, 4, 4), (3, 1, 2), (3, 2, 7)]))
    for non_negative in (False, True):
        got = graph.similarities(data, non_negative=non_negative).collect()
        assert [(r.src, r.dst) for r in got] == [(0, 3)] and got[0].weight == pytest.approx(0.631578947368421)
    got = graph.pair_similarities(data, spark.createDataFrame([(3, 0), (0, 1)], "i long, j long")).collect()
    assert [(r.src, r.dst, round(r.weight, 9)) for r in got] == [(0, 3, 0.631578947)]


def test_in_degree(spark):
    e = edges_of(spark, [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 0, 2), (2, 1, 2)])
    data = graph.prune(EdgeData.of(e), max_in=1)
    assert tuples(data.weights, "src", "dst", "weight") == {(2, 0, 2.0), (2, 1, 2.0), (1, 2, 1.0)}
    assert tuples(data.sums) == {(0, 0.0, 1.0), (1, 1.0, 1.0), (2, 4.0, 0.0)}


def figure(spark):
    near = {"a": "bcde", "f": "bcd", "g": "bcde"}
    rows = [(x, y) for x, ys in near.items() for y in ys]
    both_ = [(ord(a), ord(b)) for a, b in rows] + [(ord(b), ord(a)) for a, b in rows]
    deg = {v: sum(a == v for a, _ in both_) for v in {a for a, _ in both_}}
    return edges_of(spark, [(a, b, 1 / deg[a]) for a, b in both_])


def test_figure_one(spark):
    got = {(chr(r.src), chr(r.dst)): r.weight for r in graph.similarities(graph.prune(EdgeData.of(figure(spark)), max_in=100)).collect()}
    want = {"af": 0.75, "ag": 1.0, "bc": 1.0, "bd": 1.0, "cd": 1.0, "be": 2 / 3, "ce": 2 / 3, "de": 2 / 3, "fg": 0.75}
    assert got == {tuple(k): pytest.approx(v) for k, v in want.items()}
    comp = tuples(connected_components(edges_of(spark, [(ord(a), ord(b), w) for (a, b), w in got.items()])))
    assert comp == {(ord(c), ord("a")) for c in "afg"} | {(ord(c), ord("b")) for c in "bcde"}


def test_components(spark):
    e = spark.createDataFrame([(0, 1), (2, 3), (3, 4), (4, 3), (9, 9), (None, 1)], "src long, dst long")
    assert tuples(connected_components(e)) == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 2), (9, 9)}
    assert connected_components(e.limit(0)).count() == 0
    path = spark.range(0, 120).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(path).collect()} == {0}


CLIQUES = [
    ([(0, 1), (0, 4), (1, 2), (1, 4), (1, 5), (1, 6), (2, 3), (2, 5), (2, 6), (5, 6)], [[0, 1, 4], [1, 2, 5, 6], [2, 3]]),
    ([*combinations([1, 2, 3], 2), *combinations([2, 3, 4, 5], 2), *combinations([3, 4, 5, 6, 7], 2)], [[1, 2, 3], [2, 3, 4, 5], [3, 4, 5, 6, 7]]),
    ([*combinations([1, 2, 3, 4], 2), *combinations([3, 4, 5, 6], 2)], [[1, 2, 3, 4], [3, 4, 5, 6]]),
    ([*combinations([1, 2, 3, 4, 5], 2), *combinations([1, 2, 3, 4, 6], 2)], [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6]]),
]


@pytest.mark.parametrize(("links", "want"), CLIQUES)
def test_cliques(spark, links, want):
    e = edges_of(spark, [(a, b, 1) for a, b in links])
    assert groups(clustering.maximal_cliques(e, Parameters(undirected=True))) == want
    assert groups(clustering.local_cliques(e)) == want


def test_simple_clusters(spark):
    rows = [(0, 0), (1, 0), (0, 1), (2, 1), (3, 1), (0, 2), (1, 2)]
    c = spark.createDataFrame(rows, "concept_id long, cluster_id long")
    assert groups(clustering.distinct_clusters(c)) == [[0, 1], [0, 2, 3]]
    e = edges_of(spark, [(0, 1, 5), (1, 2, 3), (2, 3, 4), (3, 0, 1), (4, 4, 9)])
    assert groups(clustering.mutual_max(e, Parameters(undirected=True))) == [[0, 1], [2, 3]]
    assert groups(clustering.edge_clusters(e, Parameters(min_weight=4.0))) == [[0, 1], [2, 3], [4]]
    with pytest.raises(ValueError, match="min_weight"):
        clustering.edge_clusters(e)
    assert clustering.algorithm("unknown") is clustering.slpa and clustering.algorithm("edges") is clustering.edge_clusters


def test_label_clusters_find_two_groups_and_repeat(spark):
    links = [*combinations(range(5), 2), *combinations(range(10, 15), 2), (4, 10)]
    e = edges_of(spark, [(a, b, 0.9 if (a, b) != (4, 10) else 0.1) for a, b in links])
    for run in (clustering.slpa, clustering.label_propagation):
        p = Parameters(undirected=True, iterations=16, capacity=10, saturation=2.0)
        got = groups(run(e, p))
        assert got == groups(run(e, p)) and [0, 1, 2, 3, 4] in got and [10, 11, 12, 13, 14] in got


def test_naive_bayes(spark):
    train = ctx(spark, [[0, 1], [0, 2], [1, 2], [1, 3]])
    classes = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "context_id long, class_id long")
    assert tuples(predict.concept_naive_bayes(train, classes, ctx(spark, [[0, 1], [1, 2], [3]]), 4), "context_id", "class_id") == {(0, 0), (1, 1), (2, 1)}
    v = predict.activation_vectors(train, classes, spark.createDataFrame([(i, i) for i in range(4)], "concept_id long, place int"), 4)
    assert {tuple(r.features.indices) for r in v.collect()} == {(0, 1), (0, 2), (1, 2), (1, 3)}


def test_cnf(spark):
    assert both(*[atom(x) for x in (1, 2)]).cnf() == ((1,), (2,))
    f = either(both(atom(0), atom(1)), both(atom(2), atom(3)))
    assert f.cnf() == ((0, 2), (0, 3), (1, 2), (1, 3))
    assert either(both(atom(0), atom(1)), atom(2), atom(3)).cnf() == ((0, 2, 3), (1, 2, 3))
    row = spark.createDataFrame([([[3, 2, 1], [1, 2], [2, 3], [4], [4, 5], [4]],)], "c array<array<long>>").select(minimal_cnf(F.col("c")).alias("m")).first()
    assert row.m == [[1, 2], [2, 3], [4]]
    a, b = F.array(F.array(F.lit(0)), F.array(F.lit(1))), F.array(F.array(F.lit(2)), F.array(F.lit(3)))
    assert spark.range(1).select(concepts.cnf_or(a, b).alias("m")).first().m == [[0, 2], [0, 3], [1, 2], [1, 3]]


def test_discovery(spark):
    rows = counted(spark, {0: [(10, 5), (11, 7)], 1: [(12, 2), (13, 1)], 2: [(10, 5)], 3: [(11, 7), (13, 1)]})
    for how in ("mutualmax", "slpa"):
        found = concepts.discover_from_counts(rows, concepts.Settings(measure("pwmi"), 15, clustering.algorithm(how), levels=2))
        assert found.counts.count() >= rows.count()
    s = concepts.Settings(measure("condprob"), 15, levels=3)
    found = concepts.discover_projected(rows, s)
    assert found.and_concepts.where(~is_and(F.col("parent_id"))).count() == 0 and found.or_concepts.where(~is_or(F.col("parent_id"))).count() == 0
    assert found.and_concepts.count() >= 2
    indexed = concepts.discover_indexed(ctx(spark, D), concepts.Settings(measure("condprob"), 3, levels=1))
    assert indexed.and_concepts.count() > 0
    formulas, active = concepts.discover_cnf(ctx(spark, D), concepts.Settings(measure("condprob"), 3, levels=1))
    assert formulas.where(is_and(F.col("concept_id"))).count() > 0 and active.count() > 9
    kinds = spark.createDataFrame([(5,), (150_000_000_000,)], "c long").select(is_basic(F.col("c")).alias("b"), is_recurrent(F.col("c")).alias("r")).collect()
    assert [tuple(k) for k in kinds] == [(True, False), (False, True)]
    assert concepts.synthetic_contexts(spark, 50).count() > 50


def test_errors_and_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (5.0, 9.0), (2.0, 5.0)], "p double, t double")
    assert stats.rmse(df, "p", "t").first().rmse == pytest.approx(math.sqrt(6.5))
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], "a double, b double"), "a", "b").first().rho == pytest.approx(1.0)
    noise = F.udf(lambda i: i + random.random() / 2, "double").asNondeterministic()  # as a sum of floats made again is, but more so
    unstable = spark.range(500).select(noise("id").alias("a"), F.col("id").cast("double").alias("b"))
    assert stats.spearman(unstable, "a", "b").first() == (500, pytest.approx(1.0))
    assert [(r.bin, r.n) for r in stats.histogram(df, "t", 4).orderBy("bin").collect()] == [(0, 2), (1, 0), (2, 1), (3, 1)]
    assert stats.histogram(df.limit(0), "t", 4).count() == 0
    e = edges_of(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 2, 1)])
    assert {(r.vertex, r.triangles, round(r.coefficient, 6)) for r in stats.clustering_coefficients(e).collect()} == {(0, 1, 1.0), (1, 1, 1.0), (2, 1, 0.333333)}
    m = stats.graph_measures(e).first()
    assert (m.n_directed, m.n_undirected, m.n_vertices, m.n_components) == (5, 4, 4, 1)


def test_paths_and_prediction(spark):
    e = edges_of(spark, [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.3), (3, 4, 1.0), (3, 5, 0.1), (5, 6, 0.1)])
    got = {(r.target): (round(r.distance, 6), round(r.similarity, 6)) for r in graph.path_similarities(e, spark.createDataFrame([(1,)], "s long"), 1.5).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.1, 0.9), 3: (0.3, 0.72), 5: (1.2, 0.072)}
    paths = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.25), (7, 7, 1.0)], "source long, target long, similarity double")
    hist = spark.createDataFrame([(1, 1, 4.0), (1, 2, 1.0), (2, 9, 3.0)], "user long, item long, rating double")
    val = spark.createDataFrame([(1, 7, 5.0), (2, 7, 5.0), (3, 7, 5.0)], "user long, item long, rating double")
    assert tuples(predict.knn_predict(val, hist, paths, 5), "user", "predicted", "hit") == {(1, 3.0, True), (2, 3.0, False), (3, 0.0, False)}


def test_rating_pairs(spark):
    rows = [(1, 5, 1, "u"), (2, 5, 1, "u"), (3, 5, 2, "u"), (4, 4, 2, "u"), (1, 5, 1, "w")]
    r = spark.createDataFrame(rows, "item long, rating int, day int, user string")
    assert tuples(contexts.same_rating_pairs(r)) == {(1, 2, 1), (2, 1, 1)}
    want = {(a, b) for a, ra, da, u in rows for b, rb, db, v in rows if u == v and a != b and da - 1 <= db <= da and ra <= rb <= ra + 1}
    assert tuples(contexts.near_rating_pairs(r, (1, 0), (0, 1)), "a", "b") == want


def test_ngrams_with_recurrences(spark):
    rows = spark.createDataFrame([(["a", "b"], 3), (["b", "a"], 2), (["a", "a"], 9), (["a", "a", "b"], 4), (["c", "d"], 1)], "tokens array<string>, n long")
    out = contexts.ngrams_to_context_counts(rows, 2)
    names = {r.concept_id: r.label for r in out["concepts"].collect()} | {r.rec_id: (r.concept_id, r.n) for r in out["recurrent"].collect()}
    got = sorted((str(names[r.concept_id]), r.context_count) for r in out["context_counts"].collect())
    a = next(k for k, v in names.items() if v == "a")
    assert got == sorted([("a", 5), ("b", 5), (str((a, 2)), 4), ("b", 4)]) and out["count"].first().n == 9


def test_small_makers(spark):
    seq = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "id long, t array<string>")
    assert [r.g for r in seq.orderBy("id").select(contexts.ngrams(F.col("t"), 2).alias("g")).collect()] == [[["a", "b"], ["b", "c"]], [["x"]], []]
    assert tuples(contexts.window_pairs(seq, "id", "t", 2), "a", "b") == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    assert tuples(contexts.moving_window(ctx(spark, [[7], [8]]), 2)) == {(0, 7), (1, 7), (1, 8), (2, 8)}
    notes = spark.createDataFrame([(1, 0), (1, 40), (1, 100), (2, 5)], "track int, onset int")
    assert tuples(contexts.note_groups(notes), "track", "onset", "group") == {(1, 0, 0), (1, 40, 0), (1, 100, 1), (2, 5, 0)}
    items = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    kinds = spark.createDataFrame([(1, "track"), (2, "album"), (3, "genre")], "item long, kind string")
    assert tuples(contexts.of_type(items, kinds, "track")) == {(1,)}
    tree = spark.createDataFrame([(1, 10, 7)], "track_id long, album_id long, artist_id long")
    assert tuples(contexts.artist_of(items.withColumnRenamed("item", "track_id"), tree)) == {(1, 7), (2, None), (3, None)}
    rated = spark.createDataFrame([(1, 9), (2, 8), (3, 7), (4, 6)], "item long, rating int")
    albums = spark.createDataFrame([(2, 70)], "album_id long, artist_id long")
    assert tuples(contexts.lift_items(rated, tree.select("track_id", "artist_id"), albums, kinds)) == {(7, 9), (70, 8), (3, 7)}
    g = gapless(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], ["id"], "n", 4)
    assert all(sorted(r.n for r in g.where(F.col("k") == k).collect()) == list(range(34 if k == 0 else 33)) for k in range(3))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 9)), min_size=1, max_size=25, unique_by=lambda x: x[:2]), st.integers(1, 4))
def test_pruning_properties(spark, rows, k):
    data = EdgeData.of(edges_of(spark, rows))
    cut = graph.prune(data, max_in=k)
    total = {r.src: r.kept + r.discarded for r in data.sums.collect()}
    assert {r.src: r.kept + r.discarded for r in cut.sums.collect()} == pytest.approx(total)
    exact = {(r.src, r.dst): r.weight for r in graph.similarities(data, None).collect()}
    near = graph.similarities(cut, None, error=True).collect()
    assert all(-1e-9 <= r.weight <= 1 + 1e-9 and -1e-9 <= exact[r.src, r.dst] - r.weight <= 2 * r.error + 1e-9 for r in near)


def test_nothing_is_lost_beyond_old_bounds(spark):
    from kinweave.operators import clustering, concepts
    from kinweave.operators.clustering import Parameters
    from pyspark.sql import functions as F

    eleven = spark.createDataFrame([(a, b, 1.0) for a in range(11) for b in range(a)], "src long, dst long, weight double")
    found = clustering.as_text(clustering.maximal_cliques(eleven, Parameters(undirected=True))).collect()
    assert [r.text for r in found] == [" ".join(map(str, range(11)))]
    with pytest.raises(ValueError):
        clustering.maximal_cliques(eleven, Parameters(undirected=True, max_clique=10))
    clauses = spark.range(100).select(F.lit(1).alias("key"), F.array(F.array("id")).alias("cnf"))
    assert concepts.folded_cnf(clauses, "key", "cnf", "and").select(F.size("cnf").alias("n")).first().n == 100
