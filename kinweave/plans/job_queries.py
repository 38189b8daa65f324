"""Registered queries over jobs and over operators that the tables' own queries don't reach, with SQL beside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import clustering, concepts, contexts, graph, predict, stats
from kinweave.operators.clustering import Parameters
from kinweave.plans import experiments, pipelines
from kinweave.plans.file_queries import _brand_names, _file, _lines
from kinweave.plans.queries import _BRANDS, _EDGES, _GROUPS, _KNN, _PAIRS, _PP, _RATE, _TOP, _TYPES, _baskets, _bigrams, _edges, _groups, _n_orders, _part_graph, _pruned, _query, _r, _ratings, _stars, _supplies, _table
from kinweave.runtime import new_folder

from kinweave.sources.workspace import Workspace

# Jobs

_WORDS = "l AS (SELECT p_partkey AS k, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS t FROM part)"


def _text(spark, sf) -> str:
    """A file of a line a part: its name, its type, its name again."""
    rows = _table(spark, sf, "part").repartition(1).sortWithinPartitions("p_partkey")  # one file, so that lines have an order
    return _file(_lines(rows, F.col("p_name"), F.col("p_type"), F.col("p_name"), sep=" "), "text")


@_query(f"WITH {_WORDS}, w AS (SELECT DISTINCT k, unnest(t) AS c FROM l), r AS (SELECT c, m, count(*) AS n FROM (SELECT k, c, count(*) AS m FROM (SELECT k, unnest(t) AS c FROM l) GROUP BY 1, 2) WHERE m > 1 GROUP BY 1, 2) SELECT c AS concept, count(*) AS n_contexts FROM w GROUP BY 1 UNION ALL SELECT c || '^' || r.m, sum(x.n)::BIGINT FROM r JOIN r x USING (c) WHERE x.m >= r.m GROUP BY c, r.m")
def job_text_to_contexts(spark, sf):
    """The vocabulary, the contexts and the recurrent concepts that the job stores, as counts by name."""
    ws = pipelines.textfile_to_contexts(Workspace(spark, new_folder(spark, "ws")), _text(spark, sf), recurrent_min=1)
    names = ws["concepts"].unionByName(ws["recurrent-concepts"].join(ws["concepts"], "concept_id").select(F.col("rec_id").alias("concept_id"), F.concat_ws("^", "label", F.col("n").cast("string")).alias("label")))
    return ws["contexts"].join(names, "concept_id").groupBy(F.col("label").alias("concept")).agg(F.count(F.lit(1)).alias("n_contexts"))


@_query(f"WITH {_WORDS}, x AS (SELECT k + d AS k, t FROM l, (SELECT unnest([0, 1, 2]) AS d)), w AS (SELECT DISTINCT k, unnest(t) AS c FROM x) SELECT c AS concept, count(*) AS n_contexts FROM w WHERE c IN (SELECT c FROM (SELECT unnest(t) AS c FROM l) GROUP BY c HAVING count(*) >= 300) GROUP BY 1")
def job_text_to_windows(spark, sf):
    """The same with windows of three lines and a least count for words."""
    ws = pipelines.textfile_to_contexts(Workspace(spark, new_folder(spark, "ws")), _text(spark, sf), min_count=300, window=3)
    return ws["contexts"].join(ws["concepts"], "concept_id").groupBy(F.col("label").alias("concept")).agg(F.count(F.lit(1)).alias("n_contexts"))


@_query(f"WITH {_WORDS}, s AS (SELECT list_sort(list_distinct(t)) AS s FROM l) SELECT array_to_string(s, ',') AS concepts, count(*) AS context_count FROM s WHERE len(s) > 1 GROUP BY s")
def job_text_to_unique_contexts(spark, sf):
    ws = pipelines.textfile_to_contexts(Workspace(spark, new_folder(spark, "ws")), _text(spark, sf), unique=True)
    rows = ws["context-counts"].join(ws["concepts"], "concept_id").groupBy("context_id", "context_count")
    return rows.agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("concepts")).select("concepts", "context_count")


_JOB_GRAMS = f"""WITH {_WORDS}, y AS (SELECT list_transform(t, lambda x: lower(x)) AS t FROM l), g AS (SELECT unnest(list_transform(generate_series(1, len(t) - 2), lambda i: list_sort(t[i:i + 2]))) AS g FROM y),
    h AS (SELECT g, count(*) AS n FROM g WHERE len(list_distinct(g)) > 1 GROUP BY g HAVING count(*) >= 2),
    u AS (SELECT n, unnest(list_distinct(g)) AS w, g FROM h) SELECT CASE WHEN len(list_filter(g, lambda y: y = w)) > 1 THEN w || '^' || len(list_filter(g, lambda y: y = w)) ELSE w END AS concept, sum(n)::BIGINT AS n, count(*) AS n_contexts FROM u GROUP BY 1"""


def _counted(ws: Workspace) -> DataFrame:
    names = ws["concepts"].unionByName(ws["recurrent-concepts"].join(ws["concepts"], "concept_id").select(F.col("rec_id").alias("concept_id"), F.concat_ws("^", "label", F.col("n").cast("string")).alias("label")))
    return ws["context-counts"].join(names, "concept_id").groupBy(F.col("label").alias("concept")).agg(F.sum("context_count").alias("n"), F.count(F.lit(1)).alias("n_contexts"))


@_query(_JOB_GRAMS)
def job_text_to_context_counts(spark, sf):
    return _counted(pipelines.textfile_to_context_counts(Workspace(spark, new_folder(spark, "ws")), _text(spark, sf), 3, 2))


@_query(_JOB_GRAMS)
def job_ngrams_to_context_counts(spark, sf):
    """From the n-gram file that the job before leaves beside its workspace."""
    path = new_folder(spark, "ws")
    pipelines.textfile_to_context_counts(Workspace(spark, path), _text(spark, sf), 3, 2)
    return _counted(pipelines.ngramfile_to_context_counts(Workspace(spark, new_folder(spark, "ws")), f"{path}/3-grams", 2))


def _workspace(spark, sf) -> Workspace:
    """Orders as contexts of brands by number."""
    numbers = _baskets(spark, sf).select("context_id", F.regexp_extract("concept_id", "([0-9]+)", 1).cast("long").alias("concept_id"))
    labels = _brand_names(spark, sf).select(F.regexp_extract("concept_id", "([0-9]+)", 1).cast("long").alias("concept_id"), "label")
    return Workspace(spark, new_folder(spark, "ws")).write(contexts=numbers, concepts=labels, count=_n_orders(spark, sf))


_NUM = _TOP.replace("SELECT l_orderkey AS x, p_brand AS c FROM", "SELECT l_orderkey AS x, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS c FROM")
_NUM_EDGES = _EDGES.replace("SELECT l_orderkey AS x, p_brand AS c FROM", "SELECT l_orderkey AS x, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS c FROM")
_SETTINGS = pipelines.GraphSettings("condprob", max_in=10)


@_query(f"WITH {_NUM} SELECT 'correlations' AS kind, src, dst, round(w, 6) AS weight FROM e UNION ALL SELECT 'similarities', i, j, round(s, 6) FROM sim WHERE s > 0")
def job_contexts_to_graphs(spark, sf):
    ws = pipelines.contexts_to_graphs(_workspace(spark, sf), _SETTINGS)
    one = lambda name: ws[name].select(F.lit(name).alias("kind"), "src", "dst", _r("weight"))
    return one("correlations").unionByName(one("similarities"))


@_query(f"WITH {_NUM} SELECT round(s, 6) AS weight, i AS src, j AS dst FROM sim WHERE s > 0.2")
def job_similarities_of_stored_graph(spark, sf):
    """Correlations are stored first and used by a second call, with a least similarity."""
    ws = pipelines.contexts_to_graphs(_workspace(spark, sf), _SETTINGS, "correlations")
    ws = pipelines.contexts_to_graphs(ws, pipelines.GraphSettings("condprob", max_in=10, min_similarity=0.2), "similarities")
    return ws["similarities"].select(_r("weight"), "src", "dst")


@_query(f"WITH {_NUM} SELECT 'correlation' AS kind, least(src, dst) || ' ' || greatest(src, dst) AS members FROM e WHERE w >= 0.16 GROUP BY 2 UNION ALL SELECT 'similarity', i || ' ' || j FROM sim WHERE s >= 0.2")
def job_cluster_vertices(spark, sf):
    ws = pipelines.contexts_to_graphs(_workspace(spark, sf), _SETTINGS)
    ws = pipelines.cluster_vertices(ws, "edges", min_correlation=0.16, min_similarity=0.2)
    one = lambda kind: clustering.as_text(ws[f"{kind}-clusters"]).select(F.lit(kind).alias("kind"), F.col("text").alias("members"))
    return one("correlation").unionByName(one("similarity"))


_NUM_MUTUAL = f"WITH {_NUM_EDGES}, b2 AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM e) WHERE r = 1), mm AS (SELECT x.src AS a, x.dst AS b FROM b2 x JOIN b2 y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst)"


@_query(f"{_NUM_MUTUAL} SELECT 'brand#' || a AS a, 'brand#' || b AS b FROM mm")
def job_export_concepts(spark, sf):
    """The text of correlation clusters that the export job writes."""
    ws = pipelines.cluster_vertices(pipelines.contexts_to_graphs(_workspace(spark, sf), _SETTINGS, "correlations"), "mutualmax")
    path = next(p for p in pipelines.export(ws, "concepts") if p.endswith("correlation-clusters-text"))
    pair = F.array_sort(F.split(F.split("value", ": ")[1], " "))
    number = lambda x: F.regexp_extract(x, "([0-9]+)", 1).cast("long")
    rows = spark.read.text(path).select(pair[0].alias("x"), pair[1].alias("y"))
    return rows.select(F.when(number("x") < number("y"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(number("x") < number("y"), F.col("y")).otherwise(F.col("x")).alias("b"))


@_query(f"WITH {_NUM} SELECT 'correlations' AS kind, count(*) AS n_edges, round(avg(w), 6) AS weight_mean FROM e UNION ALL SELECT 'similarities', count(*), round(avg(s), 6) FROM sim WHERE s > 0")
def job_statistics(spark, sf):
    found = pipelines.statistics(pipelines.contexts_to_graphs(_workspace(spark, sf), _SETTINGS))
    one = lambda name: found[name].select(F.lit(name).alias("kind"), "n_edges", _r("weight_mean"))
    return one("correlations").unionByName(one("similarities"))


_CONDITIONAL = f"{_TYPES}, w AS (SELECT w, sum(n) / any_value(2 * t.t) AS f FROM (SELECT a AS w, n FROM b UNION ALL SELECT b, n FROM b), t GROUP BY w), e AS (SELECT a AS src, b AS dst, n / sum(n) OVER (PARTITION BY a) AS w FROM b)"
_RANGED = f"""{_CONDITIONAL}, ok AS (SELECT w FROM w WHERE f BETWEEN 0.0195 AND 0.5), own AS (SELECT * FROM e WHERE src IN (SELECT w FROM ok)),
    cut AS (SELECT * FROM own WHERE dst IN (SELECT w FROM ok) AND w BETWEEN 0.15 AND 0.9)"""


@_query(f"WITH {_RANGED} SELECT src, dst, round(w, 6) AS weight FROM cut")
def range_pruned(spark, sf):
    vertices, edges = graph.bigram_graph(_bigrams(spark, sf))
    data = graph.range_pruned(vertices.withColumnRenamed("label", "id"), edges, (0.0195, 0.5), (0.15, 0.9))
    return data.weights.select("src", "dst", _r("weight"))


@_query(f"WITH {_RANGED}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY abs(w) DESC, src) AS r FROM cut) WHERE r <= 3), g AS (SELECT src, sum(w) AS g FROM k GROUP BY 1) SELECT own.src, round(coalesce(any_value(g), 0), 6) AS kept, round(sum(w) - coalesce(any_value(g), 0), 6) AS discarded FROM own LEFT JOIN g USING (src) GROUP BY own.src")
def range_pruned_top_sums(spark, sf):
    vertices, edges = graph.bigram_graph(_bigrams(spark, sf))
    data = graph.range_pruned(vertices.withColumnRenamed("label", "id"), edges, (0.0195, 0.5), (0.15, 0.9), max_in=3)
    return data.sums.select("src", _r("kept"), _r("discarded"))


@_query(f"WITH {_TYPES} SELECT b AS src, a AS dst, round(n / sum(n) OVER (PARTITION BY b), 6) AS weight FROM b")
def bigram_conditional_backward(spark, sf):
    return graph.bigram_graph(_bigrams(spark, sf), "backward")[1].select("src", "dst", _r("weight"))


@_query(f"""WITH {_CONDITIONAL}, tot AS (SELECT src, sum(w) AS t FROM e GROUP BY 1), v AS (SELECT x.src AS i, z.src AS j, sum(abs(x.w - z.w) - x.w - z.w) AS v FROM e x JOIN e z ON x.dst = z.dst AND x.src < z.src GROUP BY 1, 2),
    s AS (SELECT i, j, -v / (ti.t + tj.t) AS s FROM v JOIN tot ti ON ti.src = i JOIN tot tj ON tj.src = j) SELECT i AS src, j AS dst, round(s, 6) AS weight FROM s""")
def job_bigram_similarities(spark, sf):
    return pipelines.bigram_similarities(_bigrams(spark, sf), max_in=None).select("src", "dst", _r("weight"))


@_query("WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS t FROM part WHERE p_size % 2 = 0), s AS (SELECT id, unnest(generate_series(1, len(t) - 1)) AS p, t FROM w), x AS (SELECT DISTINCT id, t[p] AS a, t[p + 1] AS b FROM s) SELECT a, b, count(*) AS n FROM (SELECT id, a, b FROM x UNION SELECT id, b, a FROM x) GROUP BY 1, 2")
def job_tweets_to_bigrams(spark, sf):
    mark = F.when(F.col("p_size") % 2 == 0, "Text: ").otherwise("Time: ")
    return pipelines.tweets_to_bigrams(spark, _file(_lines(_table(spark, sf, "part"), mark, F.col("p_name")), "tweets"))


@_query(f"WITH {_TOP}, wp AS (SELECT DISTINCT p_brand AS a, 'Brand#' || ((substr(p_brand, 7)::INT * 7) % 25 + 1) AS b, substr(p_brand, 7)::INT::DOUBLE AS score FROM part), ws AS (SELECT wp.*, sim.s FROM wp LEFT JOIN sim ON least(a, b) = i AND greatest(a, b) = j), kk AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS x, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS y FROM ws WHERE s IS NOT NULL) SELECT (SELECT count(*) FROM ws) AS n_pairs, (SELECT count(*) FROM ws WHERE s IS NULL) AS n_without, count(*) AS n, round(corr(x, y), 6) AS rho FROM kk")
def job_word_pair_benchmark(spark, sf):
    number = F.substring("p_brand", 7, 9).cast("int")
    pairs = _table(spark, sf, "part").select(F.col("p_brand").alias("a"), F.concat(F.lit("Brand#"), ((number * 7) % 25 + 1).cast("string")).alias("b"), number.cast("double").alias("score")).distinct()
    sims = graph.similarities(_pruned(spark, sf), None)
    labels = _brand_names(spark, sf).select("concept_id", F.col("concept_id").alias("label"))
    scored, rho = pipelines.word_pair_benchmark(pairs, sims, labels)
    both = scored.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("weight").isNull()).alias("n_without"))
    return both.crossJoin(rho).select("n_pairs", "n_without", "n", _r("rho"))  # one row each


# Sweeps


def _sweep_sql(k: int) -> str:
    return f"SELECT {k} AS max_in, (SELECT count(*) FROM e{k}) AS n_directed, (SELECT count(DISTINCT (least(src, dst), greatest(src, dst))) FROM e{k}) AS n_undirected, (SELECT count(*) FROM (SELECT src FROM e{k} UNION SELECT dst FROM e{k})) AS n_vertices"


@_query(f"WITH {_EDGES}, rk AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS r FROM e), e2 AS (SELECT * FROM rk WHERE r <= 2), e5 AS (SELECT * FROM rk WHERE r <= 5) {_sweep_sql(2)} UNION ALL {_sweep_sql(5)}")
def sweep_in_degree(spark, sf):
    return experiments.in_degree_sweep(_edges(spark, sf), [2, 5]).select("max_in", "n_directed", "n_undirected", "n_vertices")


@_query(f"WITH {_EDGES} SELECT m::DOUBLE AS min_weight, count(*) AS n_directed, count(DISTINCT (least(src, dst), greatest(src, dst))) AS n_undirected FROM e, (SELECT unnest([0.1, 0.16]) AS m) WHERE w > m GROUP BY 1")
def sweep_similarity(spark, sf):
    return experiments.similarity_sweep(_edges(spark, sf), [0.1, 0.16]).select("min_weight", "n_directed", "n_undirected")


_ALL = _TOP.split(", r AS (SELECT * FROM (SELECT *")[0]


def _similar_sql(k: int) -> str:
    """CTEs r{k}, v{k}, s{k}: edges, shared terms and similarities at an in-degree."""
    return f"""r{k} AS (SELECT * FROM rk WHERE r <= {k}), h{k} AS (SELECT src, sum(w) AS kept FROM r{k} GROUP BY 1), v{k} AS (SELECT x.src AS i, z.src AS j, sum(abs(x.w - z.w) - x.w - z.w) AS v FROM r{k} x JOIN r{k} z ON x.dst = z.dst AND x.src < z.src GROUP BY 1, 2),
    s{k} AS (SELECT i, j, -v / (ti.t + tj.t) AS s, (ti.t + tj.t - coalesce(ki.kept, 0) - coalesce(kj.kept, 0)) / (ti.t + tj.t) AS bound FROM v{k} JOIN tot ti ON ti.src = i JOIN tot tj ON tj.src = j LEFT JOIN h{k} ki ON ki.src = i LEFT JOIN h{k} kj ON kj.src = j)"""


@_query(f"WITH {_ALL}, rk AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS r FROM e), tot AS (SELECT src, sum(w) AS t FROM e GROUP BY 1), {_similar_sql(5)}, {_similar_sql(20)} SELECT 5 AS max_in, b.i AS src, b.j AS dst, round(abs(b.s - coalesce(o.s, 0)), 6) AS error, round(o.bound, 6) AS bound FROM s20 b LEFT JOIN s5 o ON o.i = b.i AND o.j = b.j")
def sweep_similarity_errors(spark, sf):
    return experiments.similarity_errors(_edges(spark, sf), [5], reference=20).select("max_in", "src", "dst", _r("error"), _r("bound"))


@_query(f"WITH {_ALL}, rk AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS r FROM e), tot AS (SELECT src, sum(w) AS t FROM e GROUP BY 1), {_similar_sql(10)}, z AS (SELECT s, (substr(i, 7)::INT * 31 + substr(j, 7)::INT) % 101 AS score FROM s10), q AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS x, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS y FROM z) SELECT 10 AS max_in, count(*) AS n, round(corr(x, y), 6) AS rho FROM q")
def sweep_word_similarity(spark, sf):
    b = _table(spark, sf, "part").select("p_brand").distinct()
    number = lambda c: F.substring(c, 7, 9).cast("int")
    pairs = b.select(F.col("p_brand").alias("i")).join(b.select(F.col("p_brand").alias("j")), F.col("i") < F.col("j")).withColumn("score", ((number("i") * 31 + number("j")) % 101).cast("double"))
    return experiments.word_similarity_sweep(_edges(spark, sf), pairs, [10]).select("max_in", "n", _r("rho"))


@_query(f"WITH {_TOP} SELECT 10::BIGINT AS max_in, count(*) AS pairs, round(avg(err), 6) AS mean_error, true AS timed FROM sim")
def sweep_runtimes(spark, sf):
    rows = experiments.runtimes(_edges(spark, sf), [10])
    return spark.createDataFrame([(r["max_in"], r["pairs"], round(r["mean_error"], 6), r["seconds"] > 0) for r in rows], "max_in long, pairs long, mean_error double, timed boolean")


@_query(f"WITH {_TOP}, lm AS (SELECT v, ti.total AS a, tj.total AS b, coalesce(ki.kept, 0) AS ka, coalesce(kj.kept, 0) AS kb FROM v JOIN tot ti ON ti.src = i JOIN tot tj ON tj.src = j LEFT JOIN kept ki ON ki.src = i LEFT JOIN kept kj ON kj.src = j) SELECT count(*) AS n, round(avg(v + ka + kb), 6) AS l1_kept, round(avg(v + a + b), 6) AS l1_bound, round(avg(a + b), 6) AS norm, round(avg(a + b - ka - kb), 6) AS error, round(avg((v + a + b) / (a + b)), 6) AS relative_l1, round(avg((a + b - ka - kb) / (a + b)), 6) AS relative_error FROM lm")
def l1_term_metrics(spark, sf):
    rows = stats.l1_metrics(graph.l1_terms(_pruned(spark, sf)))
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("l1_kept", "l1_bound", "norm", "error", "relative_l1", "relative_error")])


# Clusters


def _propagated_sql(rounds: int) -> str:
    """CTEs l0 to l{rounds}: synchronous rounds, ties by least label; without weights."""
    step = "SELECT v, l FROM (SELECT g.u AS v, l.l, row_number() OVER (PARTITION BY g.u ORDER BY count(*) DESC, l.l) AS r FROM v g JOIN l{0} l ON l.v = g.v GROUP BY g.u, l.l) WHERE r = 1"
    return ", ".join(["l0 AS (SELECT DISTINCT v, v AS l FROM v)", *[f"l{k + 1} AS ({step.format(k)})" for k in range(rounds)]])


@_query(f"{_PP}, {_propagated_sql(6)} SELECT v AS concept_id, l AS cluster_id FROM l6", "label_propagation")
def label_propagation(spark, sf):
    return clustering.label_propagation(_part_graph(spark, sf), Parameters(iterations=6, weighted=False))


@_query(f"{_PP}, {_propagated_sql(2)} SELECT s::DOUBLE AS saturation, l AS cluster_id, count(*) AS size FROM l2, (SELECT unnest([1, 2]) AS s) GROUP BY 1, 2")
def saturation_sweep(spark, sf):
    """Without weights saturation changes nothing, so that the two runs agree."""
    return clustering.saturation_sweep(_part_graph(spark, sf), [1.0, 2.0], Parameters(iterations=2, weighted=False))


@_query("WITH g AS (SELECT p_type AS c, list_sort(list(DISTINCT p_brand)) AS s FROM part GROUP BY 1 UNION ALL SELECT p_type || 'again', list_sort(list(DISTINCT p_brand)) FROM part GROUP BY p_type) SELECT array_to_string(s, ' ') AS members FROM g WHERE len(s) >= 2 GROUP BY s")
def clusters_distinct(spark, sf):
    part = _table(spark, sf, "part")
    rows = part.select(F.col("p_brand").alias("concept_id"), F.col("p_type").alias("cluster_id"))
    again = rows.withColumn("cluster_id", F.concat("cluster_id", F.lit("again")))
    return clustering.as_text(clustering.distinct_clusters(rows.unionByName(again), min_size=2)).select(F.col("text").alias("members"))


# Concepts


@_query(f"WITH {_BRANDS}, g AS (SELECT DISTINCT p_brand AS c, p_brand[:6] AS p FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')) SELECT x AS context_id, 'both' AS concept_id FROM (SELECT DISTINCT x, c FROM b) JOIN g USING (c) GROUP BY x HAVING count(*) = 2")
def and_activate_unique(spark, sf):
    rows = _baskets(spark, sf).distinct()
    pairs = spark.createDataFrame([("Brand#1", "both"), ("Brand#2", "both")], "child_id string, parent_id string")
    return concepts.activate_and(rows, pairs, unique=True)


def _weighted(spark, sf) -> DataFrame:
    return _baskets(spark, sf).groupBy("context_id", "concept_id").agg(F.count(F.lit(1)).alias("context_count"))


_WEIGHTED = f"{_BRANDS}, {_GROUPS}, k AS (SELECT x, c, count(*) AS n FROM b GROUP BY 1, 2)"


@_query(f"WITH {_WEIGHTED} SELECT DISTINCT p AS concept_id, x AS context_id, n AS context_count FROM k JOIN g USING (c)")
def or_activate_counts(spark, sf):
    return concepts.activate_or_counts(_weighted(spark, sf), _groups(spark, sf))


@_query(f"WITH {_WEIGHTED} SELECT DISTINCT coalesce(p, c) AS concept_id, x AS context_id, n AS context_count FROM k LEFT JOIN (SELECT * FROM g WHERE p < 'Brand#2') USING (c)")
def or_project_counts(spark, sf):
    return concepts.project_or(_weighted(spark, sf), _groups(spark, sf).where("parent_id < 'Brand#2'"))


@_query(f"WITH {_BRANDS}, {_GROUPS}, o AS (SELECT DISTINCT x, p AS c FROM b JOIN g USING (c)), t AS (SELECT x FROM o WHERE c IN ('Brand#1', 'Brand#2') GROUP BY x HAVING count(DISTINCT c) = 2), a AS (SELECT DISTINCT x, c FROM b UNION SELECT x, c || 'x' FROM o UNION SELECT x, 'pair' FROM (SELECT x FROM o WHERE c IN ('Brand#1', 'Brand#2') GROUP BY x HAVING count(DISTINCT c) = 2)) SELECT c AS concept_id, count(*) AS n FROM a GROUP BY 1")
def activate_all_levels(spark, sf):
    """OR concepts of brands, and an AND concept of two of these, found a level later."""
    ors = _groups(spark, sf).withColumn("parent_id", F.concat("parent_id", F.lit("x")))
    pair = spark.createDataFrame([("Brand#1x", "pair"), ("Brand#2x", "pair")], "child_id string, parent_id string")
    return concepts.activate_all(_baskets(spark, sf), pair, ors).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '1|2,3' ELSE '1' END AS cnf FROM part")
def cnf_minimised(spark, sf):
    """(1) and (2 or 3), with a wider clause and repeats that go, or (1) alone where 2 or 3 is not asked for."""
    wide = F.expr("array(array(3L, 2L, 2L), array(1L), array(1L, 2L, 3L), array(1L, 1L))")
    plain = F.expr("array(array(1L), array(1L, 2L))")
    cnf = concepts.minimal_cnf(F.when(F.col("p_size") % 2 == 0, wide).otherwise(plain))
    text = F.array_join(F.transform(cnf, lambda c: F.array_join(F.transform(c, lambda a: a.cast("string")), ",")), "|")
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("cnf"))


@_query("SELECT n_regionkey::BIGINT AS key, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS either, string_agg(n_nationkey::VARCHAR, '|' ORDER BY n_nationkey) AS together FROM nation GROUP BY 1")
def cnf_folded(spark, sf):
    atoms = _table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("key"), F.array(F.array(F.col("n_nationkey").cast("long"))).alias("cnf"))
    text = lambda c, inner, outer: F.array_join(F.transform(c, lambda x: F.array_join(F.transform(x, lambda a: a.cast("string")), inner)), outer)
    ors = concepts.folded_cnf(atoms, "key", "cnf", "or").select("key", text(F.col("cnf"), ",", "|").alias("either"))
    return ors.join(concepts.folded_cnf(atoms, "key", "cnf", "and").select("key", text(F.col("cnf"), ",", "|").alias("together")), "key")


# Prediction and subsets


@_query(f'{_KNN} SELECT v.u AS "user", v.i AS target, round(v.r, 6) AS rating, h.i AS item, round(h.r, 6) AS item_rating FROM v LEFT JOIN h USING (u)')
def targets_with_history(spark, sf):
    history, validation = _stars(spark, sf)
    return predict.targets_with_history(validation, history).select("user", "target", _r("rating"), "item", _r("item_rating"))


@_query("WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS item, o_custkey AS u FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT item, row_number() OVER (ORDER BY count(*), item) AS k FROM r GROUP BY 1), s AS (SELECT r.* FROM r JOIN c USING (item) WHERE (k - 1) % 5 = 0) SELECT l_orderkey, l_linenumber, u AS \"user\", item FROM s WHERE u IN (SELECT u FROM s GROUP BY 1 HAVING count(*) >= 10)")
def sampled_subset(spark, sf):
    return contexts.sampled_subset(_supplies(spark, sf)).select("l_orderkey", "l_linenumber", "user", "item")


@_query(f"WITH {_TOP} SELECT p_partkey, p_brand, p_brand IN (SELECT src FROM r WHERE w > 0.045) AS in_graph FROM part")
def graph_hits(spark, sf):
    strong = _pruned(spark, sf).weights.where("weight > 0.045").select("src")
    return predict.graph_hits(_table(spark, sf, "part").select("p_partkey", "p_brand"), strong, "p_brand").select("p_partkey", "p_brand", "in_graph")


@_query("WITH b AS (SELECT p_partkey AS x, list_sort(list_distinct(string_split(p_name, ' '))) AS t, p_size % 2 AS k FROM part), v AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS p FROM (SELECT DISTINCT unnest(t) AS w FROM b)), f AS (SELECT x, k, unnest(t) AS w FROM b) SELECT x AS context_id, any_value(k)::DOUBLE AS label, string_agg(p::VARCHAR, ',' ORDER BY p) AS places FROM f JOIN v USING (w) GROUP BY x")
def activation_vectors(spark, sf):
    from pyspark.ml.functions import vector_to_array

    part = _table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("context_id"), F.explode(F.split("p_name", " ")).alias("concept_id"))
    vocab = contexts.vocabulary(rows.withColumnRenamed("concept_id", "label")).select(F.col("label").alias("concept_id"), F.col("concept_id").cast("int").alias("place"))
    classes = part.select(F.col("p_partkey").alias("context_id"), (F.col("p_size") % 2).alias("class_id"))
    out = predict.activation_vectors(rows, classes, vocab, vocab.count())
    places = F.filter(F.transform(vector_to_array("features"), lambda x, i: F.when(x == 1.0, i)), lambda i: i.isNotNull())
    return out.select("context_id", "label", F.array_join(places, ",").alias("places"))


@_query(f"WITH {_RATE} SELECT l AS label, count(*) AS n FROM (SELECT CASE WHEN u % 5 = 0 THEN 'validation' ELSE 'history' END AS l FROM r) GROUP BY 1")
def rating_rows_labelled(spark, sf):
    rows = _ratings(spark, sf).withColumn("label", F.when(F.col("user") % 5 == 0, "validation").otherwise("history"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# Measures whose values SQL has no functions for


@_query(f"WITH {_PAIRS}, d AS (SELECT i, j FROM t UNION ALL SELECT j, i FROM t) SELECT i AS src, j AS dst, true AS undefined FROM d", "corr_normbpwmi")
def corr_normbpwmi(spark, sf):
    """The measure keeps its NaN, which compares as a boolean here."""
    edges = _edges(spark, sf, "normbpwmi", alpha=2.0)
    return edges.select("src", "dst", F.isnan("weight").alias("undefined"))


@_query(f"WITH {_PAIRS}, d AS (SELECT i, j, nij, ni FROM t UNION ALL SELECT j, i, nij, nj FROM t) SELECT i AS src, j AS dst, true AS below_mean, true AS positive FROM d")
def bcondprob_bounds(spark, sf):
    """The lower confidence bound lies between 0 and the posterior mean."""
    low = _edges(spark, sf, "bcondprob", alpha=2.0, confidence=0.9).withColumnRenamed("weight", "low")
    mean = _edges(spark, sf, "bcondprob", alpha=2.0)
    return low.join(mean, ["src", "dst"]).select("src", "dst", (F.col("low") <= F.col("weight")).alias("below_mean"), (F.col("low") > 0).alias("positive"))


