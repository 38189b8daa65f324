"""Registered queries over the driver's tables, with SQL that says the same wherever SQL can.

Baskets are orders holding brands, names or parts; sequences and ratings are events; texts are documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.measures import measure, recurs
from kinweave.operators import clustering, concepts, contexts, counts, graph, predict, stats
from kinweave.operators.clustering import Parameters
from kinweave.operators.components import connected_components
from kinweave.operators.graph import EdgeData
from kinweave.runtime import spool

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _baskets(spark: SparkSession, sf: str, of: str = "p_brand") -> DataFrame:
    part = _table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(of).alias("concept_id"))
    return _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("context_id"), "l_partkey").join(part, "l_partkey").select("context_id", "concept_id")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("context_id"), F.col("l_partkey").alias("concept_id"))


def _n_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("n"))


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select(F.col("user_id").alias("user"), F.col("event_id").alias("item"), F.floor(F.col("value") / 20).cast("int").alias("rating"), F.unix_date(F.to_date("ts")).alias("day"))


def _r(c: str, as_: str | None = None):
    return F.round(c, 6).alias(as_ or c)


_BRANDS = "b AS (SELECT l_orderkey AS x, p_brand AS c FROM lineitem JOIN part ON l_partkey = p_partkey)"
_PAIRS = f"""{_BRANDS}, m AS (SELECT c, count(*) AS n FROM b GROUP BY c), nn AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
    p AS (SELECT a.c AS i, z.c AS j, count(*) AS nij FROM b a JOIN b z ON a.x = z.x AND a.c < z.c GROUP BY 1, 2),
    t AS (SELECT i, j, nij, mi.n AS ni, mj.n AS nj, nn.n AS n FROM p JOIN m mi ON mi.c = i JOIN m mj ON mj.c = j, nn)"""
_EDGES = f"""{_PAIRS}, e AS (SELECT i AS src, j AS dst, nij / ni AS w FROM t UNION ALL SELECT j, i, nij / nj FROM t)"""
_TOP = f"""{_EDGES}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS r FROM e) WHERE r <= 10),
    tot AS (SELECT src, sum(abs(w)) AS total FROM e GROUP BY src), kept AS (SELECT src, sum(abs(w)) AS kept FROM r GROUP BY src),
    v AS (SELECT a.src AS i, z.src AS j, sum(abs(a.w - z.w) - abs(a.w) - abs(z.w)) AS v FROM r a JOIN r z ON a.dst = z.dst AND a.src < z.src GROUP BY 1, 2),
    sim AS (SELECT i, j, -v / (ti.total + tj.total) AS s, (ti.total + tj.total - coalesce(ki.kept, 0) - coalesce(kj.kept, 0)) / (ti.total + tj.total) AS err
            FROM v JOIN tot ti ON ti.src = i JOIN tot tj ON tj.src = j LEFT JOIN kept ki ON ki.src = i LEFT JOIN kept kj ON kj.src = j)"""


def _pairs(spark, sf):
    return counts.pair_counts(_baskets(spark, sf))


def _edges(spark, sf, name: str = "condprob", **options):
    return graph.correlations(_pairs(spark, sf), measure(name, **options), _n_orders(spark, sf), min_weight=-1.0)


def _pruned(spark, sf, k: int = 10) -> EdgeData:
    return graph.prune(EdgeData.of(_edges(spark, sf)), max_in=k)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Brands bought in the same company: conditional probabilities over baskets, the ten strongest links into each brand,
    and the relative-L1 similarity of brands by them."""
    return graph.similarities(_pruned(spark, sf), non_negative=True).select("src", "dst", _r("weight"))


_query(f"WITH {_TOP} SELECT i AS src, j AS dst, round(s, 6) AS weight FROM sim WHERE s > 0", "similarity")(flagship)

# Counts


@_query(f"WITH {_BRANDS} SELECT c AS concept_id, count(*) AS n FROM b GROUP BY c")
def cooc_concept_count(spark, sf):
    return counts.concept_counts(_baskets(spark, sf))


@_query(f"WITH {_BRANDS} SELECT c AS concept_id, count(DISTINCT x) AS n FROM b GROUP BY c")
def cooc_existence_count(spark, sf):
    return counts.existence_counts(_baskets(spark, sf))


@_query(f"WITH {_PAIRS} SELECT i, j, nij AS n_ij, ni AS n_i, nj AS n_j FROM t")
def cooc_pair_counts(spark, sf):
    return _pairs(spark, sf)


_CO = _PAIRS.replace("SELECT l_orderkey AS x", "SELECT DISTINCT l_orderkey AS x")


@_query(f"WITH {_CO} SELECT i, j, nij AS n_ij, ni AS n_i, nj AS n_j FROM t")
def cooc_coexistence(spark, sf):
    return counts.coexistence_counts(_baskets(spark, sf))


@_query(
    f"""WITH {_CO}, s AS (SELECT c, count(*) AS n FROM (SELECT l_orderkey, p_brand AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) > 1) GROUP BY c)
    SELECT i, j, nij AS n_ij, ni AS n_i, nj AS n_j FROM t UNION ALL SELECT s.c, s.c, s.n, m.n, m.n FROM s JOIN m USING (c)"""
)
def cooc_self_pairs(spark, sf):
    return counts.coexistence_with_self(_baskets(spark, sf))


_PART_PAIRS = """b AS (SELECT l_orderkey AS x, l_partkey AS c FROM lineitem), m AS (SELECT c, count(*) AS n FROM b GROUP BY c HAVING count(*) >= 2),
    f AS (SELECT * FROM b WHERE c IN (SELECT c FROM m)), p AS (SELECT a.c AS i, z.c AS j, count(*) AS nij FROM f a JOIN f z ON a.x = z.x AND a.c < z.c GROUP BY 1, 2 HAVING count(*) >= 2)"""


@_query(f"WITH {_PART_PAIRS} SELECT i, j, nij AS n_ij, mi.n AS n_i, mj.n AS n_j FROM p JOIN m mi ON mi.c = i JOIN m mj ON mj.c = j")
def cooc_pair_counts_min(spark, sf):
    return counts.pair_counts(_parts(spark, sf), min_count=2)


@_query(
    """WITH a AS (SELECT l_orderkey AS x, l_partkey AS c FROM lineitem WHERE l_returnflag <> 'R'), z AS (SELECT l_orderkey AS x, l_partkey AS c FROM lineitem WHERE l_returnflag = 'R'),
    u AS (SELECT least(a.c, z.c) AS i, greatest(a.c, z.c) AS j FROM a JOIN z USING (x) WHERE a.c <> z.c UNION ALL SELECT a.c, b.c FROM z a JOIN z b ON a.x = b.x AND a.c < b.c),
    p AS (SELECT i, j, count(*) AS nij FROM u GROUP BY 1, 2), m AS (SELECT l_partkey AS c, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT i, j, nij AS n_ij, mi.n AS n_i, mj.n AS n_j FROM p JOIN m mi ON mi.c = i JOIN m mj ON mj.c = j"""
)
def cooc_incremental_pairs(spark, sf):
    line = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("context_id"), F.col("l_partkey").alias("concept_id"), "l_returnflag")
    return counts.pair_counts(line.where("l_returnflag <> 'R'").drop("l_returnflag"), added=line.where("l_returnflag = 'R'").drop("l_returnflag"))


_SETS = f"""{_BRANDS}, s AS (SELECT list_sort(list(DISTINCT c)) AS s FROM b GROUP BY x), g AS (SELECT s, count(*) AS k, row_number() OVER (ORDER BY s) AS x FROM s WHERE len(s) > 1 GROUP BY s),
    cc AS (SELECT unnest(s) AS c, x, k FROM g)"""


def _context_counts(spark, sf):
    return contexts.context_multisets(_baskets(spark, sf))


@_query(f"WITH {_SETS} SELECT array_to_string(s, ',') AS concepts, k AS context_count FROM g")
def context_multisets(spark, sf):
    rows = _context_counts(spark, sf).groupBy("context_id", "context_count").agg(F.array_join(F.array_sort(F.collect_list("concept_id")), ",").alias("concepts"))
    return rows.select("concepts", "context_count")


@_query(
    f"""WITH {_SETS}, h AS (SELECT * FROM cc WHERE k >= 2), m AS (SELECT c, sum(k)::BIGINT AS n FROM h GROUP BY c HAVING sum(k) >= 3),
    p AS (SELECT a.c AS i, z.c AS j, sum(a.k)::BIGINT AS nij FROM h a JOIN h z ON a.x = z.x AND a.c < z.c GROUP BY 1, 2)
    SELECT i, j, nij AS n_ij, mi.n AS n_i, mj.n AS n_j FROM p JOIN m mi ON mi.c = i JOIN m mj ON mj.c = j"""
)
def cooc_pair_counts_ctx(spark, sf):
    return counts.pair_counts_from_contexts(_context_counts(spark, sf), min_context=2, min_concept=3)


_REP = f"{_BRANDS}, q AS (SELECT x, c, count(*) AS m FROM b GROUP BY x, c)"


@_query(f"WITH {_REP} SELECT q.c AS concept_id, m AS n, count(*) AS times, any_value(t.k) AS n_contexts FROM q JOIN (SELECT c, count(*) AS k FROM q GROUP BY c) t USING (c) WHERE m > 1 GROUP BY 1, 2")
def cooc_recurrence(spark, sf):
    return counts.recurrence_counts(_baskets(spark, sf))


@_query(f"WITH {_SETS}, o AS (SELECT c, sum(k) AS n FROM cc GROUP BY c ORDER BY n DESC, c LIMIT 5) SELECT c AS concept_id, sum(k)::BIGINT AS n, count(*) AS n_contexts FROM cc WHERE c IN (SELECT c FROM o) GROUP BY c")
def topk_concepts(spark, sf):
    return counts.top_concepts(_context_counts(spark, sf), 5).groupBy("concept_id").agg(F.sum("context_count").alias("n"), F.count(F.lit(1)).alias("n_contexts"))


# Measures


def _psi(x: str) -> str:
    y = f"({x} + 8.0)"
    z = f"(1 / ({y} * {y}))"
    shift = " + ".join(f"1 / ({x} + {k}.0)" for k in range(8))
    return f"(ln({y}) - 0.5 / {y} - {z} * (1.0/12 - {z} * (1.0/120 - {z} * (1.0/252 - {z} * (1.0/240 - {z} / 132.0)))) - ({shift}))"


def _psi1(x: str) -> str:
    y = f"({x} + 8.0)"
    z = f"(1 / ({y} * {y}))"
    shift = " + ".join(f"1 / (({x} + {k}.0) * ({x} + {k}.0))" for k in range(8))
    return f"(1 / {y} + {z} / 2 + {z} / {y} * (1.0/6 - {z} * (1.0/30 - {z} * (1.0/42 - {z} / 30.0))) + ({shift}))"


_MI_CELLS = [("nij", "ni", "nj"), ("(ni-nij)", "ni", "(n-nj)"), ("(nj-nij)", "(n-ni)", "nj"), ("(n-ni-nj+nij)", "(n-ni)", "(n-nj)")]
_MI = " + ".join(f"CASE WHEN {c} > 0 THEN {c} / n * (ln({c} / n) - ln({r} / n) - ln({k} / n)) ELSE 0 END" for c, r, k in _MI_CELLS)
_PMI = "(ln(nij / n) - ln(ni / n) - ln(nj / n))"
_SMOOTH = {"nij": "(nij + 0.5)", "ni": "(ni + 1.0)", "nj": "(nj + 1.0)", "n": "(n + 2.0)"}
_BPMI = f"({_psi(_SMOOTH['nij'])} - {_psi(_SMOOTH['ni'])} - {_psi(_SMOOTH['nj'])} + {_psi(_SMOOTH['n'])})"
_VAR = [_psi1("(nij + 0.5001)"), _psi1("(ni + 1.0)"), _psi1("(nj + 1.0)"), _psi1("(n + 2.0)")]
_BMI_CELLS = [("(nij+0.5)", "(ni+1.0)", "(nj+1.0)"), ("(ni-nij+0.5)", "(ni+1.0)", "(n-nj+1.0)"), ("(nj-nij+0.5)", "(n-ni+1.0)", "(nj+1.0)"), ("(n-ni-nj+nij+0.5)", "(n-ni+1.0)", "(n-nj+1.0)")]
_BMI = "(" + " + ".join(f"{c} * ({_psi(f'({c}+1.0)')} - {_psi(f'({r}+1.0)')} - {_psi(f'({k}+1.0)')} + {_psi('(n+3.0)')})" for c, r, k in _BMI_CELLS) + ") / (n + 2.0)"
_STEP = f"(sqrt({_VAR[0]} + {_VAR[1]} + {_VAR[2]} - 3 * {_VAR[3]} + 2 * (sqrt(({_VAR[0]}-{_VAR[3]}) * ({_VAR[1]}-{_VAR[3]})) + sqrt(({_VAR[0]}-{_VAR[3]}) * ({_VAR[2]}-{_VAR[3]})) + sqrt(({_VAR[1]}-{_VAR[3]}) * ({_VAR[2]}-{_VAR[3]})))) * 0.2533471031357997)"
_MEASURE_SQL = {
    "existence": ("1.0::DOUBLE",), "pairwiseCount": ("nij::DOUBLE",), "weightedCount": ("nij::DOUBLE * nij / (ni::DOUBLE * nj)",), "overlap": ("nij / least(ni, nj)",), "sorensenDice": ("2 * nij / (ni + nj)",),
    "jaccard": ("nij / (ni + nj - nij)",), "condprob": ("nij / ni", "nij / nj"), "bcondprob": ("(nij + 1.0::DOUBLE) / (ni + 2)", "(nij + 1.0::DOUBLE) / (nj + 2)"), "pwmi": (_PMI,), "bpwmi": (_BPMI,), "normpwmi": (f"-{_PMI} / ln(nij / n)",),
    "normbpwmi": ("'nan'::DOUBLE",), "mutualinfo": (_MI,), "bmi": (_BMI,),
}


def _add_measure(name: str, there: str, back: str) -> None:
    sql = f"""WITH {_PAIRS}, d AS (SELECT i, j, nij::DOUBLE AS nij, ni::DOUBLE AS ni, nj::DOUBLE AS nj, n::DOUBLE AS n FROM t),
    e AS (SELECT i AS src, j AS dst, {there} AS w FROM d UNION ALL SELECT j, i, {back} FROM d) SELECT src, dst, round(w, 6) AS weight FROM e"""

    def run(spark, sf):
        return _edges(spark, sf, name, **({"alpha": 2.0} if name in ("bpwmi", "normbpwmi", "bmi", "bcondprob") else {})).select("src", "dst", _r("weight"))

    _query(sql if name != "normbpwmi" else None, f"corr_{name}")(run)


for _name, _sql in _MEASURE_SQL.items():
    _add_measure(_name, _sql[0], _sql[-1])


@_query(
    f"""WITH {_PAIRS}, d AS (SELECT i, j, nij::DOUBLE AS nij, ni::DOUBLE AS ni, nj::DOUBLE AS nj, n::DOUBLE AS n FROM t), w AS (SELECT i, j, {_BPMI} AS m, {_STEP} AS s FROM d),
    e AS (SELECT i, j, CASE WHEN m >= 0 THEN greatest(m - s, 0) ELSE least(m + s, 0) END AS w FROM w) SELECT i AS src, j AS dst, round(w, 6) AS weight FROM e UNION ALL SELECT j, i, round(w, 6) FROM e"""
)
def corr_bpwmi_confidence(spark, sf):
    return _edges(spark, sf, "bpwmi", alpha=2.0, confidence=0.6).select("src", "dst", _r("weight"))


@_query()
def corr_bmi_confidence(spark, sf):
    return _edges(spark, sf, "bmi", alpha=2.0, confidence=0.9).select("src", "dst", _r("weight"))


@_query()
def corr_bcondprob_confidence(spark, sf):
    return _edges(spark, sf, "bcondprob", alpha=2.0, confidence=0.9).select("src", "dst", _r("weight"))


def _add_recurrence(rule: str, bound: float, sql: str) -> None:
    text = f"""WITH {_REP}, h AS (SELECT c, count(*) AS k FROM q GROUP BY c), r AS (SELECT c, m, count(*) AS t FROM q WHERE m > 1 GROUP BY c, m),
    nn AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) SELECT r.c AS concept_id, r.m AS n, {sql} AS recurs FROM r JOIN h USING (c), nn"""

    def run(spark, sf):
        rows = counts.recurrence_counts(_baskets(spark, sf)).crossJoin(_n_orders(spark, sf).withColumnRenamed("n", "total"))  # one row
        return rows.select("concept_id", "n", recurs(F.col("times"), F.col("n_contexts"), F.col("total"), rule, bound).alias("recurs"))

    _query(text, f"recur_{rule}")(run)


for _rule, _bound, _sql in (("existence", 1, "t >= 1"), ("always", 1, "t >= k"), ("countThreshold", 20, "t >= 20"), ("conceptFraction", 0.02, "t / k >= 0.02"), ("totalFraction", 0.002, "t / n >= 0.002")):
    _add_recurrence(_rule, _bound, _sql)

# Graphs


@_query(f"WITH {_EDGES} SELECT src, dst, round(w, 6) AS weight FROM e WHERE w >= 0.16")
def prune_weight(spark, sf):
    return graph.prune(EdgeData.of(_edges(spark, sf)), min_weight=0.16).weights.select("src", "dst", _r("weight"))


@_query(f"WITH {_TOP} SELECT src, dst, round(w, 6) AS weight FROM r")
def prune_indegree(spark, sf):
    return _pruned(spark, sf).weights.select("src", "dst", _r("weight"))


@_query(f"WITH {_TOP} SELECT tot.src, round(coalesce(kept, 0), 6) AS kept, round(total - coalesce(kept, 0), 6) AS discarded FROM tot LEFT JOIN kept USING (src)")
def edge_sums(spark, sf):
    return _pruned(spark, sf).sums.select("src", _r("kept"), _r("discarded"))


@_query(f"WITH {_TOP} SELECT i AS src, j AS dst, round(s, 6) AS weight, round(err, 6) AS error FROM sim")
def similarity_error_bound(spark, sf):
    return graph.similarities(_pruned(spark, sf), None, error=True).select("src", "dst", _r("weight"), _r("error"))


@_query(f"WITH {_TOP} SELECT i AS src, j AS dst, round(-v / (ki.kept + kj.kept), 6) AS weight FROM v JOIN kept ki ON ki.src = i JOIN kept kj ON kj.src = j")
def similarity_surviving(spark, sf):
    return graph.similarities(_pruned(spark, sf), None, totals="surviving").select("src", "dst", _r("weight"))


@_query(f"WITH {_TOP} SELECT i AS src, j AS dst, round(s, 6) AS weight FROM sim WHERE (i, j) IN (('Brand#11', 'Brand#12'), ('Brand#13', 'Brand#21'), ('Brand#22', 'Brand#55'))")
def similarity_of_pairs(spark, sf):
    pairs = spark.createDataFrame([("Brand#12", "Brand#11"), ("Brand#13", "Brand#21"), ("Brand#22", "Brand#55")], "i string, j string")
    return graph.pair_similarities(_pruned(spark, sf), pairs).select("src", "dst", _r("weight"))


@_query(f"WITH {_TOP} SELECT i, j, round(coalesce(ki.kept, 0), 6) AS r_i, round(tj.total - coalesce(kj.kept, 0), 6) AS d_j, round(v, 6) AS s FROM v JOIN tot tj ON tj.src = j LEFT JOIN kept ki ON ki.src = i LEFT JOIN kept kj ON kj.src = j")
def l1_terms(spark, sf):
    return graph.l1_terms(_pruned(spark, sf)).select("i", "j", _r("r_i"), _r("d_j"), _r("s"))


@_query(f"WITH {_EDGES} SELECT src, dst, round(w, 6) AS weight FROM e ORDER BY w DESC, src, dst LIMIT 20")
def top_edges(spark, sf):
    return graph.top_edges(_edges(spark, sf), 20).select("src", "dst", _r("weight"))


@_query(f"WITH {_TOP} SELECT coalesce(o.v, i.v) AS vertex, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM (SELECT src AS v, count(*) AS n FROM r GROUP BY 1) o FULL JOIN (SELECT dst AS v, count(*) AS n FROM r GROUP BY 1) i ON o.v = i.v")
def degree_dist(spark, sf):
    return graph.degrees(_pruned(spark, sf).weights).select("vertex", "out_degree", "in_degree")


_TYPES = "b AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t FROM b)"


def _bigrams(spark, sf):
    return _table(spark, sf, "part").groupBy(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_TYPES} SELECT a AS src, b AS dst, round(n / sum(n) OVER (PARTITION BY a), 6) AS weight FROM b")
def bigram_conditional(spark, sf):
    return graph.bigram_graph(_bigrams(spark, sf))[1].select("src", "dst", _r("weight"))


@_query(f"WITH {_TYPES} SELECT w AS label, round(sum(n) / any_value(2 * t.t), 6) AS weight FROM (SELECT a AS w, n FROM b UNION ALL SELECT b, n FROM b), t GROUP BY w")
def bigram_vertices(spark, sf):
    return graph.bigram_graph(_bigrams(spark, sf))[0].select("label", _r("weight"))


@_query(f"WITH {_TYPES} SELECT a AS src, b AS dst, round(-(ln(n / t) - ln(sum(n) OVER (PARTITION BY a) / t) - ln(sum(n) OVER (PARTITION BY b) / t)) / ln(n / t), 6) AS weight FROM b, t")
def bigram_npmi(spark, sf):
    return graph.bigram_pmi(_bigrams(spark, sf), normalised=True).select("src", "dst", _r("weight"))


@_query(f"WITH {_TYPES}, w AS (SELECT w, sum(n) / any_value(2 * t.t) AS f FROM (SELECT a AS w, n FROM b UNION ALL SELECT b, n FROM b), t GROUP BY w), ok AS (SELECT w FROM w WHERE f BETWEEN 0.0195 AND 0.5) SELECT a, b, n FROM b WHERE a IN (SELECT w FROM ok) AND b IN (SELECT w FROM ok)")
def bigrams_in_range(spark, sf):
    return graph.bigrams_in_range(_bigrams(spark, sf), 0.0195, 0.5)


# Contexts


@_query("SELECT row_number() OVER (ORDER BY label) - 1 AS concept_id, label, n FROM (SELECT p_name AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 80)")
def vocabulary(spark, sf):
    return contexts.vocabulary(_baskets(spark, sf, "p_name").withColumnRenamed("concept_id", "label"), min_count=80)


_CLEAN = "list_filter(string_split(lower(regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g')), ' '), lambda x: x <> '')"


@_query(
    f"""WITH s AS (SELECT {_CLEAN} AS t FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) WHERE len({_CLEAN}) > 1),
    g AS (SELECT unnest(CASE WHEN len(t) < 3 THEN [t] ELSE list_transform(generate_series(1, len(t) - 2), lambda i: t[i:i + 2]) END) AS g FROM s)
    SELECT array_to_string(g, ' ') AS ngram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 5"""
)
def ngram_windows(spark, sf):
    lines = _table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    return contexts.ngram_counts(lines, "text", 3).where("n >= 5").select(F.array_join("tokens", " ").alias("ngram"), "n")


_MULTI = f"""l AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents), s AS (SELECT {_CLEAN} AS t FROM l WHERE len({_CLEAN}) > 1),
    g AS (SELECT unnest(CASE WHEN len(t) < 3 THEN [t] ELSE list_transform(generate_series(1, len(t) - 2), lambda i: t[i:i + 2]) END) AS g FROM s),
    o AS (SELECT list_sort(g) AS g FROM g), k AS (SELECT array_to_string(g, ' ') AS k, g, count(*) AS n FROM o GROUP BY g HAVING count(*) >= 3 AND len(list_distinct(g)) > 1),
    u AS (SELECT k, n, unnest(list_distinct(g)) AS w, g FROM k), x AS (SELECT w, len(list_filter(g, lambda y: y = w)) AS m, n FROM u)"""


@_query(f"WITH {_MULTI} SELECT CASE WHEN m > 1 THEN w || '^' || m ELSE w END AS concept, count(*) AS n_contexts, sum(n)::BIGINT AS n FROM x GROUP BY 1")
def ngram_context_counts(spark, sf):
    lines = _table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    out = contexts.ngrams_to_context_counts(contexts.ngram_counts(lines, "text", 3), min_count=3)
    names = out["concepts"].unionByName(out["recurrent"].join(out["concepts"], "concept_id").select(F.col("rec_id").alias("concept_id"), F.concat_ws("^", "label", F.col("n").cast("string")).alias("label")))
    rows = out["context_counts"].join(names, "concept_id")
    return rows.groupBy(F.col("label").alias("concept")).agg(F.count(F.lit(1)).alias("n_contexts"), F.sum("context_count").alias("n"))


@_query("SELECT l_orderkey + k AS context_id, count(*) AS n, count(DISTINCT l_partkey) AS n_concepts FROM lineitem, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1")
def moving_window(spark, sf):
    return contexts.moving_window(_parts(spark, sf), 3).groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("concept_id").alias("n_concepts"))


_RATE = "r AS (SELECT user_id AS u, event_id AS item, floor(value / 20)::INT AS rating, (ts::DATE - DATE '1970-01-01') AS d FROM events)"


@_query(f"WITH {_RATE} SELECT a.item AS a, b.item AS b, count(*) AS n FROM r a JOIN r b ON a.u = b.u AND a.rating = b.rating AND a.d = b.d AND a.item <> b.item GROUP BY 1, 2")
def pair_by_rating_day(spark, sf):
    return contexts.same_rating_pairs(_ratings(spark, sf))


@_query(f"WITH {_RATE} SELECT a.item AS a, b.item AS b, count(*) AS n FROM r a JOIN r b ON a.u = b.u AND b.d BETWEEN a.d - 2 AND a.d + 3 AND b.rating BETWEEN a.rating - 1 AND a.rating AND a.item <> b.item GROUP BY 1, 2")
def pair_by_range(spark, sf):
    return contexts.near_rating_pairs(_ratings(spark, sf), days=(2, 3), stars=(1, 0))


@_query("WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events) SELECT a, b, count(*) AS n FROM s WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= 3")
def sequence_bigrams(spark, sf):
    return contexts.sequence_bigrams(_table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


_POP = "c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)"


@_query(f"WITH {_POP} SELECT count(*) FILTER (n >= 500 AND n < 600) AS from_500, count(*) FILTER (n >= 600 AND n < 700) AS from_600, count(*) FILTER (n >= 700) AS from_700, count(*) FILTER (n >= 200) AS from_200 FROM c")
def popularity_buckets(spark, sf):
    return contexts.popularity_buckets(_table(spark, sf, "lineitem"), "l_suppkey")


@_query(f"WITH {_POP} SELECT l_suppkey, n FROM (SELECT *, row_number() OVER (ORDER BY n, l_suppkey) AS r FROM c) WHERE r % 5 = 1")
def systematic_sample(spark, sf):
    return contexts.systematic_sample(_table(spark, sf, "lineitem"), "l_suppkey")


def _supplies(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("item")).join(o, "l_orderkey")


_SUP = "r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS item, o_custkey AS u FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@_query(
    f"""WITH {_SUP}, i AS (SELECT item FROM r GROUP BY 1 HAVING count(*) >= 590), us AS (SELECT u FROM r GROUP BY 1 HAVING count(*) >= 45 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    SELECT l_orderkey, l_linenumber, u AS "user", item FROM r WHERE item IN (SELECT item FROM i) AND u IN (SELECT u FROM us)"""
)
def dense_subset(spark, sf):
    rich = _table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user"))
    return contexts.dense_subset(_supplies(spark, sf), 590, 45, also=rich).select("l_orderkey", "l_linenumber", "user", "item")


@_query("SELECT DISTINCT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def user_set_intersect(spark, sf):
    return _table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).intersect(_table(spark, sf, "customer").where("c_nationkey < 10").select("c_custkey"))


@_query("SELECT CASE WHEN p_size <= 10 THEN p_brand WHEN p_size <= 20 THEN p_type ELSE p_name END AS item, count(*) AS n FROM part WHERE p_size <= 40 GROUP BY 1")
def hierarchy_rewrite(spark, sf):
    part = _table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name")
    rows = part.select(F.concat(F.col("p_name"), F.when(F.col("p_size") <= 20, F.concat(F.lit("/"), F.col("p_partkey").cast("string"))).otherwise(F.lit(""))).alias("item"), F.lit(1).alias("rating"), "p_size", "p_brand", "p_type")
    kind = F.when(F.col("p_size") <= 10, "track").when(F.col("p_size") <= 20, "album").when(F.col("p_size") <= 40, "artist").otherwise("other")
    kinds = rows.groupBy("item").agg(F.min(kind).alias("kind"))
    tracks = rows.where("p_size <= 10").select(F.col("item").alias("track_id"), F.col("p_brand").alias("artist_id"))
    albums = rows.where("p_size > 10 and p_size <= 20").select(F.col("item").alias("album_id"), F.col("p_type").alias("artist_id"))
    low = rows.where("p_size <= 40").select("item", "rating")
    return contexts.lift_items(low, tracks, albums, kinds).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


# Statistics


@_query(
    f"""WITH {_TOP}, o AS (SELECT count(*) AS n FROM r GROUP BY src), i AS (SELECT count(*) AS n FROM r GROUP BY dst)
    SELECT (SELECT count(*) FROM r) AS n_edges, (SELECT count(*) FROM (SELECT src FROM r UNION SELECT dst FROM r)) AS n_vertices, round((SELECT avg(w) FROM r), 6) AS weight_mean, round((SELECT stddev_pop(w) FROM r), 6) AS weight_stdev,
    round((SELECT avg(n) FROM o), 6) AS out_mean, round((SELECT stddev_pop(n) FROM o), 6) AS out_stdev, round((SELECT avg(n) FROM i), 6) AS in_mean, round((SELECT stddev_pop(n) FROM i), 6) AS in_stdev"""
)
def graph_stats(spark, sf):
    row = stats.graph_statistics(_pruned(spark, sf).weights)
    return row.select("n_edges", "n_vertices", *[_r(c) for c in row.columns if c not in ("n_edges", "n_vertices")])


@_query(
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT k::INT AS bin, round(lo + k * (hi - lo) / 20, 6) AS "left", coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, 19)) AS k) CROSS JOIN e LEFT JOIN b ON b.bin = k"""
)
def histogram(spark, sf):
    return stats.histogram(_table(spark, sf, "lineitem"), "l_extendedprice", 20).select("bin", _r("left"), "n")


@_query('SELECT value, n, sum(n) OVER (ORDER BY value)::BIGINT AS at_most FROM (SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1)')
def cumulative_counts(spark, sf):
    return stats.cumulative_counts(_table(spark, sf, "part"), "p_size")


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1, 2")
def shares(spark, sf):
    return stats.shares(_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", "n", _r("share"))


@_query("SELECT round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n, round(stddev_pop(l_quantity), 6) AS stdev FROM lineitem")
def summary(spark, sf):
    return stats.summary(_table(spark, sf, "lineitem"), "l_quantity").select(_r("mean"), "n", _r("stdev"))


_PP = f"WITH {_PART_PAIRS}, g AS (SELECT i, j FROM p), v AS (SELECT i AS v, j AS u FROM g UNION ALL SELECT j, i FROM g)"


def _part_graph(spark, sf) -> DataFrame:
    return counts.pair_counts(_parts(spark, sf), min_count=2).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("n_ij").cast("double").alias("weight"))


@_query(
    f"""WITH {_TOP}, g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM r), d AS (SELECT v, count(*) AS d FROM (SELECT a AS v FROM g UNION ALL SELECT b FROM g) GROUP BY 1 HAVING count(*) > 1),
    tri AS (SELECT x.a AS p, x.b AS q, y.b AS s FROM g x JOIN g y ON x.b = y.a JOIN g z ON z.a = x.a AND z.b = y.b), k AS (SELECT v, count(*) AS k FROM (SELECT p AS v FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT s FROM tri) GROUP BY 1)
    SELECT d.v AS vertex, d AS degree, coalesce(k, 0) AS triangles, round(coalesce(k, 0) / (d * (d - 1) / 2), 6) AS coefficient FROM d LEFT JOIN k USING (v)"""
)
def triangle_clustering_coeff(spark, sf):
    return stats.clustering_coefficients(_pruned(spark, sf).weights).select("vertex", "degree", "triangles", _r("coefficient"))


_CC = _PP.replace("WITH ", "WITH RECURSIVE ", 1) + ", cc(v, c) AS (SELECT v, v FROM v UNION SELECT v.u, cc.c FROM cc JOIN v ON v.v = cc.v)"


@_query(f"{_CC} SELECT v AS vertex, min(c) AS component FROM cc GROUP BY v")
def connected_part_components(spark, sf):
    return connected_components(_part_graph(spark, sf))


@_query(f"{_CC}, l AS (SELECT v, min(c) AS c FROM cc GROUP BY v) SELECT (SELECT count(*) FROM p) AS n_directed, (SELECT count(*) FROM p) AS n_undirected, count(*) AS n_vertices, count(DISTINCT c) AS n_components FROM l")
def graph_measures(spark, sf):
    return stats.graph_measures(_part_graph(spark, sf)).drop("mean_coefficient")


@_query(
    """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM r)
    SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM k"""
)
def spearman_benchmark(spark, sf):
    return stats.spearman(_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", _r("rho"))


@_query("SELECT count(*) AS n, round(sqrt(avg((l_quantity - 25) ** 2)), 6) AS rmse, count(*) FILTER (l_returnflag = 'R') AS n_hits, round(sqrt(avg((l_quantity - 25) ** 2) FILTER (l_returnflag = 'R')), 6) AS rmse_hits FROM lineitem")
def rmse(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_quantity", F.lit(25.0).alias("p"), (F.col("l_returnflag") == "R").alias("hit"))
    return stats.rmse(rows, "p", "l_quantity", "hit").select("n", _r("rmse"), "n_hits", _r("rmse_hits"))


# Clusters


@_query(
    f"""WITH {_EDGES}, b2 AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM e) WHERE r = 1)
    SELECT x.src AS a, x.dst AS b FROM b2 x JOIN b2 y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst"""
)
def mutual_max(spark, sf):
    rows = clustering.mutual_max(_edges(spark, sf))
    return rows.groupBy("cluster_id").agg(F.min("concept_id").alias("a"), F.max("concept_id").alias("b")).select("a", "b")


@_query(f"WITH {_EDGES} SELECT DISTINCT least(src, dst) || ' ' || greatest(src, dst) AS members FROM e WHERE w >= 0.16")
def edge_clusters(spark, sf):
    return clustering.as_text(clustering.edge_clusters(_edges(spark, sf), Parameters(min_weight=0.16))).select(F.col("text").alias("members"))


@_query(
    f"""{_PP.replace("WITH ", "WITH RECURSIVE ", 1)}, nb AS (SELECT v, list_sort(list(u)) AS f FROM v GROUP BY v), c(m, f) AS (SELECT [v], f FROM nb UNION ALL
    SELECT m || [x], list_filter(c.f, lambda y: list_contains(nb.f, y)) FROM (SELECT m, f, unnest(f) AS x FROM c) c JOIN nb ON nb.v = x WHERE x > m[len(m)])
    SELECT array_to_string(m, ' ') AS members FROM c WHERE len(f) = 0"""
)
def max_cliques(spark, sf):
    return clustering.as_text(clustering.maximal_cliques(_part_graph(spark, sf), Parameters(undirected=True))).select(F.col("text").alias("members"))


@_query(ORACLES["max_cliques"], "max_cliques_local")
def max_cliques_local(spark, sf):
    return clustering.as_text(clustering.local_cliques(_part_graph(spark, sf))).select(F.col("text").alias("members"))


@_query()
def slpa(spark, sf):
    return clustering.slpa(_part_graph(spark, sf), Parameters(undirected=True))


@_query()
def slpa_top_labels(spark, sf):
    return clustering.slpa_top_labels(_part_graph(spark, sf), Parameters(undirected=True, weighted=False, capacity=20, iterations=6))


# Higher-order concepts


@_query(f"WITH {_REP} SELECT c AS concept_id, m AS n FROM q WHERE m > 1 GROUP BY 1, 2 HAVING count(*) >= 2")
def recurrent_find(spark, sf):
    return concepts.find_recurrent(_baskets(spark, sf), 2)


@_query(f"WITH {_REP}, r AS (SELECT DISTINCT c, m FROM q WHERE m > 1) SELECT q.x AS context_id, r.c || '^' || r.m AS concept_id FROM q JOIN r ON q.c = r.c AND r.m <= q.m")
def recurrent_activate(spark, sf):
    base = _baskets(spark, sf)
    found = concepts.find_recurrent(base).withColumn("rec_id", F.concat_ws("^", "concept_id", F.col("n").cast("string")))
    return concepts.activate_recurrent(base, found)


_GROUPS = "g AS (SELECT DISTINCT p_brand AS c, substr(p_brand, 1, 7) AS p FROM part), z AS (SELECT p, count(*) AS size FROM g GROUP BY p)"


def _groups(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_brand").alias("child_id"), F.substring("p_brand", 1, 7).alias("parent_id")).distinct()


@_query(f"WITH {_BRANDS}, {_GROUPS} SELECT DISTINCT x AS context_id, p AS concept_id FROM b JOIN g USING (c)")
def or_activate(spark, sf):
    return concepts.activate_or(_baskets(spark, sf), _groups(spark, sf))


_MATES = "g AS (SELECT DISTINCT p_type AS c, 'all' AS p FROM part WHERE p_type < 'M'), z AS (SELECT p, count(*) AS size FROM g GROUP BY p), b AS (SELECT l_orderkey AS x, p_type AS c FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _mates(spark, sf):
    return _table(spark, sf, "part").where("p_type < 'M'").select(F.col("p_type").alias("child_id"), F.lit("all").alias("parent_id")).distinct()


@_query(f"WITH {_MATES} SELECT x AS context_id, p AS concept_id FROM b JOIN g USING (c) JOIN z USING (p) GROUP BY x, p HAVING count(DISTINCT c) >= any_value(size) AND count(DISTINCT c) >= 2")
def and_activate(spark, sf):
    return concepts.activate_and(_baskets(spark, sf, "p_type"), _mates(spark, sf))


@_query(f"WITH {_BRANDS}, {_GROUPS} SELECT DISTINCT x AS context_id, coalesce(p, c) AS concept_id FROM b LEFT JOIN (SELECT * FROM g WHERE p < 'Brand#3') USING (c)")
def or_project(spark, sf):
    return concepts.project_or_contexts(_baskets(spark, sf), _groups(spark, sf).where("parent_id < 'Brand#3'"))


@_query(
    f"""WITH {_MATES}, k AS (SELECT DISTINCT x, c FROM b), a AS (SELECT x, p FROM k JOIN g USING (c) JOIN z USING (p) GROUP BY x, p HAVING count(*) >= any_value(size) AND count(*) >= 2)
    SELECT c AS concept_id, count(*) AS n FROM (SELECT c FROM k WHERE NOT EXISTS (SELECT 1 FROM a JOIN g ON g.p = a.p WHERE a.x = k.x AND g.c = k.c) UNION ALL SELECT p FROM a) GROUP BY 1"""
)
def and_project(spark, sf):
    rows = _baskets(spark, sf, "p_type").distinct().withColumn("context_count", F.lit(1).cast("long"))
    return concepts.project_and(rows, _mates(spark, sf)).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))


def _numbered_brands(spark, sf) -> DataFrame:
    return _baskets(spark, sf).select("context_id", F.regexp_extract("concept_id", "([0-9]+)", 1).cast("long").alias("concept_id"))


@_query()
def higher_order_projected(spark, sf):
    rows = contexts.context_multisets(_numbered_brands(spark, sf))
    found = concepts.discover_projected(rows, concepts.Settings(measure("condprob"), n=15_000, levels=2, max_in=10, min_similarity=0.1))
    return found.and_concepts.withColumn("kind", F.lit("and")).unionByName(found.or_concepts.withColumn("kind", F.lit("or")))


@_query()
def higher_order_from_counts(spark, sf):
    rows = contexts.context_multisets(_numbered_brands(spark, sf))
    found = concepts.discover_from_counts(rows, concepts.Settings(measure("condprob"), n=15_000, levels=2, max_in=10, min_similarity=0.1))
    return found.and_concepts.withColumn("kind", F.lit("and")).unionByName(found.or_concepts.withColumn("kind", F.lit("or")))


@_query(
    f"""WITH {_EDGES}, b2 AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM e) WHERE r = 1),
    pr AS (SELECT x.src || '&' || x.dst AS p, unnest([x.src, x.dst]) AS c FROM b2 x JOIN b2 y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst)
    SELECT p AS concept_id, count(*) AS n FROM (SELECT x, p FROM (SELECT DISTINCT x, c FROM b) d JOIN pr USING (c) GROUP BY x, p HAVING count(*) = 2) GROUP BY p"""
)
def higher_order_level1(spark, sf):
    base = _baskets(spark, sf)
    names = clustering.mutual_max(_edges(spark, sf))
    label = names.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("concept_id")), "&").alias("parent_id"))
    pairs = names.join(label, "cluster_id").select(F.col("concept_id").alias("child_id"), "parent_id")
    return concepts.activate_and(base, pairs).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))


# Classification and prediction


def _labelled_words(spark, sf):
    docs = spool(_table(spark, sf, "documents").select(F.col("doc_id").alias("context_id"), F.explode(F.array_distinct(contexts.cleaned_tokens(F.col("text")))).alias("concept_id")), "words")
    common = docs.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("concept_id")
    labels = _table(spark, sf, "labels").select(F.col("doc_id").alias("context_id"), F.col("quality").alias("class_id"))
    return spool(docs.join(common, "concept_id", "left_semi").select("context_id", "concept_id"), "common"), labels


@_query(
    f"""WITH w AS (SELECT DISTINCT doc_id AS x, unnest({_CLEAN}) AS c FROM documents), w2 AS (SELECT * FROM w WHERE c IN (SELECT c FROM w GROUP BY c HAVING count(*) >= 20)),
    tr AS (SELECT w2.* FROM w2 JOIN labels ON doc_id = x), tot AS (SELECT c, count(*) AS n FROM tr GROUP BY c), jn AS (SELECT quality AS k, c, count(*) AS m FROM tr JOIN labels ON doc_id = x GROUP BY 1, 2),
    p AS (SELECT k, c, m / n AS p FROM jn JOIN tot USING (c)), pri AS (SELECT quality AS k, count(*) / (SELECT count(*) FROM labels) AS pr FROM labels GROUP BY 1),
    ba AS (SELECT k, ln(any_value(pr)) + sum(CASE WHEN p >= 1 THEN -100 ELSE ln(1 - CASE WHEN p < 1 THEN p END) END) AS b FROM pri JOIN p USING (k) GROUP BY k),
    se AS (SELECT x, c FROM w2 JOIN tot USING (c)), hi AS (SELECT x, k, sum(CASE WHEN p >= 1 THEN 100 ELSE ln(p) - ln(1 - CASE WHEN p < 1 THEN p END) END) AS g, count(*) AS h FROM se JOIN p USING (c) GROUP BY 1, 2),
    he AS (SELECT x, count(*) AS h FROM se GROUP BY x), gr AS (SELECT d.x, k, b FROM (SELECT DISTINCT x FROM w2) d, ba),
    sc AS (SELECT gr.x, gr.k, b + coalesce(g, 0) - 100 * (coalesce(he.h, 0) - coalesce(hi.h, 0)) AS s FROM gr LEFT JOIN he USING (x) LEFT JOIN hi ON hi.x = gr.x AND hi.k = gr.k)
    SELECT x AS context_id, k AS class_id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, k) AS r FROM sc) WHERE r = 1"""
)
def naive_bayes(spark, sf):
    words, labels = _labelled_words(spark, sf)
    train = words.join(labels.select("context_id"), "context_id", "left_semi")
    out = predict.concept_naive_bayes(train, labels, words, labels.count())
    return out.select("context_id", "class_id", F.round("score", 4).alias("score"))


def _stars(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    line = _table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").join(o, "l_orderkey")
    part = _table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    rows = line.join(part, "l_partkey").groupBy("user", "item", "l_returnflag").agg(F.avg("l_quantity").alias("rating"))
    return rows.where("l_returnflag <> 'R'").groupBy("user", "item").agg(F.max("rating").alias("rating")), rows.where("l_returnflag = 'R'").select("user", "item", "rating")


_KNN = """WITH q AS (SELECT o_custkey AS u, p_brand AS i, l_returnflag AS f, avg(l_quantity) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    h AS (SELECT u, i, max(r) AS r FROM q WHERE f <> 'R' GROUP BY ALL), v AS (SELECT u, i, r FROM q WHERE f = 'R'), s AS (SELECT a.b AS x, z.b AS y, 1 / (1 + abs(a.n - z.n)) AS s
    FROM (SELECT DISTINCT p_brand AS b, substr(p_brand, 7)::INT AS n FROM part) a, (SELECT DISTINCT p_brand AS b, substr(p_brand, 7)::INT AS n FROM part) z WHERE abs(a.n - z.n) <= 2),
    n AS (SELECT v.u, v.i, s.s, h.r, row_number() OVER (PARTITION BY v.u, v.i ORDER BY s.s DESC, h.i) AS k FROM v JOIN s ON s.x = v.i JOIN h ON h.u = v.u AND h.i = s.y),
    g AS (SELECT u, i, sum(s * r) / sum(s) AS p FROM n WHERE k <= 5 GROUP BY ALL), m AS (SELECT u, avg(r) AS m FROM h GROUP BY u)"""


def _near_brands(spark, sf):
    b = _table(spark, sf, "part").select(F.col("p_brand").alias("b")).distinct().withColumn("n", F.substring("b", 7, 9).cast("int"))
    a = b.select(F.col("b").alias("source"), F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("n"), F.col("n").alias("m"))
    return a.join(b.withColumnRenamed("b", "target"), "n").select("source", "target", (1 / (1 + F.abs(F.col("m") - F.col("n")))).alias("similarity"))


@_query(f'{_KNN} SELECT v.u AS "user", v.i AS target, round(v.r, 6) AS rating, round(coalesce(g.p, m.m, 0), 6) AS predicted, g.p IS NOT NULL AS hit FROM v LEFT JOIN g USING (u, i) LEFT JOIN m USING (u)')
def knn_predict(spark, sf):
    history, validation = _stars(spark, sf)
    return predict.knn_predict(validation, history, _near_brands(spark, sf)).select("user", "target", _r("rating"), _r("predicted"), "hit")


@_query(f'{_KNN} SELECT v.u AS "user", v.i AS target, round(coalesce(m.m, 0), 6) AS predicted FROM v LEFT JOIN m USING (u)')
def mean_fallback(spark, sf):
    history, validation = _stars(spark, sf)
    return predict.knn_predict(validation, history, _near_brands(spark, sf).limit(0)).select("user", "target", _r("predicted"))


@_query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + k) % 25 AS b, 0.5 + 0.1 * k AS s FROM nation, (SELECT unnest([1, 2, 3]) AS k)),
    l AS (SELECT a, b, s FROM e UNION ALL SELECT b, a, s FROM e), p(s0, v, d, sim, h) AS (SELECT n_nationkey, n_nationkey, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM nation
    UNION ALL SELECT s0, l.b, d + 1 - s, sim * s, h + 1 FROM p JOIN l ON l.a = p.v WHERE d + 1 - s <= 1.0000001 AND h < 6)
    SELECT s0 AS source, v AS target, round(d, 6) AS distance, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY s0, v ORDER BY round(d, 9), sim DESC) AS r FROM p) WHERE r = 1"""
)
def path_similarity(spark, sf):
    nation = _table(spark, sf, "nation")
    edges = nation.select(F.col("n_nationkey").alias("src"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).select("src", ((F.col("src") + F.col("k")) % 25).alias("dst"), (0.5 + 0.1 * F.col("k")).alias("weight"))
    out = graph.path_similarities(edges, nation.select("n_nationkey"), cutoff=1.0000001)
    return out.select("source", "target", _r("distance"), _r("similarity"))


# Exports


def _d3(spark, sf):
    from kinweave.sources.sinks import graph_nodes_links

    names = _table(spark, sf, "part").select(F.col("p_brand").alias("concept_id"), F.lower("p_brand").alias("label")).distinct()
    return graph_nodes_links(_edges(spark, sf), names, top=40)


_D3 = f"WITH {_EDGES}, k AS (SELECT * FROM e ORDER BY w DESC, src, dst LIMIT 40), v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM (SELECT src AS v FROM k UNION SELECT dst FROM k))"


@_query(f'{_D3} SELECT place AS "at", lower(v) AS name, 0::BIGINT AS "group" FROM v')
def graph_json_nodes(spark, sf):
    return _d3(spark, sf)[0]


@_query(f"{_D3} SELECT a.place AS source, b.place AS target, round(w, 6) AS value FROM k JOIN v a ON a.v = src JOIN v b ON b.v = dst")
def graph_json_links(spark, sf):
    return _d3(spark, sf)[1].select("source", "target", _r("value"))
