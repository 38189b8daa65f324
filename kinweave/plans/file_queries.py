"""Registered queries over readers and writers: what is written to the shared folder is read back, and SQL says what comes.

Lines are made from whole tables; a file whose order matters is written as one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.ids import AND_START, OR_START, RECURRENT_START, is_and, is_basic, is_or, is_recurrent
from kinweave.operators import clustering, contexts, counts, graph, stats
from kinweave.operators.clustering import Parameters
from kinweave.plans.queries import _D3, _EDGES, _PAIRS, _REP, _TOP, _baskets, _bigrams, _d3, _edges, _parts, _pruned, _query, _r, _ratings, _table
from kinweave.runtime import exists, new_folder, remove
from kinweave.sources import readers, sinks
from kinweave.sources.workspace import Workspace


def _file(rows: DataFrame, name: str, single: bool = False) -> str:
    path = new_folder(rows.sparkSession, name)
    sinks.write_text(rows, path, single=single)
    return path


def _lines(df: DataFrame, *parts, sep: str = "") -> DataFrame:
    """(value): `parts` of each row as text, joined; null parts are empty."""
    texts = [F.coalesce(x.cast("string"), F.lit("")) for x in parts]
    return df.select(F.concat_ws(sep, *texts).alias("value"))


def _labels(spark, sf) -> DataFrame:
    """Brands by their number."""
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    return _table(spark, sf, "part").select(number.alias("concept_id"), F.lower("p_brand").alias("label")).distinct()


def _brand_names(spark, sf) -> DataFrame:
    return _table(spark, sf, "part").select(F.col("p_brand").alias("concept_id"), F.lower("p_brand").alias("label")).distinct()


def _fields(rows: DataFrame, sep: str, *names: str) -> DataFrame:
    f = F.split("value", sep)
    return rows.select(*[f[i].alias(n) for i, n in enumerate(names)])


# Readers


@_query("SELECT s_suppkey::BIGINT AS a, s_nationkey::BIGINT AS b, s_acctbal AS w FROM supplier")
def file_text_dataset(spark, sf):
    rows = _table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return readers.text_dataset(spark, _file(sinks.text_rows(rows), "supplier"), "a long, b long, w double")


@_query("SELECT count(*) AS n, 'none' AS missing, (SELECT count(*) FROM lineitem)::VARCHAR AS whole FROM lineitem")
def file_scalar(spark, sf):
    path = new_folder(spark, "scalar")
    sinks.write_scalar(spark, _table(spark, sf, "lineitem").count(), path)
    missing = readers.scalar(spark, path + "-not-there") or "none"
    whole = readers.whole_file(spark, path).strip()
    return spark.createDataFrame([(int(readers.scalar(spark, path)), missing, whole)], "n long, missing string, whole string")


@_query("SELECT p_partkey, p_brand, p_retailprice FROM part")
def file_parquet_dataset(spark, sf):
    path = new_folder(spark, "part")
    _table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice").write.parquet(path)
    return readers.parquet_dataset(spark, path)


@_query("SELECT true AS before, false AS after, true AS missing_is_none")
def file_exists_and_delete(spark, sf):
    path = _file(_lines(_table(spark, sf, "nation"), F.col("n_name")), "gone")
    before = exists(spark, path)
    remove(spark, path)
    return spark.createDataFrame([(before, exists(spark, path), readers.parquet_dataset(spark, path) is None)], "before boolean, after boolean, missing_is_none boolean")


@_query("SELECT t AS token, count(*) AS n FROM (SELECT unnest(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS t FROM part) GROUP BY t")
def file_tokenised_lines(spark, sf):
    rows = readers.tokenised_lines(spark, _file(_lines(_table(spark, sf, "part"), F.col("p_name"), sep="  "), "lines"))
    return contexts.indexed(rows, "context_id", "tokens").groupBy(F.col("concept_id").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT p_partkey AS concept_id, p_brand AS label FROM part")
def file_dictionary(spark, sf):
    return readers.dictionary(spark, _file(_lines(_table(spark, sf, "part"), F.col("p_partkey"), F.col("p_brand"), sep=" "), "dictionary"))


@_query("SELECT p_name AS ngram, count(*) AS n FROM part GROUP BY 1")
def file_ngrams(spark, sf):
    counted = _table(spark, sf, "part").groupBy(F.split("p_name", " ").alias("tokens")).agg(F.count(F.lit(1)).alias("n"))
    rows = readers.ngram_file(spark, _file(sinks.ngram_lines(counted).unionByName(spark.createDataFrame([("x,malformed",)], "value string")), "ngrams"))
    return rows.select(F.array_join("tokens", " ").alias("ngram"), "n")


@_query("SELECT p_partkey AS src, (p_size + 100000)::BIGINT AS dst, p_retailprice AS weight FROM part")
def file_graph_edges(spark, sf):
    part = _table(spark, sf, "part")
    return readers.graph_edges(spark, _file(_lines(part, F.lit("(("), F.col("p_partkey"), F.lit(", "), F.col("p_size") + 100000, F.lit("),"), F.col("p_retailprice"), F.lit(")")), "edges"))


@_query("SELECT p_partkey AS id, p_name AS label, p_retailprice AS weight FROM part")
def file_graph_vertices(spark, sf):
    part = _table(spark, sf, "part")
    return readers.graph_vertices(spark, _file(_lines(part, F.lit("("), F.col("p_partkey"), F.lit(", "), F.col("p_name"), F.lit(","), F.col("p_retailprice"), F.lit(")")), "vertices"))


@_query("SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2")
def file_bigrams(spark, sf):
    lines = sinks.pair_lines(_bigrams(spark, sf)).unionByName(spark.createDataFrame([("malformed",), ("x,a,b",)], "value string"))
    return readers.bigram_file(spark, _file(lines, "bigrams"))


@_query("SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2")
def file_bigrams_count_last(spark, sf):
    return readers.bigram_file(spark, _file(sinks.text_rows(_bigrams(spark, sf).select("a", "b", "n"), ","), "bigrams"), count_last=True)


@_query("SELECT p_name AS text, count(*) AS n FROM part WHERE p_size % 3 < 2 GROUP BY 1")
def file_tweets(spark, sf):
    mark = F.when(F.col("p_size") % 3 == 0, "Text: ").when(F.col("p_size") % 3 == 1, "Origin: ").otherwise("Time: ")
    return readers.tweets(spark, _file(_lines(_table(spark, sf, "part"), mark, F.col("p_name")), "tweets")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT lower(p_name) AS ngram, sum(p_size)::BIGINT AS n FROM part WHERE p_size % 7 <> 0 AND contains(p_name, ' ') GROUP BY 1")
def file_yearly_ngrams(spark, sf):
    name = F.when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit("_NOUN"))).otherwise(F.col("p_name"))
    rows = readers.yearly_ngrams(spark, _file(_lines(_table(spark, sf, "part"), name, F.col("p_size") + 1950, F.col("p_size"), F.lit(1), sep="\t"), "yearly"))
    return rows.select(F.array_join("tokens", " ").alias("ngram"), "n")


@_query("SELECT lower(p_brand) AS a, lower(p_type) AS b, p_retailprice AS score FROM part")
def file_word_pairs(spark, sf):
    part = _table(spark, sf, "part")
    path = _file(_lines(part, F.lower("p_brand"), F.concat(F.lit(" "), F.lower("p_type")), F.col("p_retailprice"), sep=","), "pairs")
    return readers.word_pairs(spark, path, "MTURK-771").unionByName(readers.word_pairs(spark, path, "of no known name"))


@_query("SELECT p_brand AS class_id, t AS token, count(*) AS n FROM (SELECT p_brand, unnest(list_distinct(string_split(p_name || ' ' || p_name, ' '))) AS t FROM part) GROUP BY 1, 2")
def file_labelled_examples(spark, sf):
    rows = readers.labelled_examples(spark, _file(_lines(_table(spark, sf, "part"), F.col("p_brand"), F.concat_ws(" ", "p_name", "p_name"), sep="\t"), "examples"))
    return rows.select("class_id", F.explode("tokens").alias("token")).groupBy("class_id", "token").agg(F.count(F.lit(1)).alias("n"))


_RATED = "SELECT event_id AS item, floor(value / 20)::INT AS rating, (ts::DATE - DATE '1970-01-01')::INT AS day, strftime(ts, '%H:%M') AS time, user_id AS \"user\" FROM events"


def _rated(spark, sf) -> DataFrame:
    return _ratings(spark, sf).join(_table(spark, sf, "events").select(F.col("event_id").alias("item"), F.date_format("ts", "HH:mm").alias("time")), "item")


@_query(_RATED)
def file_ratings(spark, sf):
    rows = _rated(spark, sf)
    return readers.ratings(spark, _file(_lines(rows, *[F.col(c) for c in ("item", "rating", "day", "time", "user")], sep="\t"), "ratings"))


@_query(_RATED)
def file_rating_blocks(spark, sf):
    """Blocks of a user's header and lines, one file a range of users."""
    rows = _rated(spark, sf)
    heads = rows.groupBy("user").agg(F.count(F.lit(1)).alias("n")).select("user", F.lit(-1).cast("long").alias("item"), F.concat_ws("|", "user", "n").alias("value"))
    own = rows.select("user", "item", F.concat_ws("\t", *[F.col(c).cast("string") for c in ("item", "rating", "day", "time")]).alias("value"))
    lines = heads.unionByName(own).repartitionByRange(4, "user").sortWithinPartitions("user", "item").select("value")
    return readers.rating_blocks(spark, _file(lines, "blocks"))


@_query("SELECT p_partkey AS track_id, CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT END AS album_id, (p_size + 1000)::BIGINT AS artist_id, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 2 END AS n_genres, p_size::BIGINT AS first_genre FROM part")
def file_hierarchy(spark, sf):
    album = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("None")
    second = F.when(F.col("p_size") % 5 == 0, "None").otherwise("77")
    rows = readers.hierarchy(spark, _file(_lines(_table(spark, sf, "part"), F.col("p_partkey"), album, F.col("p_size") + 1000, F.col("p_size"), second, sep="|"), "tracks"))
    return rows.select("track_id", "album_id", "artist_id", F.size("genres").alias("n_genres"), F.get("genres", 0).alias("first_genre"))


@_query(f"{_D3} SELECT lower(src) AS src, lower(dst) AS dst, round(w, 6) AS weight FROM k WHERE w > 0 AND w < 1")
def file_graph_json(spark, sf):
    return readers.graph_json(spark, _file(sinks.graph_json(*_d3(spark, sf)), "json", single=True)).select("src", "dst", _r("weight"))


@_query(f"WITH {_EDGES} SELECT src, dst, round(w, 6) AS weight FROM e WHERE w > 0 AND w < 1")
def file_graph_text(spark, sf):
    lines = _lines(_edges(spark, sf), F.col("weight"), F.col("src"), F.col("dst"), sep=" ").withColumn("k", F.lit(0))
    after = spark.createDataFrame([("", 1), ("0.5 behind theend", 2)], "value string, k int")
    rows = lines.unionByName(after).repartition(1).sortWithinPartitions("k").select("value")
    return readers.graph_text(spark, _file(rows, "graph", single=True)).select("src", "dst", _r("weight"))


def _products(spark, sf):
    part = _table(spark, sf, "part")
    at = lambda k, *x: part.select("p_partkey", F.lit(k).alias("k"), F.concat(*x).alias("value"))
    lines = at(0, F.lit("Id:   "), F.col("p_partkey").cast("string")).unionByName(at(1, F.lit("  title: "), F.col("p_name")))
    lines = lines.unionByName(at(2, F.lit("   |A[9000]|B["), (F.col("p_size") + 9100).cast("string"), F.lit("]|C["), (F.col("p_partkey") + 10000).cast("string"), F.lit("]")))
    return readers.product_metadata(spark, _file(lines.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey", "k").select("value"), "products"))


@_query("SELECT p_partkey::VARCHAR AS id, p_name AS title FROM part")
def file_product_items(spark, sf):
    return _products(spark, sf)[0]


@_query("SELECT DISTINCT (p_size + 9100)::VARCHAR AS child, '9000' AS parent FROM part UNION SELECT (p_partkey + 10000)::VARCHAR, (p_size + 9100)::VARCHAR FROM part")
def file_product_parents(spark, sf):
    return _products(spark, sf)[1]


@_query("WITH p AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part UNION SELECT DISTINCT p_type, p_brand FROM part) SELECT a, b FROM p WHERE a <> b")
def file_interaction_pairs(spark, sf):
    part = _table(spark, sf, "part")
    other = F.when(F.col("p_size") == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    same = _lines(part, F.col("p_brand"), F.lit("x"), F.lit("y"), F.col("p_brand"), sep="\t")
    return readers.interaction_pairs(spark, _file(_lines(part, F.col("p_brand"), F.lit("x"), F.lit("y"), other, sep="\t").unionByName(same), "pairs"))


# Workspaces


@_query("SELECT 'concepts' AS name, (SELECT count(DISTINCT p_brand) FROM part) AS n, 'Parquet' AS form UNION ALL SELECT 'contexts', (SELECT count(*) FROM lineitem), 'Parquet' UNION ALL SELECT 'concepts', (SELECT count(DISTINCT p_brand) FROM part), 'text' UNION ALL SELECT 'contexts', (SELECT count(*) FROM lineitem), 'text'")
def workspace_written_and_loaded(spark, sf):
    """Contexts are replaced by a second write, concepts stay as they were; missing datasets are not listed."""
    out = []
    for form in ("parquet", "text"):
        path = new_folder(spark, "workspace")
        numbers = _baskets(spark, sf).select("context_id", F.regexp_extract("concept_id", "([0-9]+)", 1).cast("long").alias("concept_id"))
        labels = _labels(spark, sf).withColumn("label", F.regexp_replace("label", " ", "_"))
        ws = Workspace(spark, path, form).write(concepts=labels, contexts=numbers.limit(1))
        ws.write(contexts=numbers)
        again = Workspace.load(spark, path, form)
        out += [(name, again[name].count(), "Parquet" if form == "parquet" else form) for name in ("concepts", "contexts", "count", "similarities") if again[name] is not None]
    return spark.createDataFrame(out, "name string, n long, form string")


@_query("SELECT 'concepts' AS name, 5::BIGINT AS n UNION ALL SELECT 'count', 1")
def workspace_inspect(spark, sf):
    ws = Workspace(spark, new_folder(spark, "workspace")).write(concepts=_labels(spark, sf), count=spark.createDataFrame([(1,)], "n long"))
    return spark.createDataFrame([(k, len(v)) for k, v in ws.inspect(5).items() if v is not None], "name string, n long")


@_query("SELECT 3::BIGINT AS iterations, 'false' AS weighted, true AS has_time")
def workspace_parameters(spark, sf):
    ws = Workspace(spark, new_folder(spark, "workspace"))
    ws.write_parameters(Parameters(iterations=3, weighted=False))
    rows = spark.read.schema("time string, iterations long, weighted string").json(f"{ws.path}/parameters")
    return rows.select("iterations", "weighted", F.col("time").isNotNull().alias("has_time"))


# Writers


@_query(f"WITH {_EDGES}, k AS (SELECT * FROM e ORDER BY w DESC, src, dst LIMIT 30) SELECT round(w, 6) AS weight, lower(src) AS a, lower(dst) AS b FROM k")
def lines_top_edges(spark, sf):
    rows = spark.read.text(_file(sinks.top_edge_lines(_edges(spark, sf), _brand_names(spark, sf), 30), "edges", single=True))
    return _fields(rows, " ", "weight", "a", "b").withColumn("weight", F.round(F.col("weight").cast("double"), 6))


_MUTUAL = f"WITH {_EDGES}, b2 AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM e) WHERE r = 1), mm AS (SELECT x.src AS a, x.dst AS b FROM b2 x JOIN b2 y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst)"


@_query(f"{_MUTUAL} SELECT (row_number() OVER (ORDER BY a, b) - 1) || ': ' || lower(a) || ' ' || lower(b) AS value FROM mm")
def lines_clusters(spark, sf):
    return sinks.cluster_lines(clustering.mutual_max(_edges(spark, sf)), _brand_names(spark, sf))


@_query("SELECT lower(p_brand) || ' ' || count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def lines_counts(spark, sf):
    return sinks.count_lines(counts.concept_counts(_baskets(spark, sf)), _brand_names(spark, sf))


@_query(f"WITH {_REP} SELECT DISTINCT lower(c) || '^' || m AS value FROM q WHERE m > 1")
def lines_recurrent(spark, sf):
    from kinweave.operators.concepts import find_recurrent

    return sinks.recurrent_lines(find_recurrent(_baskets(spark, sf)), _brand_names(spark, sf))


@_query("SELECT l_orderkey || ': ' || string_agg(lower(p_brand), ' ' ORDER BY lower(p_brand)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def lines_contexts(spark, sf):
    return sinks.context_lines(_baskets(spark, sf), _brand_names(spark, sf))


_NAMED = "WITH b AS (SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS k, lower(p_brand) AS l FROM part), a AS (SELECT k % 4 AS m, '[' || string_agg(l, ',' ORDER BY l) || ']' AS l FROM b GROUP BY 1)"


def _levels(spark, sf) -> DataFrame:
    """Brands in four AND concepts, these in two OR concepts, these and an unknown id in one OR concept."""
    ands = _labels(spark, sf).select(F.col("concept_id").alias("child_id"), (F.col("concept_id") % 4 + AND_START).alias("parent_id"))
    ors = ands.select(F.col("parent_id").alias("child_id"), ((F.col("parent_id") - AND_START) % 2 + OR_START).alias("parent_id")).distinct()
    top = ors.select(F.col("parent_id").alias("child_id"), F.lit(OR_START + 2).alias("parent_id")).distinct()
    return ands.unionByName(ors).unionByName(top).unionByName(spark.createDataFrame([(99999, OR_START + 2)], "child_id long, parent_id long"))


@_query(
    f"""{_NAMED}, o AS (SELECT m % 2 AS m, '(' || string_agg(l, ',' ORDER BY l) || ')' AS l FROM a GROUP BY 1), t AS (SELECT '(' || string_agg(l, ',' ORDER BY l) || ')' AS l FROM (SELECT l FROM o UNION ALL SELECT '<99999>'))
    SELECT m + {AND_START} AS concept_id, l AS name FROM a UNION ALL SELECT m + {OR_START}, l FROM o UNION ALL SELECT {OR_START + 2}, l FROM t"""
)
def names_nested(spark, sf):
    return sinks.nested_names(_labels(spark, sf), _levels(spark, sf)).where(F.col("concept_id") >= AND_START)


@_query("SELECT 15::BIGINT AS n_levels, 1::BIGINT AS n_tops, (2 * (25 + 1) + 10)::BIGINT AS longest")
def names_of_many_levels(spark, sf):
    """A chain of 25 OR levels over two basic concepts: every level has a name."""
    base = spark.createDataFrame([(1, "aaaaa"), (2, "bbbb")], "concept_id long, label string")
    chain = [(1, OR_START), (2, OR_START)] + [(OR_START + k, OR_START + k + 1) for k in range(25)]
    names = sinks.nested_names(base, spark.createDataFrame(chain, "child_id long, parent_id long"))
    high = names.where(F.col("concept_id") > OR_START + 10)
    return high.agg(F.count(F.lit(1)).alias("n_levels"), F.count_if(F.col("concept_id") == OR_START + 25).alias("n_tops"), F.max(F.length("name")).cast("long").alias("longest"))


@_query("WITH b AS (SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS k, lower(p_brand) AS l FROM part) SELECT k % 4 + 200000000000 AS parent_id, string_agg(l, ' ' ORDER BY l) AS names FROM b GROUP BY 1")
def names_one_level(spark, sf):
    return sinks.one_level_names(_labels(spark, sf), _levels(spark, sf))[0]


@_query(f"{_NAMED} SELECT round(1 / (1 + x.m + 10.0 * y.m), 6) AS weight, x.l AS a, y.l AS b FROM a x JOIN a y ON x.m < y.m")
def lines_nested_edges(spark, sf):
    names = sinks.nested_names(_labels(spark, sf), _levels(spark, sf))
    ids = spark.range(4).select((F.col("id") + AND_START).alias("src"))
    edges = ids.join(ids.select(F.col("src").alias("dst")), F.col("src") < F.col("dst")).withColumn("weight", 1 / (1 + F.col("src") - AND_START + 10.0 * (F.col("dst") - AND_START)))
    return _fields(sinks.nested_edge_lines(edges, names, 10), "\t", "weight", "a", "b").withColumn("weight", F.round(F.col("weight").cast("double"), 6))


@_query("WITH t AS (SELECT n_nationkey // 2 AS k, '(' || string_agg(n_name || ':0.25', ',' ORDER BY n_nationkey) || ')' AS t FROM nation WHERE n_nationkey < 24 GROUP BY 1), u AS (SELECT k // 2 AS k, '(' || string_agg(t || ':0.5', ',' ORDER BY k) || ')' AS t FROM t GROUP BY 1) SELECT 300000000000 + k AS concept_id, t || ';' AS tree FROM t UNION ALL SELECT 300000000100 + k, t || ';' FROM u")
def trees_newick(spark, sf):
    nation = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("concept_id"), F.col("n_name").alias("label"))
    low = nation.where("concept_id < 24").select(F.col("concept_id").alias("child_id"), (F.floor(F.col("concept_id") / 2) + OR_START).alias("parent_id"))
    high = low.select(F.col("parent_id").alias("child_id"), (F.floor((F.col("parent_id") - OR_START) / 2) + OR_START + 100).alias("parent_id")).distinct()
    both = low.unionByName(high)
    sims = both.groupBy("parent_id").agg(F.min("child_id").alias("src"), F.max("child_id").alias("dst")).select("src", "dst", F.when(F.col("src") < 100, 0.75).otherwise(0.5).alias("weight"))
    return sinks.newick(both, sims, nation)


@_query(f"WITH {_TOP} SELECT lower(src) AS v, round(w, 6) AS w, 'edge' AS kind, lower(dst) AS x FROM r UNION ALL SELECT src, 0, 'vertex', lower(src) FROM (SELECT DISTINCT src FROM r)")
def lines_cluster_csv(spark, sf):
    data = _pruned(spark, sf).weights
    own = data.select(F.col("src").alias("concept_id")).distinct().withColumn("cluster_id", F.lit(0).cast("long"))
    vertices, edges = sinks.cluster_csv(data.withColumns({"src": F.lower("src"), "dst": F.lower("dst")}), _brand_names(spark, sf), own)
    e = _fields(edges, ",", "v", "x", "w").select("v", F.round(F.col("w").cast("double"), 6).alias("w"), F.lit("edge").alias("kind"), "x")
    return e.unionByName(_fields(vertices, ",", "v", "x", "w").select("v", F.col("w").cast("double").alias("w"), F.lit("vertex").alias("kind"), "x"))


@_query(f"WITH {_TOP}, o AS (SELECT src AS v, count(*) AS n FROM r GROUP BY 1), i AS (SELECT dst AS v, count(*) AS n FROM r GROUP BY 1) SELECT tot.src AS vertex, coalesce(o.n, 0)::BIGINT AS out_degree, coalesce(i.n, 0)::BIGINT AS in_degree, round(coalesce(kept, 0), 6) AS kept, round(total - coalesce(kept, 0), 6) AS discarded FROM tot LEFT JOIN kept USING (src) LEFT JOIN o ON o.v = tot.src LEFT JOIN i ON i.v = tot.src")
def vertex_statistics(spark, sf):
    data = _pruned(spark, sf)
    return sinks.vertex_statistics(data.weights, data.sums).select("vertex", "out_degree", "in_degree", _r("kept"), _r("discarded"))


@_query(f"WITH {_TOP}, k AS (SELECT * FROM sim ORDER BY s DESC, i, j LIMIT 25) SELECT round(s, 6) AS weight, lower(i) AS a, lower(j) AS b FROM k")
def similarity_ranking(spark, sf):
    return sinks.ranking(graph.similarities(_pruned(spark, sf), None), _brand_names(spark, sf), 25).select(_r("weight"), F.col("src_label").alias("a"), F.col("dst_label").alias("b"))


@_query(f"WITH {_TOP} SELECT (SELECT count(*) FROM r) AS n_edges, round((SELECT avg(w) FROM r), 6) AS weight_mean, round((SELECT stddev_pop(w) FROM r), 6) AS weight_stdev")
def statistics_json(spark, sf):
    rows = sinks.statistics_json(stats.graph_statistics(_pruned(spark, sf).weights))
    j = F.from_json("value", "n_edges long, weight_mean double, weight_stdev double")
    return rows.select(j.alias("j")).select("j.n_edges", F.round("j.weight_mean", 6).alias("weight_mean"), F.round("j.weight_stdev", 6).alias("weight_stdev"))


@_query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 8), 7)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) SELECT string_agg(coalesce(n, 0)::VARCHAR, ' ' ORDER BY k) AS value FROM (SELECT unnest(generate_series(0, 7)) AS k) LEFT JOIN b ON b.bin = k")
def lines_histogram(spark, sf):
    rows = sinks.histogram_lines(stats.histogram(_table(spark, sf, "lineitem"), "l_extendedprice", 8))
    return rows.where(~F.contains("value", F.lit(".")))


# Small operators of rows, ids and edges


@_query("SELECT l_orderkey AS context_id, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_partkey) AS concepts FROM lineitem GROUP BY 1")
def contexts_collected(spark, sf):
    there = contexts.collected(_parts(spark, sf))
    back = contexts.collected(contexts.indexed(there.withColumn("context_id", F.col("context_id") - 7), "context_id", "concepts", offset=7))
    return back.select("context_id", F.array_join(F.transform("concepts", lambda c: c.cast("string")), " ").alias("concepts"))


@_query(f"WITH {_TOP} SELECT src AS vertex FROM r UNION SELECT dst FROM r")
def vertex_set(spark, sf):
    return graph.vertices_of(_pruned(spark, sf).weights)


_IDS = [("p_partkey", 0), ("p_partkey", RECURRENT_START), ("p_partkey", AND_START), ("p_partkey", OR_START)]


@_query("SELECT (SELECT count(*) FROM part) AS basic, (SELECT count(*) FROM part) AS recurrent, (SELECT count(*) FROM part) AS ands, (SELECT count(*) FROM part) AS ors")
def id_kinds(spark, sf):
    part = _table(spark, sf, "part")
    ids = part.select(F.explode(F.array(*[F.col(c) + F.lit(start) for c, start in _IDS])).alias("id"))
    i = F.col("id")
    return ids.agg(F.count_if(is_basic(i)).alias("basic"), F.count_if(is_recurrent(i)).alias("recurrent"), F.count_if(is_and(i)).alias("ands"), F.count_if(is_or(i)).alias("ors"))


@_query(f"WITH {_EDGES} SELECT src, dst, round(w ** 3 / (w ** 3 + (1 - w) ** 3), 6) AS weight FROM e")
def saturated_weights(spark, sf):
    return _edges(spark, sf).select("src", "dst", F.round(graph.saturated(F.col("weight"), 3.0), 6).alias("weight"))


@_query(f"WITH {_TOP} SELECT lower(src) AS a, lower(dst) AS b, round(w, 6) AS weight FROM r")
def labelled_edges(spark, sf):
    return graph.labelled(_pruned(spark, sf).weights, _brand_names(spark, sf)).select(F.col("src_label").alias("a"), F.col("dst_label").alias("b"), _r("weight"))


@_query(f"WITH {_TOP}, s AS (SELECT i, j, s FROM sim WHERE s > 0.1) SELECT i AS src, j AS dst, round(s, 6) AS weight FROM s UNION ALL SELECT j, i, round(s, 6) FROM s")
def similarity_both_ways(spark, sf):
    return graph.both_ways(graph.similarities(_pruned(spark, sf), 0.1)).select("src", "dst", _r("weight"))


@_query(f"WITH {_EDGES} SELECT src, round(sum(w), 6) AS kept, round(coalesce(sum(w) FILTER (w < 0.16 AND src < 'Brand#2'), 0), 6) AS discarded FROM e GROUP BY src")
def edge_data_merged(spark, sf):
    """Sums of two halves of a graph, one of them pruned, added up; kept plus discarded is each vertex's whole weight."""
    edges = _edges(spark, sf)
    first = graph.prune(graph.EdgeData.of(edges.where("src < 'Brand#2'")), min_weight=0.16)
    both = first.merged(graph.EdgeData.of(edges.where("src >= 'Brand#2'")))
    return both.sums.select("src", F.round(F.col("kept") + F.col("discarded"), 6).alias("kept"), _r("discarded"))


@_query("SELECT lower(p_brand) AS a, lower(p_type) AS b, count(*) AS n FROM (SELECT regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS p_brand, p_type FROM part WHERE p_size % 2 = 0) WHERE regexp_full_match(p_type, '[A-Za-z]+') GROUP BY 1, 2")
def bigrams_cleaned(spark, sf):
    part = _table(spark, sf, "part")
    a = F.when(F.col("p_size") % 2 == 0, F.regexp_replace("p_brand", "[^A-Za-z]", "")).otherwise("x")
    return readers.clean_bigrams(part.select(a.alias("a"), F.col("p_type").alias("b"), F.lit(1).cast("long").alias("n")))


@_query("SELECT lower(p_brand) AS a, lower(p_type) AS b, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY 1, 2")
def bigrams_untagged(spark, sf):
    b = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit("_NOUN"))).otherwise(F.concat("p_type", F.lit(",")))
    return readers.untagged_bigrams(_table(spark, sf, "part").select(F.col("p_brand").alias("a"), b.alias("b"), F.lit(1).cast("long").alias("n")))


@_query("WITH w AS (SELECT p_partkey AS id, string_split(p_name || ' ' || p_type, ' ') AS t FROM part), s AS (SELECT id, unnest(generate_series(1, len(t))) AS p, t FROM w), x AS (SELECT s.id, s.t[s.p] AS a, z.t[z.p] AS b FROM s JOIN s z ON s.id = z.id AND z.p > s.p AND z.p - s.p < 3) SELECT a, b, count(*) AS n FROM (SELECT id, a, b FROM x UNION SELECT id, b, a FROM x) GROUP BY 1, 2")
def window_pair_counts(spark, sf):
    rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("t"))
    return contexts.window_pairs(rows, "id", "t", 3).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT p_partkey AS item, p_size AS rating FROM part WHERE p_size <= 10")
def items_of_type(spark, sf):
    part = _table(spark, sf, "part")
    kinds = part.select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") <= 10, "track").otherwise("album").alias("kind"))
    return contexts.of_type(part.select(F.col("p_partkey").alias("item"), F.col("p_size").alias("rating")), kinds, "track")


@_query("SELECT p_partkey AS track_id, CASE WHEN p_size > 5 THEN p_brand END AS artist_id FROM part")
def artists_of_tracks(spark, sf):
    part = _table(spark, sf, "part")
    return contexts.artist_of(part.select(F.col("p_partkey").alias("track_id")), part.where("p_size > 5").select(F.col("p_partkey").alias("track_id"), F.col("p_brand").alias("artist_id")))


@_query(f"WITH {_PAIRS} SELECT i, j, nij AS n FROM t")
def pair_counts_read_back(spark, sf):
    pairs = counts.pair_counts(_baskets(spark, sf)).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("n_ij").alias("n"))
    return readers.bigram_file(spark, _file(sinks.pair_lines(pairs), "pairs")).select(F.col("a").alias("i"), F.col("b").alias("j"), "n")
