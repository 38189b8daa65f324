"""Writers: text, single files, D3 and Gephi graphs, labels, nested concepts, Newick trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.ids import is_and, is_or
from kinweave.operators.contexts import ranked
from kinweave.operators.graph import degrees, labelled, top_edges
from kinweave.runtime import spool


def text_rows(df: DataFrame, sep: str = " ") -> DataFrame:
    """(value): the columns of each row joined by `sep`; null is empty."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def write_text(rows: DataFrame, path: str, single: bool = False, compress: bool = False) -> None:
    """One column of lines, replacing what is there; `single` makes one part."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_scalar(spark, value, path: str) -> None:
    write_text(spark.createDataFrame([(str(value),)], "value string"), path, single=True)


def ngram_lines(counted: DataFrame) -> DataFrame:
    """`count,tok,tok` lines of (tokens, n)."""
    return counted.select(F.concat_ws(",", F.col("n").cast("string"), F.array_join("tokens", ",")).alias("value"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    """`count,a,b` lines of (a, b, n)."""
    return text_rows(pairs.select("n", "a", "b"), ",")


def graph_nodes_links(edges: DataFrame, concepts: DataFrame, clusters: DataFrame | None = None, min_weight: float = float("-inf"), top: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the `top` strongest edges: nodes (at, name, group) numbered densely by id, links (source, target,
    value). With clusters, a node's group is its least cluster, and vertices without one vanish with their links."""
    kept = top_edges(edges.where(F.col("weight") >= min_weight), top)
    ids = kept.select(F.explode(F.array("src", "dst")).alias("concept_id")).distinct().join(concepts, "concept_id", "left")
    groups = clusters.groupBy("concept_id").agg(F.min("cluster_id").alias("group")) if clusters is not None else None
    ids = ids.join(groups, "concept_id") if groups is not None else ids.withColumn("group", F.lit(0).cast("long"))
    nodes = spool(ranked(ids, ["concept_id"], "at"), "nodes")
    end = lambda c, k: nodes.select(F.col("concept_id").alias(c), F.col("at").alias(k))
    links = kept.join(end("src", "source"), "src").join(end("dst", "target"), "dst").select("source", "target", F.col("weight").alias("value"))
    return nodes.select("at", F.coalesce("label", F.col("concept_id").cast("string")).alias("name"), "group"), links


def graph_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(value): one D3 document of a graph that `top` has bounded."""
    n = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "group"))), lambda x: F.struct(x["name"].alias("name"), x["group"].alias("group"))).alias("nodes"))
    k = links.agg(F.array_sort(F.collect_list(F.struct("source", "target", "value"))).alias("links"))
    return n.crossJoin(k).select(F.to_json(F.struct("nodes", "links")).alias("value"))  # one row each


def cluster_csv(edges: DataFrame, concepts: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) as comma-separated lines for graph tools: Id,Label,Cluster and Source,Target,Weight."""
    v = clusters.join(concepts, "concept_id", "left").select("concept_id", F.coalesce("label", F.col("concept_id").cast("string")).alias("label"), "cluster_id")
    return text_rows(v, ","), text_rows(edges.select("src", "dst", "weight"), ",")


def top_edge_lines(edges: DataFrame, concepts: DataFrame, n: int) -> DataFrame:
    """`weight labelI labelJ`, strongest first."""
    named = labelled(top_edges(edges, n), concepts).orderBy(F.desc("weight"), "src", "dst")
    return text_rows(named.select("weight", "src_label", "dst_label"))


def _name(df: DataFrame, concepts: DataFrame, key: str = "concept_id") -> DataFrame:
    names = concepts.select(F.col("concept_id").alias(key), F.col("label").alias("name"))
    return df.join(names, key, "left").withColumn("name", F.coalesce("name", F.col(key).cast("string")))


def cluster_lines(clusters: DataFrame, concepts: DataFrame) -> DataFrame:
    """`cluster: label label`."""
    g = _name(clusters, concepts).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))
    return g.select(F.concat_ws(": ", F.col("cluster_id").cast("string"), "names").alias("value"))


def count_lines(counts: DataFrame, concepts: DataFrame) -> DataFrame:
    """`label n`."""
    return text_rows(_name(counts, concepts).select("name", "n"))


def recurrent_lines(recurrent: DataFrame, concepts: DataFrame) -> DataFrame:
    """`label^n`."""
    return _name(recurrent, concepts).select(F.concat_ws("^", "name", F.col("n").cast("string")).alias("value"))


def context_lines(contexts: DataFrame, concepts: DataFrame) -> DataFrame:
    """`id: label label`, ordered by id."""
    g = _name(contexts, concepts).groupBy("context_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))
    return g.orderBy("context_id").select(F.concat_ws(": ", F.col("context_id").cast("string"), "names").alias("value"))


def _shown(parent: Column, parts: Column) -> Column:
    inner = F.array_join(parts, ",")
    return F.when(is_and(parent), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.concat(F.lit("("), inner, F.lit(")")))


def nested_names(concepts: DataFrame, groups: DataFrame, recurrent: DataFrame | None = None) -> DataFrame:
    """(concept_id, name) of basic, recurrent and grouped concepts: AND as [a,b], OR as (a,b), a recurrence as label^n, an
    unknown member as <id>. `groups` has child_id and parent_id of both kinds. Names grow a level a round, by joins, until none
    is new."""
    names = concepts.select("concept_id", F.col("label").alias("name"))
    if recurrent is not None:
        r = recurrent.join(names, "concept_id", "left").select(F.col("rec_id").alias("concept_id"), F.concat(F.coalesce("name", F.concat(F.lit("<"), F.col("concept_id").cast("string"), F.lit(">"))), F.lit("^"), F.col("n").cast("string")).alias("name"))
        names = names.unionByName(r)
    parents = groups.select(F.col("parent_id").alias("concept_id")).distinct()
    lost = groups.select(F.col("child_id").alias("concept_id")).distinct().join(names, "concept_id", "left_anti").join(parents, "concept_id", "left_anti")
    names = spool(names.unionByName(lost.select("concept_id", F.concat(F.lit("<"), F.col("concept_id").cast("string"), F.lit(">")).alias("name"))), "names")
    open_ = groups
    while True:
        met = open_.join(names, open_["child_id"] == names["concept_id"], "left")
        grown = met.groupBy("parent_id").agg(F.array_sort(F.collect_list("name")).alias("parts"), F.count(F.lit(1)).alias("n")).where(F.size("parts") == F.col("n"))
        grown = spool(grown.select(F.col("parent_id").alias("concept_id"), _shown(F.col("parent_id"), F.col("parts")).alias("name")), "names")
        if grown.isEmpty():
            break
        names = names.unionByName(grown)
        open_ = spool(open_.join(grown.select(F.col("concept_id").alias("parent_id")), "parent_id", "left_anti"), "open")
    return names


def one_level_names(concepts: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(and_names, or_names): (parent_id, names) of members' labels one level down."""
    named = _name(groups.withColumnRenamed("child_id", "concept_id"), concepts).groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))
    return named.where(is_and(F.col("parent_id"))), named.where(is_or(F.col("parent_id")))


def nested_edge_lines(edges: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """The n strongest edges as `weight\\tname\\tname`, names nested."""
    labels = names.select("concept_id", F.col("name").alias("label"))
    named = labelled(top_edges(edges, n), labels).orderBy(F.desc("weight"), "src", "dst")
    return text_rows(named.select("weight", "src_label", "dst_label"), "\t")


def newick(or_concepts: DataFrame, similarities: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept_id, tree): `(l:d,r:d);` for each binary OR concept, d = 1 - similarity of its two members.

    A concept with other than two members, or with a member of unknown shape, has no tree.
    """
    pairs = or_concepts.groupBy("parent_id").agg(F.array_sort(F.collect_set("child_id")).alias("c")).where("size(c) = 2")
    ends = pairs.select("parent_id", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))
    sim = similarities.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("w"))
    open_ = spool(ends.join(sim, ["a", "b"]), "pairs")
    base = concepts.select("concept_id", F.col("label").alias("tree")).join(pairs.select(F.col("parent_id").alias("concept_id")), "concept_id", "left_anti")
    names, trees = spool(base, "trees"), None
    while True:
        side = lambda k: names.select(F.col("concept_id").alias(k), F.col("tree").alias(f"t{k}"))
        d = F.round(1 - F.col("w"), 6).cast("string")
        met = open_.join(side("a"), "a").join(side("b"), "b")
        grown = spool(met.select(F.col("parent_id").alias("concept_id"), F.concat(F.lit("("), "ta", F.lit(":"), d, F.lit(","), "tb", F.lit(":"), d, F.lit(")")).alias("tree")), "trees")
        if grown.isEmpty():
            break
        trees = grown if trees is None else trees.unionByName(grown)
        names = names.unionByName(grown)
        open_ = spool(open_.join(grown.select(F.col("concept_id").alias("parent_id")), "parent_id", "left_anti"), "open")
    none = names.limit(0)
    return (none if trees is None else trees).select("concept_id", F.concat("tree", F.lit(";")).alias("tree"))


def vertex_statistics(edges: DataFrame, sums: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(vertex, weight, out_degree, in_degree, kept, discarded) for a table of vertices."""
    out = degrees(edges).select("vertex", "out_degree", "in_degree").join(sums.withColumnRenamed("src", "vertex"), "vertex", "full_outer")
    if weights is not None:
        out = out.join(weights.select(F.col("id").alias("vertex"), "weight"), "vertex", "left")
    return out.na.fill(0)


def histogram_lines(hist: DataFrame) -> DataFrame:
    """Two lines of a histogram (bin, left, n): left edges, then counts."""
    rows = hist.agg(F.array_sort(F.collect_list(F.struct("bin", "left", "n"))).alias("h"))
    line = lambda k: F.array_join(F.transform("h", lambda x: x[k].cast("string")), " ")
    return rows.select(F.explode(F.array(line("left"), line("n"))).alias("value"))


def statistics_json(one_row: DataFrame) -> DataFrame:
    """(value): a one-row table as JSON."""
    return one_row.select(F.to_json(F.struct(*one_row.columns)).alias("value"))


def ranking(similarities: DataFrame, concepts: DataFrame, n: int = 10_000) -> DataFrame:
    """The n most similar pairs with labels, most similar first."""
    return labelled(top_edges(similarities, n), concepts).orderBy(F.desc("weight"), "src", "dst")
