"""Clustering of weighted graphs. Every algorithm takes edges (src, dst, weight) and gives (concept_id, cluster_id).

Cluster ids count from `start` in the order of the clusters' sorted members, so that results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components
from kinweave.operators.contexts import ranked
from kinweave.operators.graph import both_ways, saturated, vertices_of
from kinweave.runtime import spool


@dataclass(frozen=True)
class Parameters:
    """Those of all algorithms; each reads its own. with_() changes some."""

    undirected: bool = False
    weighted: bool = True
    iterations: int = 16
    capacity: int = 4
    min_strength: float = 0.5
    max_labels: int = 2
    min_weight: float | None = None
    max_clique: int | None = None
    saturation: float = 1.0
    seed: int = 1
    start: int = 0

    def with_(self, **changes) -> Parameters:
        return replace(self, **changes)


def _numbered(sets: DataFrame, start: int) -> DataFrame:
    """(members) arrays, distinct, to cluster rows."""
    return ranked(sets.select("members").distinct(), ["members"], "cluster_id", start).select(F.explode("members").alias("concept_id"), "cluster_id")


def distinct_clusters(clusters: DataFrame, start: int = 0, min_size: int = 1) -> DataFrame:
    """One of each set of clusters with equal members, renumbered."""
    sets = clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_set("concept_id")).alias("members")).where(F.size("members") >= min_size)
    return _numbered(sets, start)


def _oriented(edges: DataFrame, p: Parameters) -> DataFrame:
    return both_ways(edges) if p.undirected else edges.select("src", "dst", "weight")


def _votes(now: DataFrame, links: DataFrame, p: Parameters, t: int) -> DataFrame:
    """(vertex, label): what most weight says to each vertex when all speakers pick a label from memory; ties by least label."""
    pick = F.pmod(F.xxhash64("vertex", F.lit(t), F.lit(p.seed)), F.size("memory")).cast("int")
    said = now.select(F.col("vertex").alias("src"), F.get("memory", pick).alias("label"))
    heard = links.join(said, "src").groupBy("dst", "label").agg(F.sum(F.col("weight") if p.weighted else F.lit(1.0)).alias("w"))
    best = Window.partitionBy("dst").orderBy(F.desc("w"), "label")
    return heard.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("dst").alias("vertex"), "label")


def _speak(edges: DataFrame, p: Parameters) -> DataFrame:
    links = spool(_oriented(edges, p), "links")
    now = vertices_of(links).select("vertex", F.array("vertex").alias("memory"))
    for t in range(p.iterations):
        heard = F.when(F.col("label").isNull(), F.col("memory")).otherwise(F.concat("memory", F.array("label")))
        step = now.join(_votes(now, links, p, t), "vertex", "left").withColumn("__m", heard)
        kept = F.slice("__m", F.greatest(F.lit(1), F.size("__m") - (p.capacity - 1)), p.capacity)
        now = spool(step.select("vertex", kept.alias("memory")), "memory")
    return now


def slpa(edges: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Speaker-listener label propagation: a label that fills `min_strength` of a vertex's memory capacity is its cluster.

    A vertex that hears nothing keeps its memory. Picks are hashes of (vertex, round, seed), so reruns agree. Clusters of one
    and repeated clusters go.
    """
    rows = _speak(edges, p).select("vertex", F.explode("memory").alias("label")).groupBy("vertex", "label").agg((F.count(F.lit(1)) / p.capacity).alias("strength"))
    mine = rows.where(F.col("strength") >= p.min_strength).select(F.col("vertex").alias("concept_id"), F.col("label").alias("cluster_id"))
    return distinct_clusters(mine, p.start, min_size=2)


def slpa_top_labels(edges: DataFrame, p: Parameters = Parameters(weighted=False, capacity=20)) -> DataFrame:  # noqa: B008
    """The variant without weights that keeps each vertex's `max_labels` most frequent labels."""
    rows = _speak(edges, p).select("vertex", F.explode("memory").alias("label")).groupBy("vertex", "label").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("vertex").orderBy(F.desc("n"), "label")
    mine = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= p.max_labels)
    return distinct_clusters(mine.select(F.col("vertex").alias("concept_id"), F.col("label").alias("cluster_id")), p.start, min_size=2)


def maximal_cliques(edges: DataFrame, p: Parameters = Parameters(undirected=True)) -> DataFrame:  # noqa: B008
    """Maximal cliques, grown a member a round until none grows. With `max_clique`, larger ones are an error.

    The state maps each clique to the vertices that extend it. Cliques grow in ascending order, so each is reached once, by
    its least members; the extensions of a grown clique are what its own and the new member's neighbours share. A clique
    that nothing extends, above or below, is maximal.
    """
    links = spool(_oriented(edges, p).where("src <> dst").select("src", "dst").distinct(), "links")
    around = spool(links.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("near")), "near")
    state = around.select(F.array("src").alias("members"), F.col("near").alias("free"))
    if not p.undirected:
        ends = vertices_of(links.withColumn("weight", F.lit(1.0))).join(around, F.col("vertex") == F.col("src"), "left_anti")
        state = state.unionByName(ends.select(F.array("vertex").alias("members"), F.array().cast(state.schema["free"].dataType).alias("free")))
    done, size = None, 0
    while True:
        state, size = spool(state, "cliques"), size + 1
        full = state.where("size(free) = 0").select("members")
        done = full if done is None else done.unionByName(full)
        grow = state.where("size(free) > 0").select("members", "free", F.explode("free").alias("new"))
        grow = grow.where(F.col("new") > F.element_at("members", -1)) if p.undirected else grow
        if grow.isEmpty():
            break
        if size == p.max_clique:
            raise ValueError(f"there are cliques of more than {p.max_clique} members")
        reach = around.select(F.col("src").alias("new"), "near")
        if p.undirected:
            state = grow.join(reach, "new").select(F.concat("members", F.array("new")).alias("members"), F.array_intersect("free", "near").alias("free"))
        else:
            met = grow.select(F.array_sort(F.concat("members", F.array("new"))).alias("members"), F.array_except("free", F.array("new")).alias("free"))
            state = met.groupBy("members").agg(F.collect_list("free").alias("all")).select("members", F.aggregate("all", F.get("all", 0), F.array_intersect).alias("free"))
    return _numbered(done, p.start)


def edge_clusters(edges: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Each pair with a weight of at least `min_weight` is a cluster of two."""
    if p.min_weight is None:
        raise ValueError("edge clusters need min_weight")
    strong = edges.where(F.col("weight") >= p.min_weight)
    return _numbered(strong.select(F.array(F.least("src", "dst"), F.greatest("src", "dst")).alias("members")), p.start)


def mutual_max(edges: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Pairs whose ends are each other's strongest neighbour; ties by least id. Clusters of two, a vertex in one at most."""
    strongest = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    best = _oriented(edges, p).where("src <> dst").withColumn("r", F.row_number().over(strongest)).where("r = 1")
    pairs = best.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return _numbered(pairs.select(F.array("a", "b").alias("members")), p.start)


def component_clusters(edges: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Connected components; the cluster id is the least vertex."""
    return connected_components(edges).select(F.col("vertex").alias("concept_id"), F.col("component").alias("cluster_id"))


def label_propagation(edges: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Synchronous label propagation over undirected links with saturated weights; ties by least label."""
    links = both_ways(edges).withColumn("weight", saturated(F.col("weight"), p.saturation) if p.weighted else F.lit(1.0))
    links = spool(links, "links")
    now = vertices_of(links).select("vertex", F.col("vertex").alias("label"))
    for _ in range(p.iterations):
        heard = links.join(now.select(F.col("vertex").alias("src"), "label"), "src").groupBy("dst", "label").agg(F.sum("weight").alias("w"))
        best = heard.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("w"), "label"))).where("r = 1")
        now = spool(best.select(F.col("dst").alias("vertex"), "label"), "labels")
    return now.select(F.col("vertex").alias("concept_id"), F.col("label").alias("cluster_id"))


def local_cliques(edges: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Maximal cliques of any size by searching each vertex's neighbourhood among later vertices (pivoted, in Python).

    A task holds one vertex's links at a time: the edges among its neighbours, which a join on both ends gathers.
    """
    import pandas as pd

    links = spool(both_ways(edges).where("src <> dst").select("src", "dst").distinct(), "links")
    kind = links.schema["src"].dataType.simpleString()
    ends = links.select(F.col("src").alias("root"), F.col("dst").alias("a")).join(links.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a")
    inner = ends.join(links.select(F.col("src").alias("root"), F.col("dst").alias("b")), ["root", "b"], "left_semi").where("a < b").select("root", "a", "b")
    own = links.select(F.col("src").alias("root"), F.col("dst").alias("a"), F.col("dst").alias("b"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        root, near = rows["root"].iloc[0], {}
        for a, b in zip(rows["a"], rows["b"], strict=True):
            near.setdefault(a, set())
            if a != b:
                near[a].add(b)
                near.setdefault(b, set()).add(a)
        found, stack = [], [([root], {v for v in near if v > root}, {v for v in near if v < root})]
        while stack:
            clique, open_, shut = stack.pop()
            if not open_ and not shut:
                found.append(sorted(clique))
            if open_:
                pivot = max(open_ | shut, key=lambda v: len(near[v] & open_))
                for v in list(open_ - near[pivot]):
                    stack.append(([*clique, v], open_ & near[v], shut & near[v]))
                    open_.remove(v)
                    shut.add(v)
        return pd.DataFrame({"members": pd.Series(found, dtype=object)})

    return _numbered(inner.unionByName(own).groupBy("root").applyInPandas(search, f"members array<{kind}>"), p.start)


ALGORITHMS: dict[str, Callable[[DataFrame, Parameters], DataFrame]] = {
    "slpa": slpa, "slpa2": slpa_top_labels, "maxcliques": maximal_cliques, "localcliques": local_cliques, "edges": edge_clusters, "mutualmax": mutual_max,
    "components": component_clusters, "labelpropagation": label_propagation,
}


def algorithm(name: str) -> Callable[[DataFrame, Parameters], DataFrame]:
    """By name; an unknown name is slpa."""
    return ALGORITHMS.get(name, slpa)


def saturation_sweep(edges: DataFrame, values: list[float], p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """(saturation, cluster_id, size): label propagation for each saturation."""
    out = None
    for s in values:
        sizes = label_propagation(edges, p.with_(saturation=s)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).select(F.lit(float(s)).alias("saturation"), "cluster_id", "size")
        out = sizes if out is None else out.unionByName(sizes)
    return out


def as_text(clusters: DataFrame) -> DataFrame:
    """(cluster_id, text): members joined by spaces."""
    return clusters.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("concept_id")), lambda c: c.cast("string")), " ").alias("text"))
