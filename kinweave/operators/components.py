"""Connected components by alternating large-star and small-star steps, all joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import spool


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edge set: equal for equal sets."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least vertex in u's neighbourhood."""
    both = _both_ways(edges)
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end of its edges) and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    down = edges.join(least, "src").select(F.explode(F.array(F.col("src"), F.col("dst"))).alias("src"), F.col("least").alias("dst"))
    return down.where("src <> dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """One row (vertex, component) per vertex that has an edge; component is the least vertex reachable.

    Edges are undirected; self loops keep their vertex as its own component; rows with a null end are ignored.
    Every round is a few equi-joins and partial aggregates, and its edges are written to the shared folder, so the
    lineage stays short and a lost executor costs one round at most. Rounds grow with the logarithm of the longest path.
    """
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    canon = ends.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    canon = spool(canon, "edges")
    loops = canon.where("src = dst").select(F.col("src").alias("vertex"))
    now = canon.where("src <> dst")
    mark = _mark(now)
    if mark[0] == 0:
        return loops.select("vertex", F.col("vertex").alias("component"))
    for _ in range(max_rounds):
        now = spool(_small_star(_large_star(now)), "star")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    roots = now.select("dst").distinct().select(F.col("dst").alias("vertex"), F.col("dst").alias("component"))
    found = now.select(F.col("src").alias("vertex"), F.col("dst").alias("component")).unionByName(roots)
    alone = loops.join(found.select("vertex"), "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
    return found.unionByName(alone)
