"""Statistics of columns and graphs, rank correlation, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components
from kinweave.operators.contexts import running_sums
from kinweave.operators.graph import degrees
from kinweave.runtime import spool


def summary(df: DataFrame, col: str) -> DataFrame:
    """One row: n, mean, population deviation, minimum, maximum, sum."""
    c = F.col(col).cast("double")
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("stdev"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(bin, left, n) of equal bins from minimum to maximum, empty ones included; the maximum is in the last. Nulls are left out."""
    c = F.col(col).cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).cast("int")
    counts = df.select(c.alias("x")).where("x is not null").crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends is one row
    all_bins = ends.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))


def cumulative_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, at_most): how many rows have each value, and at most it. The running sum is over distinct values."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, "value", "n", "at_most")


def graph_statistics(edges: DataFrame) -> DataFrame:
    """One row: edges, vertices, and mean and deviation of weight, in-degree and out-degree (over vertices that have any)."""
    own = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("weight_mean"), F.stddev_pop("weight").alias("weight_stdev"))
    d = degrees(edges)
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    by = d.agg(
        F.count(F.lit(1)).alias("n_vertices"), F.avg(some("out_degree")).alias("out_mean"), F.stddev_pop(some("out_degree")).alias("out_stdev"),
        F.avg(some("in_degree")).alias("in_mean"), F.stddev_pop(some("in_degree")).alias("in_stdev"),
    )
    return own.crossJoin(by)  # one row each


def undirected_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(vertex, n): triangles through each vertex that is in any.

    Links point from the end with fewer neighbours to the one with more, so that no vertex has more than some sqrt(2 x links)
    out-links and hubs don't make their square of pairs.
    """
    pairs = undirected_pairs(edges).where("a <> b")
    deg = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    rich = pairs.join(deg.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    links = rich.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = links.join(links.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = wedges.join(pairs.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    return closed.select(F.explode(F.array("u", "v", "w")).alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    """(vertex, degree, triangles, coefficient) of vertices with two neighbours or more."""
    pairs = undirected_pairs(edges)
    deg = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1")
    out = deg.join(triangles(edges).withColumnRenamed("n", "triangles"), "vertex", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return out.withColumn("coefficient", F.col("triangles") / (F.col("degree") * (F.col("degree") - 1) / 2))


def graph_measures(edges: DataFrame) -> DataFrame:
    """One row: directed and undirected edges, vertices, components, mean coefficient; vectors come from degrees() and
    clustering_coefficients()."""
    pairs = undirected_pairs(edges)
    d = edges.agg(F.count(F.lit(1)).alias("n_directed"))
    u = pairs.agg(F.count(F.lit(1)).alias("n_undirected"))
    v = connected_components(pairs, "a", "b").agg(F.count(F.lit(1)).alias("n_vertices"), F.countDistinct("component").alias("n_components"))
    c = clustering_coefficients(edges).agg(F.avg("coefficient").alias("mean_coefficient"))
    return d.crossJoin(u).crossJoin(v).crossJoin(c)  # one row each


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho): rank correlation of rows where both are there, ties by average rank.

    Ranks come from counts of distinct values, summed over the values below. Values are written once: a sum of floats that is
    made again, in another order, may differ in its last bit and then has no rank.
    """
    rows = spool(df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x is not null and y is not null"), "ranked")

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        up_to = running_sums(counts, c, "n", "up_to")
        return up_to.select(c, (F.col("up_to") - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    return rows.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def rmse(df: DataFrame, predicted: str, actual: str, hit: str | None = None) -> DataFrame:
    """One row (n, rmse), and with `hit`, a boolean column, (n_hits, rmse_hits) over hits alone."""
    error = F.pow(F.col(predicted) - F.col(actual), F.lit(2))
    out = [F.count(error).alias("n"), F.sqrt(F.avg(error)).alias("rmse")]
    if hit:
        out += [F.count_if(F.col(hit)).alias("n_hits"), F.sqrt(F.avg(F.when(F.col(hit), error))).alias("rmse_hits")]
    return df.agg(*out)


def l1_metrics(terms: DataFrame) -> DataFrame:
    """Quantities whose histograms judge pruning, from l1_terms(): norms, distances and error bounds."""
    r, d = F.col("r_i") + F.col("r_j"), F.col("d_i") + F.col("d_j")
    return terms.select(
        "i", "j", (F.col("s") + r).alias("l1_kept"), (F.col("s") + r + d).alias("l1_bound"), (r + d).alias("norm"), d.alias("error"),
        ((F.col("s") + r) / r).alias("relative_kept"), ((F.col("s") + r + d) / (r + d)).alias("relative_l1"), (d / (r + d)).alias("relative_error"),
    )


def approx_equal(x: float, y: float, tolerance: float = 0.001) -> bool:
    return abs(x - y) <= tolerance * min(abs(x), abs(y))


def shares(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, share): how many rows each combination has, and what share of all; as of notes by channel and pitch."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("total")).alias("share"))  # total is one row
