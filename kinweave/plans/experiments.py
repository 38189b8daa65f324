"""Sweeps over thresholds: graph measures, similarity errors, classification by OR concepts, word similarity, runtimes."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import clustering, concepts, graph, predict, stats
from kinweave.operators.graph import EdgeData


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_degree_sweep(edges: DataFrame, values: list[int]) -> DataFrame:
    """graph_measures() of the graph pruned to each in-degree."""
    return _stack([stats.graph_measures(graph.top_in_edges(edges, k)).withColumn("max_in", F.lit(k)) for k in values])


def similarity_sweep(edges: DataFrame, values: list[float]) -> DataFrame:
    """graph_measures() of the edges above each weight."""
    return _stack([stats.graph_measures(edges.where(F.col("weight") > x)).withColumn("min_weight", F.lit(x)) for x in values])


def similarity_errors(edges: DataFrame, values: list[int], reference: int = 1000) -> DataFrame:
    """(max_in, src, dst, error, bound, ratio): similarity at each in-degree against a reference one; pairs that a smaller
    cap loses count as similarity 0 there, with no bound."""
    data = EdgeData.of(edges)
    best = graph.similarities(graph.prune(data, max_in=reference), None).withColumnRenamed("weight", "best")

    def at(k: int) -> DataFrame:
        own = graph.similarities(graph.prune(data, max_in=k), None, error=True).withColumnRenamed("error", "bound")
        both = best.join(own, ["src", "dst"], "left").withColumn("error", F.abs(F.col("best") - F.coalesce("weight", F.lit(0.0))))
        return both.select(F.lit(k).alias("max_in"), "src", "dst", "error", "bound", F.when(F.col("bound") > 0, F.col("error") / F.col("bound")).alias("ratio"))

    return _stack([at(k) for k in values])


def classification_sweep(contexts: DataFrame, classes: DataFrame, test: DataFrame, test_classes: DataFrame, edges: DataFrame, values: list[int], p: clustering.Parameters = clustering.Parameters(undirected=True)) -> DataFrame:  # noqa: B008
    """(max_in, variant, accuracy) with concepts as they are, with OR concepts added, projected, and OR concepts alone."""
    n = classes.count()

    def at(k: int) -> DataFrame:
        sims = graph.similarities(graph.prune(EdgeData.of(edges), max_in=k))
        ors = clustering.slpa(sims, p).select(F.col("concept_id").alias("child_id"), (F.col("cluster_id") + concepts.OR_START).alias("parent_id"))
        own = lambda c: c.select("context_id", "concept_id")
        forms = {
            "plain": own, "added": lambda c: own(c).unionByName(own(concepts.activate_or(c, ors))),
            "projected": lambda c: own(concepts.project_or_contexts(c, ors)), "only": lambda c: own(concepts.activate_or(c, ors)),
        }
        rows = [predict.concept_naive_bayes(f(contexts), classes, f(test), n).join(test_classes.withColumnRenamed("class_id", "truth"), "context_id").agg(F.avg((F.col("class_id") == F.col("truth")).cast("double")).alias("accuracy")).select(F.lit(k).alias("max_in"), F.lit(name).alias("variant"), "accuracy") for name, f in forms.items()]
        return _stack(rows)

    return _stack([at(k) for k in values])


def word_similarity_sweep(edges: DataFrame, pairs: DataFrame, values: list[int]) -> DataFrame:
    """(max_in, n, rho): rank correlation of scores of pairs (i, j, score) with their similarity at each in-degree."""

    def at(k: int) -> DataFrame:
        sims = graph.pair_similarities(graph.prune(EdgeData.of(edges), max_in=k), pairs)
        keyed = pairs.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "score")
        return stats.spearman(keyed.join(sims, ["src", "dst"]), "score", "weight").withColumn("max_in", F.lit(k))

    return _stack([at(k) for k in values])


def runtimes(edges: DataFrame, values: list[int]) -> list[dict]:
    """Seconds and sizes of building the similarity graph at each in-degree."""
    out = []
    for k in values:
        began = time.time()
        row = graph.similarities(graph.prune(EdgeData.of(edges), max_in=k), None, error=True).agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("error")).first()
        out.append({"max_in": k, "seconds": time.time() - began, "pairs": row.n, "mean_error": row.error})
    return out
