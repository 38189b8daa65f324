"""Counts over contexts: concepts, pairs, recurrences.

contexts: (context_id, concept_id), a bag. context_counts: (concept_id, context_id, context_count), where a context stands
for context_count equal ones. Pair counts: (i, j, n_ij, n_i, n_j) with i < j. Ids may be of any ordered type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("i", "j")


def concept_counts(contexts: DataFrame, min_count: int = 1) -> DataFrame:
    """(concept_id, n): rows of each concept, at least `min_count`."""
    out = contexts.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_count) if min_count > 1 else out


def existence_counts(contexts: DataFrame, min_count: int = 1) -> DataFrame:
    """(concept_id, n): contexts that hold each concept."""
    return concept_counts(contexts.select("context_id", "concept_id").distinct(), min_count)


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select("context_id", F.col("concept_id").alias(name))


def _within(contexts: DataFrame) -> DataFrame:
    """Pairs of rows of one context with i < j."""
    return _side(contexts, "i").join(_side(contexts, "j"), "context_id").where("i < j").select(*PAIR)


def _across(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of a row of each that share a context, ends in order, without equal ends."""
    met = _side(one, "a").join(_side(other, "b"), "context_id").where("a <> b")
    return met.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def with_marginals(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Add n_i and n_j from `counts` (concept_id, n); pairs with an end that isn't there go."""
    first = counts.select(F.col("concept_id").alias("i"), F.col("n").alias("n_i"))
    second = counts.select(F.col("concept_id").alias("j"), F.col("n").alias("n_j"))
    return pairs.join(first, "i").join(second, "j").select("i", "j", "n_ij", "n_i", "n_j")


def pair_counts(contexts: DataFrame, min_count: int = 1, added: DataFrame | None = None) -> DataFrame:
    """Pair counts of pairs and concepts with at least `min_count`.

    With `added`, rows to add to the same contexts: pairs that involve at least one of them, marginals over everything. An
    infrequent concept is dropped before pairs are made, since no pair of it could stay.
    """
    everything = contexts if added is None else contexts.unionByName(added)
    marginals = concept_counts(everything, min_count)

    def frequent(df):
        return df.join(marginals.select("concept_id"), "concept_id", "left_semi").select("context_id", "concept_id") if min_count > 1 else df

    pairs = _within(frequent(contexts)) if added is None else _across(frequent(contexts), frequent(added)).unionByName(_within(frequent(added)))
    counted = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_ij")).where(F.col("n_ij") >= min_count)
    return with_marginals(counted, marginals)


def coexistence_counts(contexts: DataFrame, min_count: int = 1, added: DataFrame | None = None) -> DataFrame:
    """pair_counts() where a concept counts once a context."""
    once = lambda df: None if df is None else df.select("context_id", "concept_id").distinct()
    return pair_counts(once(contexts), min_count, once(added))


def coexistence_with_self(contexts: DataFrame, min_count: int = 1) -> DataFrame:
    """coexistence_counts() plus the pair (c, c), counted in contexts that hold c twice or more."""
    repeats = contexts.groupBy("context_id", "concept_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    own = repeats.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_ij")).where(F.col("n_ij") >= min_count)
    own = own.select(F.col("concept_id").alias("i"), F.col("concept_id").alias("j"), "n_ij")
    return coexistence_counts(contexts, min_count).unionByName(with_marginals(own, existence_counts(contexts, min_count)))


def pair_counts_from_contexts(counts: DataFrame, min_context: int = 1, min_concept: int = 1, added: DataFrame | None = None) -> DataFrame:
    """Pair counts of context_counts: n_ij sums the counts of shared contexts, n_i those of the concept's contexts; contexts
    with fewer than `min_context` and concepts with fewer than `min_concept` are dropped first."""

    def kept(df):
        return df.where(F.col("context_count") >= min_context) if min_context > 1 else df

    base = kept(counts)
    extra = None if added is None else kept(added)
    everything = base if extra is None else base.unionByName(extra)
    marginals = everything.groupBy("concept_id").agg(F.sum("context_count").alias("n"))
    marginals = marginals.where(F.col("n") >= min_concept)

    def frequent(df):
        return df.join(marginals.select("concept_id"), "concept_id", "left_semi") if min_concept > 1 else df

    def side(df, name, *more):
        return frequent(df).select("context_id", F.col("concept_id").alias(name), *more)

    if extra is None:
        pairs = side(base, "i", "context_count").join(side(base, "j"), "context_id").where("i < j")
    else:
        ordered = side(base, "a", "context_count").join(side(extra, "b"), "context_id").where("a <> b")
        pairs = ordered.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "context_count")
        pairs = pairs.unionByName(side(extra, "i", "context_count").join(side(extra, "j"), "context_id").where("i < j").select("i", "j", "context_count"))
    return with_marginals(pairs.groupBy(*PAIR).agg(F.sum("context_count").alias("n_ij")), marginals)


def repeat_counts(contexts: DataFrame) -> DataFrame:
    """(context_id, concept_id, m): how often a context holds a concept."""
    return contexts.groupBy("context_id", "concept_id").agg(F.count(F.lit(1)).alias("m"))


def recurrence_counts(contexts: DataFrame) -> DataFrame:
    """(concept_id, n, times, n_contexts): contexts that hold the concept exactly n >= 2 times, and at all."""
    repeats = repeat_counts(contexts)
    by_size = repeats.groupBy("concept_id", F.col("m").alias("n")).agg(F.count(F.lit(1)).alias("times"))
    return by_size.withColumn("n_contexts", F.sum("times").over(Window.partitionBy("concept_id"))).where("n > 1")


def top_concepts(counts: DataFrame, k: int) -> DataFrame:
    """The context_counts of the k concepts with the largest sums; ties by least id. The ranking is a top-k, not a full sort."""
    best = counts.groupBy("concept_id").agg(F.sum("context_count").alias("n")).orderBy(F.desc("n"), "concept_id").limit(k)
    return counts.join(best.select("concept_id"), "concept_id", "left_semi").select(counts.columns)
