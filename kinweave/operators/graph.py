"""Correlation and similarity graphs: building, pruning with tracked error, relative-L1 similarity, paths.

edges: (src, dst, weight); a correlation graph is directed, a similarity graph holds each pair once with src < dst.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.measures import Measure
from kinweave.runtime import spool

EDGE = ("src", "dst", "weight")


def correlations(pairs: DataFrame, how: Measure, n: DataFrame | int, min_weight: float = 0.0) -> DataFrame:
    """Edges both ways for pair counts with |weight| > min_weight. `n` is the number of examples, or one row with it."""
    if isinstance(n, DataFrame):
        pairs = pairs.crossJoin(F.broadcast(n.select(F.col(n.columns[0]).alias("__n"))))  # one row
    else:
        pairs = pairs.withColumn("__n", F.lit(n).cast("long"))
    there, back = how(F.col("n_ij"), F.col("n_i"), F.col("n_j"), F.col("__n"))
    both = F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst"), there.alias("weight")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"), back.alias("weight")))
    return pairs.select(F.explode(both).alias("e")).select("e.*").where(F.abs("weight") > min_weight)


def _sums(weights: DataFrame) -> DataFrame:
    return weights.groupBy("src").agg(F.sum(F.abs("weight")).alias("kept"))


@dataclass(frozen=True)
class EdgeData:
    """Edges with the sums of |weight| by source that are still there (kept) and that pruning took (discarded)."""

    weights: DataFrame
    sums: DataFrame

    @classmethod
    def of(cls, weights: DataFrame) -> EdgeData:
        return cls(weights, _sums(weights).withColumn("discarded", F.lit(0.0)))

    def pruned_to(self, weights: DataFrame) -> EdgeData:
        """With fewer edges; what a source loses moves to its discarded sum. A source that lost every edge keeps its row."""
        now = _sums(weights).withColumnRenamed("kept", "now")
        both = self.sums.join(now, "src", "left").withColumn("now", F.coalesce("now", F.lit(0.0)))
        return EdgeData(weights, both.select("src", F.col("now").alias("kept"), (F.col("discarded") + F.col("kept") - F.col("now")).alias("discarded")))

    def merged(self, other: EdgeData) -> EdgeData:
        sums = self.sums.unionByName(other.sums).groupBy("src").agg(F.sum("kept").alias("kept"), F.sum("discarded").alias("discarded"))
        return EdgeData(self.weights.unionByName(other.weights), sums)

    def cached(self) -> EdgeData:
        return replace(self, weights=self.weights.cache(), sums=self.sums.cache())


def weight_filter(edges: DataFrame, min_weight: float, absolute: bool = False) -> DataFrame:
    """Edges with weight >= min_weight, or |weight|."""
    return edges.where((F.abs("weight") if absolute else F.col("weight")) >= min_weight)


def top_in_edges(edges: DataFrame, k: int, absolute: bool = False) -> DataFrame:
    """The k edges with the largest weights into each vertex; ties by least source. Planned as a group limit before the shuffle."""
    by = F.abs("weight") if absolute else F.col("weight")
    return edges.withColumn("__r", F.row_number().over(Window.partitionBy("dst").orderBy(by.desc(), "src"))).where(F.col("__r") <= k).drop("__r")


def prune(data: EdgeData, min_weight: float | None = None, max_in: int | None = None, absolute: bool = False) -> EdgeData:
    """By weight, then by in-degree, with sums carried along."""
    if min_weight is not None:
        data = data.pruned_to(weight_filter(data.weights, min_weight, absolute))
    return data if max_in is None else data.pruned_to(top_in_edges(data.weights, max_in, absolute))


def range_pruned(vertices: DataFrame, edges: DataFrame, vertex_range: tuple[float, float], edge_range: tuple[float, float], max_in: int | None = None) -> EdgeData:
    """Edges in `edge_range` with both ends' weights in `vertex_range`, optionally the `max_in` with the largest |weight|
    into each vertex. discarded counts all other edges of sources whose own weight is in range."""
    ok = vertices.where(F.col("weight").between(*vertex_range)).select("id")
    own = edges.join(ok.withColumnRenamed("id", "src"), "src", "left_semi")
    kept = own.join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi").where(F.col("weight").between(*edge_range)).select(*EDGE)
    kept = top_in_edges(kept, max_in, absolute=True) if max_in is not None else kept
    return EdgeData.of(own).pruned_to(kept)


def bigrams_in_range(bigrams: DataFrame, low: float, high: float) -> DataFrame:
    """(a, b, n) whose ends' shares of all 2 x total words are within the range."""
    ends = bigrams.select(F.explode(F.array("a", "b")).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("c"))
    total = bigrams.agg(F.sum("n").alias("total"))
    ok = ends.crossJoin(F.broadcast(total)).where((F.col("c") / (2 * F.col("total"))).between(low, high)).select("w")  # total is one row
    return bigrams.join(ok.withColumnRenamed("w", "a"), "a", "left_semi").join(ok.withColumnRenamed("w", "b"), "b", "left_semi").select(bigrams.columns)


def shared_terms(edges: DataFrame, non_negative: bool = False) -> DataFrame:
    """(i, j, v) for sources i < j that point at a common vertex: v sums |w_ik - w_jk| - |w_ik| - |w_jk| over such k.

    For weights that can't be negative a term is -2 min(w_ik, w_jk). A vertex with d in-edges makes d(d-1)/2 pairs, which
    the in-degree cap bounds; the join is on the common vertex and its order condition is part of the join.
    """
    left = edges.select("dst", F.col("src").alias("i"), F.col("weight").alias("wi"))
    right = edges.select("dst", F.col("src").alias("j"), F.col("weight").alias("wj"))
    term = -2 * F.least("wi", "wj") if non_negative else F.abs(F.col("wi") - F.col("wj")) - F.abs("wi") - F.abs("wj")
    return left.join(right, "dst").where("i < j").groupBy("i", "j").agg(F.sum(term).alias("v"))


def l1_terms(data: EdgeData, non_negative: bool = False) -> DataFrame:
    """(i, j, s, r_i, r_j, d_i, d_j): the shared term and both ends' kept and discarded sums."""
    side = lambda k: data.sums.select(F.col("src").alias(k), F.col("kept").alias(f"r_{k}"), F.col("discarded").alias(f"d_{k}"))
    terms = shared_terms(data.weights, non_negative).withColumnRenamed("v", "s")
    return terms.join(side("i"), "i").join(side("j"), "j").select("i", "j", "s", "r_i", "r_j", "d_i", "d_j")


def relative_l1(terms: DataFrame) -> DataFrame:
    """(i, j, distance, error): relative L1 distance, and what pruning took of both ends' weight, as a share.

    The distance over kept weights alone is off by at most `error`. This one also counts discarded weights as apart, so it
    is never too small, and too large by at most twice `error`: a lost edge may hide a shared neighbour on either side.
    """
    total = F.col("r_i") + F.col("r_j") + F.col("d_i") + F.col("d_j")
    return terms.select("i", "j", ((F.col("s") + total) / total).alias("distance"), ((F.col("d_i") + F.col("d_j")) / total).alias("error"))


def similarities(data: EdgeData, min_similarity: float | None = 0.0, totals: str = "all", non_negative: bool = False, error: bool = False) -> DataFrame:
    """(src, dst, weight): 1 minus the relative L1 distance for pairs with a common neighbour, above `min_similarity`.

    totals: `all` divides by kept and discarded sums, `surviving` by kept sums alone. With `error`, its bound is a column.
    """
    if totals not in ("all", "surviving"):
        raise ValueError(f"totals are all or surviving, not {totals!r}")
    terms = l1_terms(data, non_negative)
    if totals == "surviving":
        terms = terms.withColumns({"d_i": F.lit(0.0), "d_j": F.lit(0.0)})
    out = relative_l1(terms).select(F.col("i").alias("src"), F.col("j").alias("dst"), (1 - F.col("distance")).alias("weight"), *(["error"] if error else []))
    return out if min_similarity is None else out.where(F.col("weight") > min_similarity)


def pair_similarities(data: EdgeData, pairs: DataFrame) -> DataFrame:
    """similarities() of chosen pairs (i, j) only: edges of other sources are dropped before the two-hop join."""
    ordered = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    members = ordered.select(F.explode(F.array("i", "j")).alias("src")).distinct()
    left = data.weights.select("dst", F.col("src").alias("i"), F.col("weight").alias("wi"))
    right = data.weights.join(members, "src", "left_semi").select("dst", F.col("src").alias("j"), F.col("weight").alias("wj"))
    term = F.abs(F.col("wi") - F.col("wj")) - F.abs("wi") - F.abs("wj")
    met = ordered.join(left, "i").join(right, ["j", "dst"]).groupBy("i", "j").agg(F.sum(term).alias("s"))
    total = lambda k: data.sums.select(F.col("src").alias(k), (F.col("kept") + F.col("discarded")).alias(f"t_{k}"))
    out = met.join(total("i"), "i").join(total("j"), "j")
    return out.select(F.col("i").alias("src"), F.col("j").alias("dst"), (-F.col("s") / (F.col("t_i") + F.col("t_j"))).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def ordered_ends(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, out_degree, in_degree, out_weight, in_weight) in one shuffle."""
    ends = F.array(F.struct(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i"), "weight"), F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("o"), F.lit(1).alias("i"), "weight"))
    flat = edges.select(F.explode(ends).alias("e")).select("e.*")
    return flat.groupBy("vertex").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("weight") * F.col("o")).alias("out_weight"), F.sum(F.col("weight") * F.col("i")).alias("in_weight"))


def labelled(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """edges plus src_label and dst_label; an id without a label shows itself."""
    name = lambda k: concepts.select(F.col("concept_id").alias(k), F.col("label").alias(f"{k}_label"))
    out = edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    return out.withColumns({f"{k}_label": F.coalesce(f"{k}_label", F.col(k).cast("string")) for k in ("src", "dst")})


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The n edges with the largest weights; ties by ends."""
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(n)


def saturated(weight: Column, s: float) -> Column:
    """w^s / (w^s + (1 - w)^s)."""
    up, down = F.pow(weight, F.lit(s)), F.pow(1 - weight, F.lit(s))
    return up / (up + down)


def bigram_graph(bigrams: DataFrame, direction: str = "forward") -> tuple[DataFrame, DataFrame]:
    """From (a, b, n): vertices (label, weight) with shares of 2 x total, and edges whose weight is the conditional
    probability of the second word given the first (forward), or of the first given the second, pointing back (backward)."""
    ends = bigrams.select(F.explode(F.array("a", "b")).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("c"))
    total = bigrams.agg(F.sum("n").alias("total"))
    vertices = ends.crossJoin(F.broadcast(total)).select("label", (F.col("c") / (2 * F.col("total"))).alias("weight"))
    given, other = ("a", "b") if direction == "forward" else ("b", "a")
    marginal = bigrams.groupBy(given).agg(F.sum("n").alias("m"))
    edges = bigrams.groupBy("a", "b").agg(F.sum("n").alias("n")).join(marginal, given).select(F.col(given).alias("src"), F.col(other).alias("dst"), (F.col("n") / F.col("m")).alias("weight"))
    return vertices, edges


def bigram_pmi(bigrams: DataFrame, normalised: bool = False) -> DataFrame:
    """Edges a to b with pmi from separate marginals of first and second words, or pmi over -ln p_ab (NaN where p_ab is 1)."""
    first, second = bigrams.groupBy("a").agg(F.sum("n").alias("na")), bigrams.groupBy("b").agg(F.sum("n").alias("nb"))
    total = bigrams.agg(F.sum("n").cast("double").alias("t"))
    rows = bigrams.groupBy("a", "b").agg(F.sum("n").alias("n")).join(first, "a").join(second, "b").crossJoin(F.broadcast(total))
    log_p = F.ln(F.col("n") / F.col("t"))
    pmi = log_p - F.ln(F.col("na") / F.col("t")) - F.ln(F.col("nb") / F.col("t"))
    weight = F.when(log_p == 0, F.lit(float("nan"))).otherwise(-pmi / log_p) if normalised else pmi
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), weight.alias("weight"))


def path_similarities(edges: DataFrame, sources: DataFrame, cutoff: float = 2.0, max_rounds: int = 100) -> DataFrame:
    """(source, target, distance, similarity) within `cutoff` of each source over an undirected similarity graph.

    An edge's distance is 1 - similarity; edges with similarity or distance not above 0 are ignored; a source reaches itself
    with distance 0 and similarity 1. similarity is the product along the shortest path; of equal distances the larger
    product. All sources relax together; only what improved in a round is joined with the edges in the next.
    """
    links = spool(both_ways(edges).where("weight > 0 and weight < 1").groupBy("src", "dst").agg(F.max("weight").alias("weight")), "links")
    best = sources.select(F.col(sources.columns[0]).alias("source")).distinct().select("source", F.col("source").alias("target"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("similarity"))
    best = new = spool(best, "paths")
    for _ in range(max_rounds):
        step = new.join(links, new["target"] == links["src"]).select("source", F.col("dst").alias("target"), (F.col("distance") + 1 - F.col("weight")).alias("distance"), (F.col("similarity") * F.col("weight")).alias("similarity"))
        offers = step.where(F.col("distance") <= cutoff).withColumn("old", F.lit(0)).unionByName(best.withColumn("old", F.lit(1)))
        rank = F.struct(F.round("distance", 12), -F.col("similarity"), -F.col("old"))
        picked = offers.groupBy("source", "target").agg(F.min_by(F.struct("distance", "similarity", "old"), rank).alias("b")).select("source", "target", "b.*")
        picked = spool(picked, "paths")
        best, new = picked.drop("old"), picked.where("old = 0").drop("old")
        if new.isEmpty():
            return best
    raise RuntimeError(f"paths still improve after {max_rounds} rounds")
