"""Higher-order concepts: recurrences, AND and OR groups, their activation and projection, and their discovery.

or_concepts and and_concepts: (child_id, parent_id). activations over counts: (concept_id, context_id, context_count).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.ids import AND_START, OR_START
from kinweave.functions.measures import Measure
from kinweave.operators import graph
from kinweave.operators.clustering import Parameters, mutual_max
from kinweave.operators.counts import pair_counts_from_contexts, recurrence_counts, repeat_counts, top_concepts
from kinweave.runtime import spool

COUNTS = ("concept_id", "context_id", "context_count")


def find_recurrent(contexts: DataFrame, min_count: int = 1) -> DataFrame:
    """(concept_id, n): concepts that occur n >= 2 times in at least `min_count` contexts."""
    return recurrence_counts(contexts).where(F.col("times") >= min_count).select("concept_id", "n")


def activate_recurrent(contexts: DataFrame, recurrent: DataFrame) -> DataFrame:
    """(context_id, concept_id): recurrent concepts (rec_id, concept_id, n) in contexts that hold the concept n times or more."""
    return repeat_counts(contexts).join(recurrent, "concept_id").where("n <= m").select("context_id", F.col("rec_id").alias("concept_id"))


def _parents(children: DataFrame) -> DataFrame:
    return children.select(F.col("child_id").alias("concept_id"), "parent_id")


def activate_or(contexts: DataFrame, or_concepts: DataFrame) -> DataFrame:
    """(context_id, concept_id): OR concepts with any member in the context."""
    return contexts.join(_parents(or_concepts), "concept_id").select("context_id", F.col("parent_id").alias("concept_id")).distinct()


def and_sizes(and_concepts: DataFrame) -> DataFrame:
    return and_concepts.groupBy("parent_id").agg(F.countDistinct("child_id").alias("size"))


def activate_and(contexts: DataFrame, and_concepts: DataFrame, sizes: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """(context_id, concept_id): AND concepts with all members, at least two, in the context. `unique`: rows don't repeat."""
    sizes = and_sizes(and_concepts) if sizes is None else sizes
    how = F.count(F.lit(1)) if unique else F.countDistinct("concept_id")
    met = contexts.join(_parents(and_concepts), "concept_id").groupBy("context_id", "parent_id").agg(how.alias("n"))
    return met.join(sizes, "parent_id").where((F.col("n") >= F.col("size")) & (F.col("n") >= 2)).select("context_id", F.col("parent_id").alias("concept_id"))


def activate_or_counts(counts: DataFrame, or_concepts: DataFrame) -> DataFrame:
    """activate_or() over context counts."""
    return counts.join(_parents(or_concepts), "concept_id").select(F.col("parent_id").alias("concept_id"), "context_id", "context_count").distinct()


def activate_and_counts(counts: DataFrame, and_concepts: DataFrame) -> DataFrame:
    """activate_and() over context counts: all members in the context with equal counts."""
    met = counts.join(_parents(and_concepts), "concept_id").groupBy("parent_id", "context_id", "context_count").agg(F.countDistinct("concept_id").alias("n"))
    return met.join(and_sizes(and_concepts), "parent_id").where((F.col("n") >= F.col("size")) & (F.col("n") >= 2)).select(F.col("parent_id").alias("concept_id"), "context_id", "context_count")


def project_and(counts: DataFrame, and_concepts: DataFrame, everywhere: bool = False) -> DataFrame:
    """Members give way to active AND concepts: in the contexts where those are active, or with `everywhere` in all."""
    active = activate_and_counts(counts, and_concepts)
    used = active.withColumnRenamed("concept_id", "parent_id").join(and_concepts, "parent_id").select(F.col("child_id").alias("concept_id"), "context_id").distinct()
    rest = counts.join(used.select("concept_id").distinct(), "concept_id", "left_anti") if everywhere else counts.join(used, ["concept_id", "context_id"], "left_anti")
    return rest.select(*COUNTS).unionByName(active)


def project_or(counts: DataFrame, or_concepts: DataFrame) -> DataFrame:
    """Members give way to their OR concepts; the rest stays."""
    return counts.join(_parents(or_concepts), "concept_id", "left").select(F.coalesce("parent_id", "concept_id").alias("concept_id"), "context_id", "context_count").distinct()


def project_or_contexts(contexts: DataFrame, or_concepts: DataFrame) -> DataFrame:
    """project_or() over contexts."""
    return contexts.join(_parents(or_concepts), "concept_id", "left").select("context_id", F.coalesce("parent_id", "concept_id").alias("concept_id")).distinct()


def activate_all(contexts: DataFrame, and_concepts: DataFrame | None, or_concepts: DataFrame | None, max_levels: int = 10) -> DataFrame:
    """Contexts with all concepts that are active in them, level by level until nothing is new."""
    now = spool(contexts.select("context_id", "concept_id").distinct(), "active")
    n = now.count()
    for _ in range(max_levels):
        more = now
        if or_concepts is not None:
            more = more.unionByName(activate_or(now, or_concepts))
        if and_concepts is not None:
            more = more.unionByName(activate_and(now, and_concepts, unique=True))
        now = spool(more.distinct(), "active")
        if (m := now.count()) == n:
            break
        n = m
    return now


# Formulas: a CNF is an array of clauses, a clause an array of atoms, both sorted.


def minimal_cnf(cnf: Column) -> Column:
    """Without clauses that hold another clause, repeated clauses or atoms; canonically sorted."""
    clauses = F.array_distinct(F.transform(cnf, lambda c: F.array_sort(F.array_distinct(c))))
    wider = lambda c, d: (c != d) & (F.size(F.array_except(d, c)) == 0)
    return F.transform(F.array(clauses), lambda cs: F.array_sort(F.filter(cs, lambda c: ~F.exists(cs, lambda d: wider(c, d)))))[0]


def cnf_and(a: Column, b: Column) -> Column:
    return minimal_cnf(F.concat(a, b))


def cnf_or(a: Column, b: Column) -> Column:
    """Each clause of one with each of the other."""
    return minimal_cnf(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_union(x, y)))))


def folded_cnf(members: DataFrame, key: str, cnf: str, how: str) -> DataFrame:
    """(key, cnf): the formulas of each group joined by `and` or `or`, minimal. OR multiplies clauses."""
    join = cnf_and if how == "and" else cnf_or
    lists = members.groupBy(key).agg(F.array_sort(F.collect_set(cnf)).alias("all"))
    return lists.select(key, F.aggregate(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), join).alias("cnf"))


@dataclass(frozen=True)
class Formula:
    """atom, or `and`/`or` of formulas; cnf() gives the minimal canonical form as a sorted tuple of sorted tuples."""

    kind: str
    parts: tuple = ()
    atom: int | None = None

    def cnf(self) -> tuple[tuple[int, ...], ...]:
        if self.kind == "atom":
            return ((self.atom,),)
        forms = [p.cnf() for p in self.parts]
        clauses = {frozenset(c) for f in forms for c in f} if self.kind == "and" else {frozenset()}
        if self.kind == "or":
            for f in forms:
                clauses = {c | frozenset(d) for c in clauses for d in f}
        return tuple(sorted(tuple(sorted(c)) for c in clauses if not any(d < c for d in clauses)))


def atom(x: int) -> Formula:
    return Formula("atom", atom=x)


def both(*parts: Formula) -> Formula:
    return Formula("and", parts)


def either(*parts: Formula) -> Formula:
    return Formula("or", parts)


@dataclass(frozen=True)
class Discovery:
    """What discovery() finds."""

    correlations: DataFrame
    similarities: DataFrame
    and_concepts: DataFrame
    or_concepts: DataFrame
    counts: DataFrame


@dataclass(frozen=True)
class Settings:
    """Of discovery. max_concepts: the concepts with the largest sums that projected discovery starts from, None for all.
    concept_threshold is taken for compatibility and has no effect on projected discovery."""

    measure: Measure
    n: int
    cluster: Callable[[DataFrame, Parameters], DataFrame] = mutual_max
    parameters: Parameters = Parameters()
    levels: int = 2
    min_context: int = 1
    min_concept: int = 1
    min_correlation: float = 0.0
    min_similarity: float = 0.0
    max_in: int = 100
    max_concepts: int | None = 5000
    log_similarity: bool = False
    find_and: bool = True
    find_or: bool = True
    totals: str = "all"
    concept_threshold: float | None = None


def _clusters(edges: DataFrame, s: Settings, undirected: bool, start: int, min_weight: float) -> DataFrame:
    p = s.parameters.with_(undirected=undirected, start=start, min_weight=s.parameters.min_weight if s.parameters.min_weight is not None else min_weight)
    found = s.cluster(edges, p)
    return spool(found.select(F.col("concept_id").alias("child_id"), F.col("cluster_id").alias("parent_id")), "concepts")


def _correlated(counts: DataFrame, s: Settings) -> graph.EdgeData:
    pairs = pair_counts_from_contexts(counts, s.min_context, s.min_concept)
    edges = spool(graph.correlations(pairs, s.measure, s.n, 0.0), "correlations")
    data = graph.prune(graph.EdgeData.of(edges), s.min_correlation, s.max_in)
    return graph.EdgeData(spool(data.weights, "weights"), spool(data.sums, "sums"))


def _next(concepts: DataFrame, start: int) -> int:
    return max(start, (concepts.agg(F.max("parent_id")).first()[0] or 0) + 1)


def discover_projected(counts: DataFrame, s: Settings) -> Discovery:
    """Level by level: clusters of the correlation graph become AND concepts, clusters of its similarity graph OR concepts,
    and activations are projected onto both, until neither appears. The OR step uses the correlations from before."""
    now = spool((counts if s.max_concepts is None else top_concepts(counts, s.max_concepts)).select(*COUNTS), "activations")
    and_next, or_next, ands, ors, sims, data = AND_START, OR_START, [], [], [], None
    for _ in range(s.levels):
        data = _correlated(now, s)
        grew = False
        if s.find_and:
            found = _clusters(data.weights, s, False, and_next, s.min_correlation)
            if not found.isEmpty():
                grew, and_next = True, _next(found, and_next)
                ands.append(found)
                now = spool(project_and(now, found), "activations")
        if s.find_or:
            sim = graph.similarities(data, None, s.totals).where(F.col("weight") >= s.min_similarity)
            sim = spool(sim.withColumn("weight", F.log10("weight")) if s.log_similarity else sim, "similarities")
            sims.append(sim)
            found = _clusters(sim, s, True, or_next, s.min_similarity)
            if not found.isEmpty():
                grew, or_next = True, _next(found, or_next)
                ors.append(found)
                now = spool(project_or(now, found), "activations")
        if not grew:
            break
    return Discovery(data.weights, _union(sims, data.weights.limit(0)), _union(ands, _no_concepts(counts)), _union(ors, _no_concepts(counts)), now)


def _no_concepts(counts: DataFrame) -> DataFrame:
    return counts.sparkSession.createDataFrame([], "child_id long, parent_id long")


def _union(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = none
    for p in parts:
        out = out.unionByName(p.select(none.columns))
    return out


def discover_from_counts(counts: DataFrame, s: Settings, concept_threshold: float = float("inf")) -> Discovery:
    """Concepts are added and never replace their members. New concepts are correlated with everything so far; one whose
    every link to others is stronger than `concept_threshold`, and so repeats another, is not kept. Links between a concept
    and its members don't count, nor similarities between concepts of earlier levels."""
    p = s.parameters.with_(min_strength=0.8)
    total = current = spool(counts.select(*COUNTS), "activations")
    and_next, or_next, own, ands, ors, sims = AND_START, OR_START, None, [], [], []

    def correlated(base, added):
        pairs = pair_counts_from_contexts(base, s.min_context, s.min_concept, added)
        edges = graph.correlations(pairs, s.measure, s.n, s.min_correlation)
        if own is not None:
            edges = edges.join(graph.ordered_ends(own.select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"))).alias("o"), (F.least(edges["src"], edges["dst"]) == F.col("o.src")) & (F.greatest(edges["src"], edges["dst"]) == F.col("o.dst")), "left_anti")
        return spool(edges, "correlations")

    edges = correlated(total.limit(0), current)
    fresh_from = 0
    for _ in range(s.levels):
        data = graph.prune(graph.EdgeData.of(edges), s.min_correlation, s.max_in)
        sim = graph.similarities(data, None, s.totals).where((F.col("weight") >= s.min_similarity) & ((F.col("src") >= fresh_from) | (F.col("dst") >= fresh_from)))
        sim = spool(sim, "similarities")
        sims.append(sim)
        cluster = lambda e, undirected, start, w: _clusters(e, _with(s, p), undirected, start, w)
        new_and = cluster(data.weights, False, and_next, s.min_correlation)
        new_or = cluster(sim, True, or_next, s.min_similarity)
        active = spool(activate_and_counts(total, new_and).unionByName(activate_or_counts(total, new_or)), "activations")
        if active.isEmpty():
            break
        own_new = new_and.unionByName(new_or)
        own = own_new if own is None else own.unionByName(own_new)
        candidate = correlated(total, active)
        new = lambda c: ((F.col(c) >= and_next) & (F.col(c) < OR_START)) | (F.col(c) >= or_next)
        fine = candidate.where((F.col("weight") <= concept_threshold) | (new("src") & new("dst")))
        valid = graph.vertices_of(fine).withColumnRenamed("vertex", "parent_id")
        new_and, new_or = (spool(x.join(valid, "parent_id", "left_semi").select("child_id", "parent_id"), "kept") for x in (new_and, new_or))
        current = spool(active.join(valid.withColumnRenamed("parent_id", "concept_id"), "concept_id", "left_semi").select(*COUNTS), "activations")
        if current.isEmpty():
            break
        ands.append(new_and)
        ors.append(new_or)
        fresh_from = min(and_next, or_next)
        and_next, or_next = _next(new_and, and_next), _next(new_or, or_next)
        total = spool(total.unionByName(current), "activations")
        edges = spool(edges.unionByName(fine.join(valid.withColumnRenamed("parent_id", "src"), "src", "left_semi")).dropDuplicates(["src", "dst"]), "correlations")
    none = _no_concepts(counts)
    return Discovery(edges, _union(sims, edges.limit(0)), _union(ands, none), _union(ors, none), total)


def _with(s: Settings, p: Parameters) -> Settings:
    from dataclasses import replace

    return replace(s, parameters=p)


def discover_indexed(contexts: DataFrame, s: Settings, concept_threshold: float = float("inf")) -> Discovery:
    """discover_from_counts() over contexts: each is a context of count 1."""
    counts = contexts.select("concept_id", "context_id").distinct().withColumn("context_count", F.lit(1).cast("long"))
    return discover_from_counts(counts, s, concept_threshold)


def discover_cnf(contexts: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(formulas, activations): concepts as minimal CNF over basic concepts.

    Clusters of the correlation graph join their members' formulas by AND, clusters of the similarity graph by OR; a formula
    that is known already, by its canonical array, isn't new. A formula is active in a context if each clause has an atom
    there; it is activated on the initial data by OR of atoms and AND of clauses. formulas: (concept_id, cnf).
    """
    base = spool(contexts.select("context_id", F.col("concept_id").cast("long").alias("concept_id")).distinct(), "contexts")
    known = spool(base.select("concept_id").distinct().select("concept_id", F.array(F.array("concept_id")).alias("cnf")), "formulas")
    active, start = base, AND_START
    for _ in range(s.levels):
        counts = active.select("concept_id", "context_id").withColumn("context_count", F.lit(1).cast("long"))
        data = _correlated(counts, s)
        sim = spool(graph.similarities(data, s.min_similarity, s.totals), "similarities")
        groups = [(_clusters(data.weights, s, False, 0, s.min_correlation), "and"), (_clusters(sim, s, True, 0, s.min_similarity), "or")]
        formed = [folded_cnf(g.join(known, g["child_id"] == known["concept_id"]).select("parent_id", "cnf"), "parent_id", "cnf", how).select("cnf") for g, how in groups]
        new = spool(formed[0].unionByName(formed[1]).distinct().join(known.select("cnf"), "cnf", "left_anti"), "new")
        if new.isEmpty():
            break
        from kinweave.operators.contexts import ranked

        numbered = spool(ranked(new, ["cnf"], "concept_id", start).select("concept_id", "cnf"), "numbered")
        start = start + new.count()
        clauses = numbered.select("concept_id", F.size("cnf").alias("size"), F.posexplode("cnf").alias("k", "clause"))
        atoms = clauses.select(F.col("concept_id").alias("parent"), "size", "k", F.explode("clause").alias("concept_id"))
        met = base.join(atoms, "concept_id").groupBy("context_id", "parent").agg(F.countDistinct("k").alias("n"), F.first("size").alias("size"))
        active = spool(active.unionByName(met.where("n = size").select("context_id", F.col("parent").alias("concept_id"))), "active")
        known = spool(known.unionByName(numbered), "formulas")
    return known, active


def synthetic_contexts(spark, n: int, mean_size: float = 3.0, vocabulary: int = 50, phases: int = 1, seed: int = 1) -> DataFrame:
    """n contexts whose sizes are geometric with the given mean, over a vocabulary that moves on each phase. For tests."""
    size = F.floor(F.ln(F.rand(seed)) / F.ln(F.lit(1 - 1 / mean_size))).cast("int") + 1
    rows = spark.range(n).withColumn("size", size).select(F.col("id").alias("context_id"), F.explode(F.sequence(F.lit(1), "size")).alias("k"))
    phase = F.floor(F.col("context_id") * phases / n).cast("long")
    return rows.select("context_id", (F.pmod(F.xxhash64("context_id", "k", F.lit(seed)), F.lit(vocabulary)) + phase * vocabulary).alias("concept_id"))
