"""Jobs: texts and n-grams to contexts, contexts to graphs, graphs to clusters and concepts, word-pair benchmarks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.ids import RECURRENT_START
from kinweave.functions.measures import NON_NEGATIVE, measure
from kinweave.operators import clustering, concepts, contexts, counts, graph, stats
from kinweave.operators.graph import EdgeData
from kinweave.runtime import spool
from kinweave.sources import readers, sinks
from kinweave.sources.workspace import Workspace


@dataclass(frozen=True)
class GraphSettings:
    """Of the graph jobs, with the defaults of the command line."""

    measure: str = "pwmi"
    alpha: float = 0.0
    confidence: float | None = None
    min_context: int = 1
    min_concept: int = 1
    min_correlation: float = 0.0
    min_similarity: float = 0.0
    max_in: int = 100
    totals: str = "all"

    def bound(self):
        return measure(self.measure, self.alpha, self.confidence)


def textfile_to_contexts(ws: Workspace, path: str, min_count: int = 1, window: int = 1, dictionary: str | None = None, recurrent_min: int | None = None, unique: bool = False) -> Workspace:
    """Lines to contexts: a vocabulary (or a dictionary file), windows over lines, recurrent concepts in at least
    `recurrent_min` contexts, and with `unique` the counts of equal sets."""
    spark = ws.spark
    lines = contexts.ranked(readers.tokenised_lines(spark, path), ["context_id"], "line").select(F.col("line").alias("context_id"), "tokens")
    tokens = contexts.indexed(lines, "context_id", "tokens").withColumnRenamed("concept_id", "label")
    vocab = readers.dictionary(spark, dictionary) if dictionary else contexts.vocabulary(tokens, min_count=min_count).select("concept_id", "label")
    rows = contexts.encode(tokens, vocab).select("context_id", "concept_id")
    rows = spool(contexts.moving_window(rows, window) if window >= 2 else rows, "contexts")
    basic, out = rows.distinct(), {"concepts": vocab}
    if recurrent_min is not None:
        found = contexts.ranked(concepts.find_recurrent(rows, recurrent_min), ["concept_id", "n"], "rec_id", RECURRENT_START)
        basic = basic.unionByName(concepts.activate_recurrent(rows, found))
        out["recurrent_concepts"] = found
    if unique:
        out["context_counts"] = spool(contexts.context_multisets(basic), "multisets")
        total = out["context_counts"].select("context_id", "context_count").distinct().agg(F.coalesce(F.sum("context_count"), F.lit(0)).alias("n"))
    else:
        out["contexts"] = basic
        total = rows.agg(F.countDistinct("context_id").alias("n"))
    return ws.write(**out, count=total)


def textfile_to_context_counts(ws: Workspace, path: str, width: int, min_count: int = 1) -> Workspace:
    """Lines to n-grams to contexts; the n-grams are stored as `<width>-grams` beside."""
    counted = spool(contexts.ngram_counts(readers.lines(ws.spark, path), "line", width), "ngrams")
    sinks.write_text(sinks.ngram_lines(counted), f"{ws.path.rstrip('/')}/{width}-grams")
    return ngrams_to_workspace(ws, counted, min_count)


def ngramfile_to_context_counts(ws: Workspace, path: str, min_count: int = 1) -> Workspace:
    return ngrams_to_workspace(ws, readers.ngram_file(ws.spark, path), min_count)


def ngrams_to_workspace(ws: Workspace, counted: DataFrame, min_count: int) -> Workspace:
    out = contexts.ngrams_to_context_counts(counted, min_count)
    return ws.write(concepts=out["concepts"], context_counts=out["context_counts"], recurrent_concepts=out["recurrent"], count=out["count"])


def contexts_to_correlations(ws: Workspace, s: GraphSettings) -> DataFrame:
    """Edges both ways with |weight| above the minimum, from context counts if there are any, else from contexts."""
    if ws["context-counts"] is not None:
        pairs = counts.pair_counts_from_contexts(ws["context-counts"], s.min_context, s.min_concept)
    else:
        pairs = counts.pair_counts(ws["contexts"], s.min_concept)
    return graph.correlations(pairs, s.bound(), ws["count"], s.min_correlation)


def pruned(edges: DataFrame, s: GraphSettings) -> EdgeData:
    return graph.prune(EdgeData.of(edges), s.min_correlation, s.max_in)


def contexts_to_graphs(ws: Workspace, s: GraphSettings, which: str = "all") -> Workspace:
    """Store the correlation graph (unpruned), the similarity graph of its pruned form, or both. A stored correlation graph
    is used for similarities alone."""
    if which not in ("all", "correlations", "similarities"):
        raise ValueError(which)
    if which != "similarities" or ws["correlations"] is None:
        ws = ws.write(correlations=contexts_to_correlations(ws, s))
    if which != "correlations":
        sims = graph.similarities(pruned(ws["correlations"], s), s.min_similarity, s.totals, non_negative=s.measure in NON_NEGATIVE)
        ws = ws.write(similarities=sims)
    return ws


def cluster_vertices(ws: Workspace, algorithm: str = "slpa", p: clustering.Parameters = clustering.Parameters(), min_correlation: float = 0.0, min_similarity: float = 0.0) -> Workspace:  # noqa: B008
    """Clusters of each graph that is there, of edges with at least the minimum weight."""
    run, out = clustering.algorithm(algorithm), {}
    for name, low, undirected in (("correlations", min_correlation, False), ("similarities", min_similarity, True)):
        if ws[name] is not None:
            own = p.with_(undirected=undirected or p.undirected, min_weight=low if p.min_weight is None else p.min_weight)
            out[name.removesuffix("s").replace("similaritie", "similarity") + "_clusters"] = run(graph.weight_filter(ws[name], low), own)
    return ws.write(**out)


def contexts_to_concepts(ws: Workspace, s: GraphSettings, algorithm: str = "slpa", p: clustering.Parameters = clustering.Parameters(), levels: int = 2, log_similarity: bool = False) -> Workspace:  # noqa: B008
    """Projected discovery, stored with the names of concepts and, for binary OR concepts, their trees."""
    n = ws["count"].first()[0]
    settings = concepts.Settings(
        s.bound(), n, clustering.algorithm(algorithm), p, levels, s.min_context, s.min_concept, s.min_correlation, s.min_similarity, s.max_in, log_similarity=log_similarity, totals=s.totals,
    )
    found = concepts.discover_projected(ws["context-counts"], settings)
    ws = ws.write(correlations=found.correlations, similarities=found.similarities, and_concepts=found.and_concepts, or_concepts=found.or_concepts, and_concept_lengths=concepts.and_sizes(found.and_concepts))
    groups = ws["and-concepts"].unionByName(ws["or-concepts"])
    names = sinks.nested_names(ws["concepts"], groups, ws["recurrent-concepts"])
    parents = groups.select(F.col("parent_id").alias("concept_id")).distinct()
    base = ws.path.rstrip("/")
    sinks.write_text(sinks.text_rows(names.join(parents, "concept_id", "left_semi").orderBy("concept_id"), " "), f"{base}/concept-names")
    labels = names.select("concept_id", F.col("name").alias("label"))
    sinks.write_text(sinks.newick(ws["or-concepts"], ws["similarities"], labels).orderBy("concept_id").select("tree"), f"{base}/trees", single=True)
    return ws


def export(ws: Workspace, what: str, form: str = "text", min_weight: float = float("-inf"), top: int = 1000) -> list[str]:
    """Write contexts, concepts or graphs as text or JSON below the workspace; gives the paths written."""
    base, out, names = ws.path.rstrip("/"), [], ws["concepts"]

    def put(rows: DataFrame, name: str) -> None:
        sinks.write_text(rows, f"{base}/{name}", single=True)
        out.append(f"{base}/{name}")

    if what == "contexts":
        put(sinks.context_lines(ws["contexts"], names), "contexts-text")
    elif what == "concepts":
        if ws["recurrent-concepts"] is not None:
            put(sinks.recurrent_lines(ws["recurrent-concepts"], names), "recurrent-text")
        for kind in ("correlation-clusters", "similarity-clusters"):
            if ws[kind] is not None:
                put(sinks.cluster_lines(ws[kind], names), f"{kind}-text")
        if ws["or-concepts"] is not None:
            groups = ws["or-concepts"] if ws["and-concepts"] is None else ws["or-concepts"].unionByName(ws["and-concepts"])
            for kind, rows in zip(("and", "or"), sinks.one_level_names(names, groups), strict=True):
                put(sinks.text_rows(rows), f"{kind}-concepts-text")
    elif what == "graphs":
        for kind in ("correlations", "similarities"):
            if ws[kind] is not None and form == "json":
                clusters = ws["correlation-clusters" if kind == "correlations" else "similarity-clusters"]
                put(sinks.graph_json(*sinks.graph_nodes_links(ws[kind], names, clusters, min_weight, top)), f"{kind}-json")
            elif ws[kind] is not None:
                put(sinks.top_edge_lines(graph.weight_filter(ws[kind], min_weight), names, top), f"{kind}-text")
    else:
        raise ValueError(what)
    return out


def statistics(ws: Workspace) -> dict[str, DataFrame]:
    """graph_statistics() of each graph that is there, stored as JSON too."""
    out = {}
    for kind in ("correlations", "similarities"):
        if ws[kind] is not None:
            out[kind] = stats.graph_statistics(ws[kind])
            sinks.write_text(sinks.statistics_json(out[kind]), f"{ws.path.rstrip('/')}/{kind}-statistics", single=True)
    return out


def bigram_similarities(bigrams: DataFrame, vertex_range: tuple[float, float] = (0.0, 1.0), edge_range: tuple[float, float] = (0.0, 1.0), max_in: int | None = 100, how: str = "conditional", top: int = 10_000) -> DataFrame:
    """Bigrams (a, b, n) to the most similar words: how is conditional, pmi or npmi; no cap prunes by ranges alone."""
    vertices, edges = graph.bigram_graph(bigrams)
    if how != "conditional":
        edges = graph.bigram_pmi(bigrams, normalised=how == "npmi")
    data = graph.range_pruned(vertices.withColumnRenamed("label", "id"), edges, vertex_range, edge_range, max_in)
    return graph.top_edges(graph.similarities(data, None), top)


def tweets_to_bigrams(spark: SparkSession, path: str, window: int = 2) -> DataFrame:
    """(a, b, n) of ordered pairs of words closer than `window` in tweets."""
    rows = readers.tweets(spark, path).select(F.monotonically_increasing_id().alias("id"), contexts.cleaned_tokens(F.col("text")).alias("tokens"))
    return contexts.window_pairs(rows, "id", "tokens", window).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cluster_similarities(edges: DataFrame, min_weight: float, vocab: DataFrame, p: clustering.Parameters = clustering.Parameters(weighted=False, capacity=20, undirected=True)) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Clusters of edges above `min_weight` as lines of vertices and edges for graph tools."""
    strong = edges.where(F.col("weight") > min_weight)
    return sinks.cluster_csv(strong, vocab, clustering.slpa_top_labels(strong, p))


def word_pair_benchmark(pairs: DataFrame, similarities: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, correlation): benchmark pairs (a, b, score) with the graph's weight, null where it has none, and the rank
    correlation over those that have both."""
    named = graph.labelled(similarities, labels)
    key = lambda x, y: F.concat_ws("\x00", F.least(x, y), F.greatest(x, y))
    own = named.select(key(F.col("src_label"), F.col("dst_label")).alias("k"), "weight").groupBy("k").agg(F.max("weight").alias("weight"))
    scored = own.join(pairs.withColumn("k", key(F.col("a"), F.col("b"))), "k", "right").select("a", "b", "score", "weight")
    return scored, stats.spearman(scored, "score", "weight")
