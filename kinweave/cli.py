"""Command line: contexts, graphs, higherorder, cluster, inspect, export, statistics, classify, experiment."""

from __future__ import annotations

import argparse
import json

from kinweave.operators.clustering import Parameters
from kinweave.plans import experiments, pipelines
from kinweave.runtime import session
from kinweave.sources.workspace import Workspace


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    top.add_argument("--local", action="store_true", help="run on this machine's cores")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *parts) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("-p", "--path", required=True, help="workspace folder")
        for part in parts:
            part(p)
        return p

    def measures(p):
        p.add_argument("-cf", "--measure", default="pwmi")
        p.add_argument("-mc", "--min-concept", type=int, default=1)
        p.add_argument("-mcc", "--min-context", type=int, default=1)
        p.add_argument("-ba", "--alpha", type=float, default=0.0)
        p.add_argument("-co", "--confidence", type=float, default=-1.0, help="below 0: none")
        p.add_argument("-md", "--max-in", type=int, default=100)
        p.add_argument("-mcr", "--min-correlation", type=float, default=0.0)
        p.add_argument("-msm", "--min-similarity", type=float, default=0.0)

    def clusters(p):
        p.add_argument("-cl", "--clustering", default="slpa")
        p.add_argument("-mci", "--iterations", type=int, default=10)
        p.add_argument("-uw", "--unweighted", action="store_true")

    c = command("contexts")
    c.add_argument("-if", "--input", required=True)
    c.add_argument("-f", "--form", choices=["text", "ngrams"], default="text")
    c.add_argument("-ws", "--window", type=int, default=5)
    c.add_argument("-mcc", "--min-count", type=int, default=1, help="of a context")
    g = command("graphs", measures)
    g.add_argument("-ca", "--which", choices=["all", "correlations", "similarities"], default="all")
    h = command("higherorder", measures, clusters)
    h.add_argument("-ml", "--levels", type=int, default=2)
    h.add_argument("-cth", "--concept-threshold", type=float, help="taken, without effect")
    k = command("cluster", clusters)
    k.add_argument("-mcr", "--min-correlation", type=float, default=0.0)
    k.add_argument("-msm", "--min-similarity", type=float, default=0.0)
    command("inspect")
    e = command("export")
    e.add_argument("-d", "--what", choices=["contexts", "concepts", "graphs"], required=True)
    e.add_argument("-f", "--form", choices=["text", "json"], default="text")
    e.add_argument("-nm", "--min-weight", type=float, default=float("-inf"))
    e.add_argument("-me", "--top", type=int, default=1000)
    command("statistics")
    command("classify")
    x = command("experiment")
    x.add_argument("-ca", "--which", choices=["simerrors", "maxdegreegraphprops", "minsimgraphprops"], required=True)
    x.add_argument("-v", "--values", type=float, nargs="+", required=True)
    return top


def _settings(a) -> pipelines.GraphSettings:
    return pipelines.GraphSettings(a.measure, a.alpha, a.confidence if a.confidence >= 0 else None, a.min_context, a.min_concept, a.min_correlation, a.min_similarity, a.max_in)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or session("kinweave", "local[*]" if a.local else None)
    ws = Workspace.load(spark, a.path)
    if a.command == "contexts":
        run = pipelines.textfile_to_context_counts if a.form == "text" else pipelines.ngramfile_to_context_counts
        run(ws, a.input, *([a.window] if a.form == "text" else []), a.min_count)
    elif a.command == "graphs":
        pipelines.contexts_to_graphs(ws, _settings(a), a.which)
    elif a.command == "higherorder":
        p = Parameters(iterations=a.iterations, weighted=not a.unweighted)
        pipelines.contexts_to_concepts(ws, _settings(a), a.clustering, p, a.levels)
    elif a.command == "cluster":
        pipelines.cluster_vertices(ws, a.clustering, Parameters(iterations=a.iterations, weighted=not a.unweighted), a.min_correlation, a.min_similarity)
    elif a.command in ("inspect", "classify"):  # classify has no stored model to apply: it shows what is there
        for name, rows in ws.inspect().items():
            print(name, "missing" if rows is None else rows)
    elif a.command == "export":
        print("\n".join(pipelines.export(ws, a.what, a.form, a.min_weight, a.top)))
    elif a.command == "statistics":
        for name, row in pipelines.statistics(ws).items():
            print(name, json.dumps(row.first().asDict()))
    else:
        run = {"simerrors": lambda v: experiments.similarity_errors(ws["correlations"], [int(x) for x in v]), "maxdegreegraphprops": lambda v: experiments.in_degree_sweep(ws["correlations"], [int(x) for x in v]), "minsimgraphprops": lambda v: experiments.similarity_sweep(ws["similarities"], v)}[a.which]
        run(a.values).write.mode("overwrite").parquet(f"{a.path.rstrip('/')}/{a.which}")
    if a.command != "inspect":
        ws.write_parameters(vars(a))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
