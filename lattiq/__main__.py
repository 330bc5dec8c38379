"""Command line: ``python -m lattiq vis ...`` and ``python -m lattiq evaluate ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattiq.functions.lineage import saved
from lattiq.operators import metrics
from lattiq.plans.pipelines import Options, evaluate, run
from lattiq.sources import files

MEASURES = ("jaccard", "stress", "stress_neighbour", "kl")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattiq")
    sub = p.add_subparsers(dest="command", required=True)
    vis = sub.add_parser("vis", help="lay out vectors (mode 0) or a graph (mode 1)")
    vis.add_argument("-mode", type=int, choices=(0, 1), required=True)
    vis.add_argument("-input", required=True)
    vis.add_argument("-output", required=True)
    vis.add_argument("-label", help="labels of the vectors: prints the accuracy of a kNN classifier on the layout")
    for name, kind in (("samples", int), ("negatives", int), ("klevel", int), ("multilevel", int), ("alpha", float), ("gamma", float), ("perplexity", float), ("a", float), ("b", float), ("dismax", int), ("k", int), ("knn_type", str), ("kind", str), ("epochs", int), ("seed", int)):
        vis.add_argument(f"-{name}", type=kind)
    vis.add_argument("-evaluation", type=int, default=0)
    ev = sub.add_parser("evaluate", help="measure a layout of a graph")
    ev.add_argument("-type", type=int, choices=range(4), required=True, help=", ".join(f"{i} {m}" for i, m in enumerate(MEASURES)))
    ev.add_argument("-graph", required=True)
    ev.add_argument("-layout", required=True)
    ev.add_argument("-dismax", type=int, default=2)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lattiq").getOrCreate()
    if args.command == "evaluate":
        edges, positions = files.read_graph(spark, args.graph), files.read_layout(spark, args.layout)
        evaluate(MEASURES[args.type], edges, positions, args.dismax).show(truncate=False)
        return
    given = {k: v for k, v in vars(args).items() if k in Options.__dataclass_fields__ and v is not None}
    options = Options(**given | ({"multilevel": bool(given["multilevel"])} if "multilevel" in given else {}))
    data = saved((files.read_vectors if args.mode == 0 else files.read_graph)(spark, args.input))
    positions = saved(run(args.mode, data, options))
    files.write_layout(positions, args.output)
    if args.evaluation and args.mode == 1:
        metrics.stress(data, positions).show(truncate=False)
        metrics.jaccard(data, positions, 2).show(truncate=False)
    if args.evaluation and args.mode == 0 and args.label:
        metrics.knn_accuracy(positions.select("id", F.array("x", "y").alias("v")), files.read_labels(spark, args.label)).orderBy("k").show()


if __name__ == "__main__":
    main()
