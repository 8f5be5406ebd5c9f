"""Command line: automatic features of a folder of files."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import SparkSession

from .plans import Edge, EntityGraph, FeaturePolicy, LabelSpec, Source, Table, Window, plan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relgrain", description="Automatic point-in-time features of a folder of tables, one row per row of the target.")
    p.add_argument("folder", help="folder with a file per table; the format is told by the extension")
    p.add_argument("--target", required=True, help="file name of the target table")
    p.add_argument("--prefixes", required=True, help='JSON: {"file": "prefix"}')
    p.add_argument("--keys", required=True, help='JSON: {"file": "key column"}')
    p.add_argument("--times", default="{}", help='JSON: {"file": "time column"}')
    p.add_argument("--edges", required=True, help='JSON: [{"parent": file, "child": file, "parent_key": column, "child_key": column}]')
    p.add_argument("--cut", required=True, help="cut date, as 2023-06-30 or 2023-06-30T12:00:00")
    p.add_argument("--lookback", type=float, default=365, help="days before the cut")
    p.add_argument("--hops", type=int, default=None, help="how far below the target to go; all the way if not given")
    p.add_argument("--front-hops", type=int, default=0)
    p.add_argument("--label", default=None, help='JSON: {"table": file, "op": operation, "field": column, "days": horizon}')
    p.add_argument("--output", default=None, help="where to write; without it the plan is printed")
    p.add_argument("--output-format", default="parquet")
    return p


def graph(args: argparse.Namespace) -> EntityGraph:
    prefixes, keys, times = (json.loads(x) for x in (args.prefixes, args.keys, args.times))
    label = json.loads(args.label) if args.label else None
    tables = tuple(
        Table(f, Source(path=os.path.join(args.folder, f), format=os.path.splitext(f)[1].lstrip(".") or "parquet"), prefixes[f], keys[f], times.get(f)) for f in prefixes
    )
    window = Window(datetime.fromisoformat(args.cut), (args.lookback, "day"), (label["days"], "day") if label else None)
    labels = (LabelSpec(label["table"], label["op"], label["field"]),) if label else ()
    return EntityGraph(tables, tuple(Edge(**e) for e in json.loads(args.edges)), args.target, window, FeaturePolicy(), labels, args.hops, args.front_hops)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    steps = plan(graph(args))
    if not args.output:
        print(steps.explain())
        return
    spark = SparkSession.builder.appName("relgrain").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = steps.run(spark)
    csv = args.output_format in ("csv", "tsv")
    writer = df.write.mode("overwrite").format("csv" if csv else args.output_format)
    (writer.options(header=True, sep="\t" if args.output_format == "tsv" else ",") if csv else writer).save(args.output)
