"""Command line: run, show, sort and diff.

    python -m tidemark.cli run my_module:graph --input events=/data/events.parquet --output /out
    python -m tidemark.cli show my_module:graph
    python -m tidemark.cli sort --input events=/data/events.csv --ts "ts" --output /sorted
    python -m tidemark.cli diff left.parquet right.parquet --order id

Every option may also come from the environment as TIDEMARK_<OPTION>; lists are separated by
commas there.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import diff_rows, sort_rows
from tidemark.plans import graph as G
from tidemark.plans.lower import Engine, TimeBound
from tidemark.session import build_session, clear_stages
from tidemark.sources.io import Inputs, write_csv


def pair(text: str) -> tuple[str, str]:
    """A `name=value` argument."""
    name, found, value = text.partition("=")
    if not found or not name or not value:
        raise argparse.ArgumentTypeError(f"not name=value: {text!r}")
    return name, value


def from_env(option: str, many: bool = False):
    value = os.environ.get(f"TIDEMARK_{option.upper()}")
    return value.split(",") if value is not None and many else value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="write the rows of a graph")
    run.add_argument("graph", help="module:attribute of an event or labelled event")
    run.add_argument("--input", action="append", type=pair, default=None, metavar="NAME=PATH")
    run.add_argument("--output", default=from_env("output"))
    run.add_argument("--format", choices=("csv", "parquet", "json"), default=from_env("format") or "csv")
    run.add_argument("--limit", type=int, default=from_env("limit"))
    run.add_argument("--logevery", type=int, default=from_env("logevery"), help="rows between lines of progress of a source")
    run.add_argument("--hot_rows", type=int, default=from_env("hot_rows"))
    run.add_argument("--inclusive_lower_ms", type=int, default=from_env("inclusive_lower_ms"))
    run.add_argument("--exclusive_upper_ms", type=int, default=from_env("exclusive_upper_ms"))
    show = commands.add_parser("show", help="what a graph reads and gives")
    show.add_argument("graph")
    sort = commands.add_parser("sort", help="rewrite inputs in time order")
    sort.add_argument("--input", action="append", type=pair, required=True, metavar="NAME=PATH")
    sort.add_argument("--ts", required=True, help="expression for the time")
    sort.add_argument("--order", nargs="*", default=[])
    sort.add_argument("--output", required=True)
    diff = commands.add_parser("diff", help="cells in which two tables differ, row by row")
    diff.add_argument("left")
    diff.add_argument("right")
    diff.add_argument("--order", nargs="+", required=True)
    diff.add_argument("--limit_in", type=int)
    diff.add_argument("--limit", type=int)
    return top


def load(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def describe(node, columns: list[str] | None = None) -> str:
    sources = G.sources_and_offsets_of(node)
    lines = [f"source {n}: offsets {', '.join(str(d) for d in sorted(offsets))}" for n, (_, offsets) in sorted(sources.items())]
    lines.append(f"lookups: {len(G.lookups_of(node))}")
    if columns is not None:
        lines.append(f"columns: {', '.join(columns)}")
    return "\n".join(lines)


def graph_columns(node) -> list[str] | None:
    """Names of the output columns, where they can be told without the inputs."""
    if isinstance(node, G.LabeledEvent):
        maps = [step for kind, step in node.steps if kind == "map"]
        return [n for n, _ in maps[-1]] if maps else None
    while isinstance(node, (G.Filtered,)) or type(node) is G.Keyed and isinstance(node.event, G.Mapped):
        node = node.event
    return [n for n, _ in node.exprs] if isinstance(node, G.Mapped) else None


def progress(df: DataFrame, name: str, every: int) -> DataFrame:
    """df, with a line to the task's log after every so many rows of a source."""

    def run(batches):
        done = 0
        for b in batches:
            before, done = done // every, done + b.num_rows
            if done // every > before:
                print(f"{name}: {done} rows", file=sys.stderr, flush=True)
            yield b

    return df.mapInArrow(run, df.schema)


def execute(args: argparse.Namespace, spark: SparkSession) -> str:
    if args.command == "show":
        node = load(args.graph)
        return describe(node, graph_columns(node))
    if args.command == "diff":
        sides = [Inputs.from_paths(spark, [("x", p)]).bound()["x"] for p in (args.left, args.right)]
        rows = diff_rows(*sides, args.order, args.limit_in, args.limit).orderBy("position", "column")
        return "\n".join(f"{r['position']} {r['column']}: {r['left']} | {r['right']}" for r in rows.toLocalIterator())
    if args.command == "sort":
        for name, df in Inputs.from_paths(spark, args.input).bound().items():
            write_csv(sort_rows(df, F.expr(args.ts), *args.order), f"{args.output}/{name}")
        return f"sorted into {args.output}"
    pairs = args.input or [pair(x) for x in from_env("input", many=True) or []]
    inputs = Inputs.from_paths(spark, pairs).bound()
    if args.logevery:
        inputs = {n: progress(df, n, int(args.logevery)) for n, df in inputs.items()}
    number = lambda x: None if x is None else int(x)
    bound = TimeBound(number(args.inclusive_lower_ms), number(args.exclusive_upper_ms))
    out = Engine(spark, inputs, bound, number(args.hot_rows)).run(load(args.graph), ordered=True, limit=number(args.limit))
    if not args.output:
        raise SystemExit("--output is missing")
    write_csv(out, args.output) if args.format == "csv" else out.write.format(args.format).save(args.output)
    return f"written to {args.output}"


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or build_session()
    print(execute(args, spark))
    clear_stages(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
