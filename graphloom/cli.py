"""Command line: build a graph from source files, then query it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import build as graph
from .api import Engine
from .operators import search
from .plans import fixture
from .server import http_server, rows, serve
from .sources import extract, workspace


def build(spark: SparkSession, path: str, out: str, branch: str = "master", mapping: dict[str, str] | None = None) -> dict[str, int]:
    """Scan, extract, resolve, group, trace and index; each table is written under ``out``. Counts of what was written."""
    return graph.build(extract.scan(spark, path, graph.EXCLUDE), out, branch, mapping)


def update(spark: SparkSession, files: list[str], out: str, branch: str = "master", mapping: dict[str, str] | None = None) -> dict[str, int]:
    """The graph under ``out`` with these files as they are now; those that are no longer there go."""
    import os

    there = [f for f in files if os.path.exists(f)]
    found = extract.scan(spark, there, graph.EXCLUDE) if there else spark.createDataFrame([], "path string, source string, error string")
    return graph.update(found, out, branch, mapping, removed=[f for f in files if f not in there])


def load(spark: SparkSession, args) -> Engine:
    if args.tables:
        return Engine(fixture.functions(spark, args.tables), fixture.calls(spark, args.tables), fixture.members(spark, args.tables))
    at = graph.current(spark, args.graph)
    read = lambda k: spark.read.parquet(f"{at}/{k}")
    return Engine(read("functions"), read("calls"), read("members"), read("belongs"), branch=args.branch, classes=read("classes"), index=search.Index(spark, f"{at}/index"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="extract a graph from source files")
    b.add_argument("--path", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--branch", default="master")
    b.add_argument("--mapping", help="YAML file of path prefixes and their domains")
    u = sub.add_parser("update", help="take changed files into a graph")
    u.add_argument("files", nargs="+")
    u.add_argument("--graph", default="graph")
    u.add_argument("--branch", default="master")
    u.add_argument("--mapping")
    m = sub.add_parser("mapping", help="propose a mapping of folders to domains")
    m.add_argument("--path", required=True)
    m.add_argument("--out", required=True)
    for name in ("call-chain", "impact", "context", "search", "process", "detect-changes", "sql", "stats", "serve", "http"):
        q = sub.add_parser(name)
        if name not in ("stats", "serve", "http"):
            q.add_argument("what")
        if name == "http":
            q.add_argument("--port", type=int, default=8080)
        q.add_argument("--depth", type=int, default=5)
        q.add_argument("--graph", default="graph")
        q.add_argument("--tables", help="folder of star tables to read as a graph")
        q.add_argument("--branch", default="master")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    if args.command == "mapping":
        workspace.write_mapping(workspace.generate_mapping(workspace.listing(spark, args.path), args.path), args.out)
        return 0
    mapping = workspace.load_mapping(args.mapping) if getattr(args, "mapping", None) else None
    if args.command in ("build", "update"):
        got = build(spark, args.path, args.out, args.branch, mapping) if args.command == "build" else update(spark, args.files, args.graph, args.branch, mapping)
        print(json.dumps(got))
        return 0
    engine = load(spark, args)
    if args.command == "http":
        http_server(engine, args.port, rebuild=None if args.tables else lambda path, branch: update(spark, [path], args.graph, branch), reload=None if args.tables else lambda: load(spark, args)).serve_forever()
        return 0
    if args.command == "serve":
        serve(engine)
        return 0
    if args.command == "detect-changes":
        lines = open(args.what).read().split("\n")  # a diff on the driver, made by git there
        got = rows(engine.detect_changes(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "diff_id int, n int, line string")))
    elif args.command == "context":
        got = {k: rows(v) for k, v in engine.context(args.what).items()}
    elif args.command == "stats":
        got = {"totals": rows(engine.stats()), **{k: rows(v) for k, v in engine.risk().items()}}
    else:
        ask = {"call-chain": lambda: engine.call_chain(args.what, args.depth), "impact": lambda: engine.impact_scope(args.what, args.depth), "search": lambda: engine.search(args.what), "process": lambda: engine.process(args.what), "sql": lambda: engine.sql(args.what)}
        got = rows(ask[args.command]())
    print(json.dumps(got, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
