"""Command line: ``python -m relgraph.cli build|query|update|stats|viz``."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from relgraph import build, sinks
from relgraph.operators.retrieve import DEFAULT_DEPTH, DEPTHS


STORE = ".relgraph"


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="relgraph")
    p.add_argument("command", choices=["build", "query", "update", "stats", "viz"])
    p.add_argument("root")
    p.add_argument("question", nargs="?", default="")
    p.add_argument("--depth", choices=list(DEPTHS), default=DEFAULT_DEPTH)
    p.add_argument("--max-files", type=int)
    for flag in ("--docs", "--no-sync"):
        p.add_argument(flag, action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("relgraph").getOrCreate()
    folder = os.path.join(a.root, STORE)
    if a.command == "build":
        g = build.build_tree(spark, a.root, a.docs)
        sinks.save(g, folder)
        for name, text in (("map.md", sinks.repo_map(g)), ("report.md", sinks.report(g))):
            Path(folder, name).write_text(text, "utf-8")
        return 0
    if not os.path.isdir(os.path.join(folder, "nodes")):
        print("no graph here: build it first")
        return 1
    g = sinks.load(spark, folder)
    if a.command == "update" or (a.command == "query" and not a.no_sync):
        g, told = build.update(spark, g, a.root, a.docs)
        if a.command == "update":
            print(told.first().asDict())
            sinks.save(g, folder)
    if a.command == "query":
        print(build.answer(g, a.question, a.depth, a.max_files))
    elif a.command == "stats":
        print(sinks.summary(g).first().asDict())
    elif a.command == "viz":
        Path(folder, "graph.html").write_text(sinks.viewer(g, Path(a.root).resolve().name), "utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
