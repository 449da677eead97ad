"""python -m cairnlight extract|metrics|deps|config ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .sources import config


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairnlight")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "metrics", "deps"):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("--output")
        s.add_argument("--format", choices=("json", "markdown", "graphql", "rag"), default="json")
        s.add_argument("--include-private", action=argparse.BooleanOptionalAction, default=None)
        s.add_argument("--include-docs", action=argparse.BooleanOptionalAction, default=None)
    c = sub.add_parser("config")
    c.add_argument("action", choices=("show", "init", "validate", "template"))
    c.add_argument("file", nargs="?", default=config.NAMES[0])
    c.add_argument("--preset", choices=sorted(config.PRESETS))
    args = p.parse_args(argv)
    if args.command == "config":
        chosen = config.Config().merged(config.PRESETS[args.preset]) if args.preset else config.Config()
        if args.action == "validate":
            config.load(args.file)
            print("valid")
        elif args.action == "init":
            Path(args.file).write_text(chosen.to_toml())
        else:
            print((config.find(Path(args.file).parent) if args.action == "show" and not args.preset else chosen).to_toml(), end="")
        return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import elements, graph, metrics, rag
    from .sources import sinks, tree

    spark = SparkSession.builder.appName("cairnlight").getOrCreate()
    chosen = config.find(args.root).merged({"include_private": args.include_private, "include_docs": args.include_docs})
    options = tree.ExtractOptions(chosen.include, chosen.exclude, chosen.max_file_size, chosen.include_private, chosen.include_docs)
    info = tree.manifest(spark, f"{args.root}/Cargo.toml", Path(args.root).name)
    parsed = tree.parse(tree.discover(spark, args.root, options), info["name"], options).persist()
    t = tree.tables(parsed)
    tree.check_success(t["files"], options.least_success)
    if args.command == "metrics":
        rows = metrics.long_metrics(t["elements"])
    elif args.command == "deps":
        rows = graph.call_edges(elements.resolve_references(t["references"], t["elements"], t["imports"]), t["elements"])
    elif args.format == "markdown":
        rows = sinks.markdown(t["elements"], info["name"]).select(F.col("section").alias("value"))
    elif args.format == "graphql":
        rows = spark.createDataFrame([(sinks.graphql_schema(info["name"]),)], "value string")
    elif args.format == "rag":
        rows = sinks.rag_jsonl(rag.chunks(t["elements"]), info)
    else:
        rows = sinks.json_rows(t["elements"])
    if rows.columns != ["value"]:
        rows = sinks.json_rows(rows)
    if args.output:
        rows.coalesce(1).write.mode("overwrite").text(args.output)
    else:
        for r in rows.toLocalIterator():
            sys.stdout.write(r["value"] + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
