"""Command line: process, batch, snapshots, search, stats, config, reset, export."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagestrata.config import PRESETS, choose_config, save_config
from pagestrata.errors import PageError
from pagestrata.functions.text import shorten
from pagestrata.functions.validate import existing_dir, existing_file
from pagestrata.operators.stats import batch_summary, failures
from pagestrata.plans.pipeline import Pipeline
from pagestrata.sources.snapshots import glob_files, single_file


def parser() -> argparse.ArgumentParser:
    """The argument parser of all commands."""
    top = argparse.ArgumentParser(prog="pagestrata")
    top.add_argument("--preset", choices=sorted(PRESETS))
    top.add_argument("--config")
    top.add_argument("--collection", dest="collection_name")
    top.add_argument("--directory", dest="persist_directory")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("process", help="one html file")
    p.add_argument("file")
    p.add_argument("--url")
    p.add_argument("--force-basic", action="store_true")
    p = sub.add_parser("batch", help="html files of a directory")
    p.add_argument("source")
    p.add_argument("--pattern", default="*.html")
    p.add_argument("--force-basic", action="store_true")
    p = sub.add_parser("snapshots", help="a snapshot directory")
    p.add_argument("source")
    p.add_argument("--require-metadata", action="store_true")
    p.add_argument("--domain", action="append", default=[])
    p.add_argument("--year", action="append", type=int, default=[])
    p.add_argument("--min-length", type=int, default=100)
    p = sub.add_parser("search", help="nearest chunks")
    p.add_argument("query")
    p.add_argument("-n", type=int, default=10)
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--where", help="filter as JSON")
    p.add_argument("--format", choices=("table", "json"), default="table")
    sub.add_parser("stats", help="what the collection holds")
    p = sub.add_parser("config", help="show or save settings")
    p.add_argument("--save")
    p = sub.add_parser("reset", help="empty the collection")
    p.add_argument("--yes", action="store_true")
    p = sub.add_parser("export", help="write the collection")
    p.add_argument("file")
    p.add_argument("--format", choices=("json", "csv"), default="json")
    p.add_argument("--sharded", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 0 where it succeeded."""
    args = parser().parse_args(argv)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    try:
        config = choose_config(args.preset, args.config, collection_name=args.collection_name, persist_directory=args.persist_directory)
        if args.command == "config":
            if args.save:
                save_config(config, args.save)
            say(config.as_dict())
            return 0
        spark = spark or SparkSession.builder.appName("pagestrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        pipe = Pipeline(spark, config)
        match args.command:
            case "process":
                results = pipe.process_documents(single_file(spark, existing_file(args.file), args.url), args.force_basic)
            case "batch":
                results = pipe.process_documents(glob_files(spark, existing_dir(args.source), args.pattern), args.force_basic)
            case "snapshots":
                results = pipe.process_snapshots(existing_dir(args.source), require_metadata=args.require_metadata, domain_filters=tuple(args.domain), year_filters=tuple(args.year), min_content_length=args.min_length)
            case "search":
                hits = pipe.search(args.query, args.n, json.loads(args.where) if args.where else None, args.threshold)
                rows = hits.collect()
                if args.format == "json":
                    say([r.asDict(recursive=True) for r in rows])
                else:
                    hits.select(F.round("similarity_score", 4).alias("score"), shorten(F.col("text"), 100).alias("text"), F.col("metadata")["url"].alias("url")).show(args.n, truncate=False)
                return 0
            case "stats":
                say(pipe.stats() | {"database": pipe.database_stats()})
                return 0
            case "reset":
                if not args.yes and input("Empty the collection? [y/N] ").strip().lower() != "y":
                    return 1
                pipe.reset()
                return 0
            case _:
                pipe.export(args.file, args.format, args.sharded)
                return 0
        summary = batch_summary(results).first().asDict()
        say(summary | {"failures": [r.asDict() for r in failures(results).limit(20).collect()]})
        pipe.cleanup()
        return 0 if summary["successful"] or not summary["total"] else 1
    except PageError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
