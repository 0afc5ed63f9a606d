"""Command line: inspect a folder, clean it, list the variants."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern", description="Prepare text corpora on Spark.")
    parser.add_argument("--version", action="version", version=__version__)
    sub = parser.add_subparsers(dest="command", required=True)
    look = sub.add_parser("inspect", help="regions, words and cover of each document")
    look.add_argument("path")
    look.add_argument("--all", action="store_true", help="every region instead of totals per label")
    clean = sub.add_parser("clean", help="write cleaned variants, logs and the review queue")
    clean.add_argument("path")
    clean.add_argument("--out", required=True)
    clean.add_argument("--variants", default="", help="comma-separated names")
    clean.add_argument("--keep", default="", help="comma-separated labels: a variant of its own that keeps just these")
    clean.add_argument("--name", default="custom", help="name of that variant")
    clean.add_argument("--decisions", help="a review queue with answers")
    for flag in ("drop-furniture", "drop-interface", "dehyphenate", "reflow", "drop-headings"):
        clean.add_argument(f"--{flag}", action="store_true")
    clean.add_argument("--footnotes", choices=["retain", "remove", "extract"], default="retain")
    for command in (look, clean):
        command.add_argument("--master", help="Spark master; by default that of spark-submit, else this machine")
    sub.add_parser("list-variants", help="names and meanings of the variants")
    args = parser.parse_args(argv)
    from .operators import render

    if args.command == "list-variants":
        for v in render.BUILTIN.values():
            print(f"{v.name:20} {v.description}")
        return 0
    from pyspark.errors import PySparkException

    from .api import CorpusSession
    from .session import local_session

    def _session(master: str | None):
        from pyspark import SparkConf
        from pyspark.sql import SparkSession

        if master is None and not SparkConf().contains("spark.master"):
            return local_session()
        builder = SparkSession.builder.appName("lectern")
        return (builder.master(master) if master else builder).getOrCreate()

    try:
        names = [x for x in args.variants.split(",") if x] if args.command == "clean" else []
        chosen = list(render.resolve(names)) if names else []
        if args.command == "clean" and args.keep:
            chosen.append(render.custom(args.name, [x for x in args.keep.split(",") if x]))
        session = CorpusSession(_session(args.master))
        docs = session.read(args.path)
        if args.command == "inspect":
            a = session.analyse(docs)
            rows = (a.regions.orderBy("doc_id", "region_idx") if args.all else a.inspect().orderBy("doc_id", "label")).join(docs.select("doc_id", "name"), "doc_id", "left")
            print("\t".join(rows.columns))
            for row in rows.toLocalIterator():  # all rows, a partition at a time
                print("\t".join("" if x is None else str(x) for x in row))
            print("uncovered lines:", a.uncovered().count())
        else:
            options = {k: getattr(args, k) for k in ("drop_furniture", "drop_interface", "dehyphenate", "reflow", "drop_headings", "footnotes") if getattr(args, k) not in (False, "retain")}
            session.prepare(docs, args.out, chosen or None, args.decisions, options)
    except (ValueError, PySparkException) as e:
        print(f"lectern: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
