"""Command line: python -m siftline -path FOLDER [-config FILE] [-output FILE]."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def main(argv: list[str] | None = None) -> int:
    """0: no findings; 1: findings that are not filtered; 2: the scan could not run."""
    p = argparse.ArgumentParser(prog="siftline")
    p.add_argument("-config", help="YAML configuration; the shipped one if not given")
    p.add_argument("-stopwords", help="general stop-word list, one word a line")
    p.add_argument("-path", default=".")
    p.add_argument("-output", default="-", help="file for the findings as NDJSON, - for standard output")
    p.add_argument("-repo-config", action="store_true", help="let repositories bring their own configuration")
    p.add_argument("-scan", default="all", choices=["all", "source", "config"])
    p.add_argument("-show-filtered", action="store_true")
    p.add_argument("-version", action="version", version=__version__)
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from . import api
    from .plans.config import ConfigError, load_config, load_stopwords

    spark = SparkSession.builder.appName("siftline").getOrCreate()
    try:
        words = load_stopwords(args.stopwords) if args.stopwords else ()
        rules = load_config(args.config, words) if args.config else api.default_rules(words)
        if args.repo_config:
            found = api.scan_repositories(spark, args.path, rules, lambda path: load_config(path, words), args.scan, args.show_filtered)
        else:
            found = api.scan_path(spark, args.path, rules, args.scan, args.show_filtered)
        found = found.cache()
        lines = api.ndjson(found)
        if args.output == "-":
            for row in lines.toLocalIterator():
                print(row.value)
        else:
            with open(args.output, "w", encoding="utf-8") as f:
                f.writelines(row.value + "\n" for row in lines.toLocalIterator())
        return api.exit_status(found)
    except (ConfigError, OSError, ValueError) as e:
        print(f"siftline: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
