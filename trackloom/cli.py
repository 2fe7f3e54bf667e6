"""Command line: ``python -m trackloom.cli build|validate ...``.

build     all tables of the matches of a JSON catalogue ({provider: {match id: arguments}}), a summary, and the size;
          exit status 1 if a match failed, 2 if the tables are over ``--max-mb``
validate  the reports over what has been built, and with ``--matches`` the sensitivity of its first match (or of
          ``--match-id``); exit status 1 if a check failed or nothing has been built
"""

from __future__ import annotations

import argparse
import copy
import json
import sys
from dataclasses import replace

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import SparkSession

from .config import DEFAULTS, Run, read_settings
from .plans import match, report
from .sources import Provider


def _providers(spark: SparkSession, args: argparse.Namespace) -> list[Provider]:
    text = "\n".join(r[0] for r in spark.read.text(args.matches, wholetext=True).collect())  # one small file
    found = [Provider.of_catalogue(spark, name, own) for name, own in json.loads(text).items() if args.provider in (None, name)]
    return [replace(p, matches={k: v for k, v in p.matches.items() if args.match_id in (None, k)}) for p in found]


def build(spark: SparkSession, args: argparse.Namespace, run: Run) -> int:
    status = 0
    try:
        match.run_all(_providers(spark, args), run)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        status = 1
    try:
        match.run_summary(spark, run.path).write.mode("overwrite").parquet(f"{run.path}/summary")
    except AnalysisException:
        return 1  # nothing has been written
    size = match.written_bytes(spark, run.path) / 1e6
    print(f"{size:.1f} MB in {run.path}")
    return status or (2 if size > args.max_mb else 0)


def validate(spark: SparkSession, args: argparse.Namespace, run: Run) -> int:
    try:
        found = report.validation_report(spark, run, args.reports)
    except AnalysisException as e:
        print(f"nothing has been built in {run.path}: {e}", file=sys.stderr)
        return 1
    s = found["summary"]
    print(f"{s['n_pass']} of {s['n_checks']} checks pass")
    if args.matches:
        provider = next((p for p in _providers(spark, args) if p.list_matches()), None)
        if provider is None:
            print(f"no such match in {args.matches}", file=sys.stderr)
            return 1
        match_id = provider.list_matches()[0]
        try:
            swept = report.sensitivity_report(provider.load(match_id), run, provider.load_meta(match_id).frame_rate, args.reports)
        except PySparkException as e:  # a match without sprints at the baseline has no spreads
            print(f"no sensitivity of {match_id}: {e}", file=sys.stderr)
            return 1
        print(swept["headline"]["sentence"])
    return report.exit_status(found)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=("build", "validate"))
    parser.add_argument("--config")
    parser.add_argument("--path", required=True, help="folder of the tables")
    parser.add_argument("--matches", help="catalogue, for build, and for the sensitivity of validate")
    parser.add_argument("--reports", help="folder of the reports, for validate")
    parser.add_argument("--target-hz", type=float)
    parser.add_argument("--provider")
    parser.add_argument("--match-id")
    parser.add_argument("--no-space", action="store_true")
    parser.add_argument("--max-mb", type=float, default=300.0)
    args = parser.parse_args(argv)
    if args.command == "build" and not args.matches or (args.command == "validate") != bool(args.reports):
        parser.error("build takes --matches, validate takes --reports")
    spark = SparkSession.builder.getOrCreate()
    run = Run(args.path, read_settings(spark, args.config) if args.config else copy.deepcopy(DEFAULTS), args.target_hz, not args.no_space)
    return (build if args.command == "build" else validate)(spark, args, run)


if __name__ == "__main__":
    raise SystemExit(main())
