"""python -m sieveline: scan files, repositories, standard input; work with configurations and fingerprints."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .config import Config, default_config, load_config
from .functions import text


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sieveline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _config(arguments) -> Config:
    config = load_config(arguments.config) if arguments.config else default_config()
    if arguments.only:
        config = config.only(set(arguments.only))
    if arguments.disable:
        config = config.without(set(arguments.disable))
    return config


def _scan(arguments) -> int:
    from .operators import report, summary
    from .operators.redact import redact
    from .operators.scan import Scanner
    from .sources import chunks, git, remote

    spark = _session()
    kind = arguments.command if arguments.command != "auto" else remote.detect_source(arguments.target)[0]
    if kind in ("filesystem", "fs"):
        fragments = chunks.read_files(spark, arguments.target, arguments.archive_depth, arguments.max_bytes)
    elif kind == "git":
        fragments = git.staged(spark, arguments.target) if arguments.staged else git.history(spark, arguments.target)
    elif kind == "stdin":
        fragments = chunks.stdin_fragments(spark, sys.stdin.buffer.read())
    elif kind == "s3":
        fragments = chunks.read_objects(spark, arguments.target.replace("s3://", "s3a://"), arguments.archive_depth)
    else:
        raise SystemExit(f"{kind} needs a network client; use the Python interface and give one")
    ignored = frozenset(text.load_ignore(open(arguments.ignore_file).read())[0]) if arguments.ignore_file else frozenset()
    scanner = Scanner(_config(arguments), decode_depth=arguments.decode_depth, min_confidence=arguments.min_confidence, ignored=ignored, ranks_path=arguments.ranks, words_path=arguments.words)
    excluded = tuple(x for x in (arguments.report,) if x)
    found = scanner.scan(fragments, excluded).cache()
    if arguments.redact is not None:
        found = redact(found, arguments.redact)
    row = summary.scan_summary(found).first().asDict()
    out = open(arguments.report, "w", encoding="utf-8") if arguments.report else sys.stdout
    if arguments.format == "json":
        report.write_json(report.as_dicts(found), out, row)
    else:
        for finding in report.as_dicts(found):
            print(report.pretty(finding) if arguments.format == "pretty" else report.dumps(finding), file=out)
    return report.exit_code(row["num_findings"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sieveline")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("auto", "filesystem", "fs", "git", "stdin", "s3"):
        p = commands.add_parser(name)
        if name != "stdin":
            p.add_argument("target")
        p.add_argument("--config")
        p.add_argument("--only", action="append")
        p.add_argument("--disable", action="append")
        p.add_argument("--decode-depth", type=int, default=5)
        p.add_argument("--archive-depth", type=int, default=8)
        p.add_argument("--max-bytes", type=int)
        p.add_argument("--min-confidence", default="")
        p.add_argument("--ignore-file")
        p.add_argument("--ranks", help="a .tiktoken file, for token ratios")
        p.add_argument("--words", help="a word list, for token efficiency")
        p.add_argument("--redact", type=float)
        p.add_argument("--report")
        p.add_argument("--format", choices=("json", "jsonl", "pretty"), default="pretty")
        p.add_argument("--staged", action="store_true")
    p = commands.add_parser("config")
    p.add_argument("what", choices=("show", "ids", "check", "hash"))
    p.add_argument("--config")
    p = commands.add_parser("fingerprint")
    p.add_argument("value")
    p.add_argument("--key")
    commands.add_parser("version")
    return top


def main(argv: list[str] | None = None) -> int:
    arguments = parser().parse_args(argv)
    if arguments.command == "version":
        print(__version__)
    elif arguments.command == "fingerprint":
        print(text.fingerprint(arguments.value, arguments.key.encode() if arguments.key else None))
    elif arguments.command == "config":
        config = load_config(arguments.config) if arguments.config else default_config()
        if arguments.what == "ids":
            print("\n".join(sorted(r.id for r in config.rules)))
        elif arguments.what == "show":
            for r in config.rules:
                print(f"{r.id}\t{r.confidence}\t{r.regex}")
        elif arguments.what == "hash":
            print(config.hash())
        else:
            print(f"{len(config.rules)} rules")
    else:
        return _scan(arguments)
    return 0
