"""Command line: check files against a limit of findings, scan and rewrite folders, build training tables.

    python -m veridraft check [FILE ...] [--base-ref REF] [--threshold T] [--max-findings N]
    python -m veridraft scan FOLDER [--name FILE]
    python -m veridraft rewrite FOLDER [--name FILE] [--dry-run]
    python -m veridraft build LAKE OUT

Exit status: 0, or 1 where ``check`` finds more than it may.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.text import relative_path, report_line
from .operators import detect, rewrite, training
from .runtime import cut
from .sources import files, lake
from .taxonomy import taxonomy


def arguments(argv: list | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="veridraft", description="Checks and rewrites technical prose.")
    steps = parser.add_subparsers(dest="step", required=True)
    check = steps.add_parser("check", help="findings of files; status 1 if there are too many")
    check.add_argument("files", nargs="*", help="files to check")
    check.add_argument("--base-ref", help="check the files changed since this git reference instead")
    check.add_argument("--threshold", type=float, default=0.5, help="least confidence of a finding")
    check.add_argument("--max-findings", type=int, default=0, help="findings allowed")
    check.add_argument("--thresholds", help="JSON file of thresholds by rule")
    for name, text in (("scan", "report of every text file of a folder"), ("rewrite", "rewrites every text file of a folder")):
        step = steps.add_parser(name, help=text)
        step.add_argument("folder")
        step.add_argument("--name", help="only files of this name")
        if name == "rewrite":
            step.add_argument("--dry-run", action="store_true", help="tell what would change, write nothing")
    build = steps.add_parser("build", help="wide table, splits and rewrite pairs from the lake")
    build.add_argument("lake")
    build.add_argument("out")
    return parser.parse_args(argv)


def check(spark: SparkSession, args: argparse.Namespace, say: Callable = print, changed: Callable = files.changed_files) -> int:
    paths = changed(args.base_ref) if args.base_ref else args.files
    chosen = [r.path for r in files.targets(spark, paths).collect()] if paths else []  # the paths of the command line
    if not chosen:
        say("no text files to check")
        return 0
    told = None
    if args.thresholds:
        with open(args.thresholds, encoding="utf-8") as f:
            told = f.read()
    found = detect.gate_findings(files.read_files(spark, chosen), taxonomy(spark), files.thresholds(spark, told), args.threshold, key="path")
    lines = found.orderBy("file", "line", "char_start", "violation_name").select(report_line(F.col("file"), F.col("line"), F.col("violation_name"), F.col("confidence"), F.col("sentence_text")).alias("l"))
    n = 0
    for r in lines.toLocalIterator():  # a line each; never all of them at once
        say(r.l)
        n += 1
    passed = n <= args.max_findings
    say(f"{n} findings in {len(chosen)} files: " + ("passed" if passed else f"more than {args.max_findings} allowed"))
    return 0 if passed else 1


def scan(spark: SparkSession, args: argparse.Namespace, say: Callable = print) -> int:
    texts = files.read_texts(spark, args.folder, args.name)
    found = detect.scan_findings(texts.withColumn("path", relative_path(F.col("path"), args.folder)), "path")
    found = cut(found)
    top = detect.top_hits(found, "path", order=("line", "sentence", "match"))
    file, name = None, None
    for r in top.orderBy("path", "name", "rank").toLocalIterator():
        if r.path != file:
            say(f"\n{r.path}")
            file, name = r.path, None
        if r.name != name:
            say(f"  {r.name}" + (f" (and {r.more} more)" if r.more else ""))
            name = r.name
        say(f"    line {r.file_line}: {r.sentence}")
    say("")
    for r in detect.report_in_order(found, "path").collect():  # a row for each rule
        say(f"{r.findings:7d}  {r.name} ({r.files} files)")
    return 0


def rewrite_folder(spark: SparkSession, args: argparse.Namespace, say: Callable = print) -> int:
    texts = files.read_texts(spark, args.folder, args.name)
    done = rewrite.rewrite_documents(texts, "path").where("changed")
    # A table of its own: once files are written they can't be read as they were.
    rows = cut(done.select("path", "new_text", rewrite.change_lines(F.col("changes")).alias("lines"), "changes"))
    failed = 0 if args.dry_run else files.write_back(rows).where("not written").count()
    summary = rewrite.rewrite_summary(rows.withColumn("changed", F.lit(True))).orderBy("type").collect()  # a row for each pass
    n = 0
    for r in rows.select(relative_path(F.col("path"), args.folder).alias("path"), "lines").orderBy("path").toLocalIterator():
        say(r.path)
        for line in r.lines:
            say(f"    {line}")
        n += 1
    say(f"{n - failed} files " + ("would change" if args.dry_run else "rewritten") + (f", {failed} could not be written" if failed else ""))
    for r in summary:
        say(f"{r.entries:7d}  {r.type} ({r.hits} places)")
    return 1 if failed else 0


def build(spark: SparkSession, args: argparse.Namespace, say: Callable = print) -> int:
    def stored(name: str, kind) -> DataFrame:
        return lake.read_table(spark, f"{args.lake.rstrip('/')}/{name}", kind)

    trope = lake.read_taxonomy(spark, f"{args.lake.rstrip('/')}/trope", schema.TROPE)
    names = sorted(r.name for r in trope.select("name").collect())  # the taxonomy: a few dozen rows
    paths = training.build_training_tables(
        stored("sentence", schema.SENTENCE), stored("sentence_trope_label", schema.SENTENCE_TROPE_LABEL), stored("sentence_rewrite", schema.SENTENCE_REWRITE), trope, args.out, names
    )
    for name, path in paths.items():
        say(f"{name}: {spark.read.parquet(path).count()} rows in {path}")
    return 0


STEPS = {"check": check, "scan": scan, "rewrite": rewrite_folder, "build": build}


def main(argv: list | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("veridraft").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return STEPS[args.step](spark, args)


if __name__ == "__main__":
    sys.exit(main())
