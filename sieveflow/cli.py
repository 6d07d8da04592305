"""``python -m sieveflow.cli scan PATH --rules DIR``: a scan from the command line. Exit status 1 where ``--fail-on`` is reached."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveflow import debug, engine
from sieveflow.functions.durable import cut, exists
from sieveflow.operators import post
from sieveflow.rules.load import load_rule_dirs, load_rules, verify
from sieveflow.rules.model import RuleSet
from sieveflow.schemas import parse_severity
from sieveflow.sinks import report
from sieveflow.sources import code, corpus
from sieveflow.streaming import stream


def positive(text: str) -> int:
    if (n := int(text)) <= 0:
        raise argparse.ArgumentTypeError("must be above 0")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveflow")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    s.add_argument("--rules", action="append", required=True)
    s.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    s.add_argument("--report-dir", metavar="FOLDER", help="write a JSON or SARIF report there in parts, whatever its size, and print none")
    s.add_argument("--fail-on")
    s.add_argument("--threads", type=positive, default=os.cpu_count())
    s.add_argument("--exclude", default="")
    s.add_argument("--no-default-exclude", action="store_true")
    s.add_argument("--max-file-size", type=positive, default=corpus.MAX_FILE_SIZE)
    s.add_argument("--suppress-comment", default=corpus.SUPPRESS_COMMENT)
    s.add_argument("--baseline")
    s.add_argument("--write-baseline")
    s.add_argument("--cache-dir")
    s.add_argument("--metrics")
    s.add_argument("--times", metavar="FILE", help="write how long each rule and each file took")
    s.add_argument("--errors", metavar="FILE", help="write files that couldn't be parsed, and rules that failed or took too long over a file")
    s.add_argument("--rule-timeout", type=positive, metavar="MS", help="how long a rule may take over a file; what is skipped is told on stderr, or in --errors")
    s.add_argument("--stream", metavar="FOLDER", help="analyse the files as a stream whose state is kept in FOLDER: what was told in an earlier run isn't told again")
    s.add_argument("--no-aliases", action="store_true", help="look for calls under their own names only")
    s.add_argument("--dump-taints", metavar="FILE", help="write what functions return or take that is tainted")
    s.add_argument("--apply-fixes", metavar="FOLDER", help="write fixed copies there")
    v = sub.add_parser("verify")
    v.add_argument("path")
    i = sub.add_parser("inspect")
    i.add_argument("path")
    return p


def ignore_texts(root: str) -> list[str]:
    found = []
    for name in (".gitignore", ".sastignore"):
        if os.path.isfile(f := os.path.join(root, name)):
            with open(f, encoding="utf-8") as h:
                found.append(h.read())
    return found


def streamed(a: argparse.Namespace, spark: SparkSession, root: str, rules: RuleSet, baseline: DataFrame | None, limit: float | None) -> DataFrame:
    """Findings of files that came since the last run with this state, each told once over all runs."""
    patterns = corpus.excludes([x for x in a.exclude.split(",") if x], not a.no_default_exclude, ignore_texts(root))
    files = stream.file_stream(spark, root, a.suppress_comment)
    files = files.where(~corpus.is_excluded("file_path", patterns, F.col("size"), a.max_file_size))
    before = spark.read.schema("id string").parquet(f"{a.stream}/told").select("id") if exists(spark, f"{a.stream}/told") else None
    before = cut(before, "before") if before is not None else None
    stream.analyze_stream(files, rules, f"{a.stream}/told", f"{a.stream}/state", baseline=baseline, time_limit=limit).awaitTermination()
    found = stream.findings(spark, f"{a.stream}/told")
    return found if before is None else found.join(before, "id", "left_anti")


def scan(a: argparse.Namespace, spark: SparkSession) -> int:
    rules = load_rule_dirs(a.rules)
    root = os.path.abspath(a.path)
    files = corpus.load_corpus(
        spark, root, [x for x in a.exclude.split(",") if x], not a.no_default_exclude, ignore_texts(root), a.max_file_size, a.suppress_comment
    )
    baseline = post.read_baseline(spark, a.baseline) if a.baseline else None
    failed: list = []
    limit = a.rule_timeout / 1000 if a.rule_timeout else None
    if a.stream:
        found = streamed(a, spark, root, rules, baseline, limit)
    else:
        found = engine.analyze(
            files, engine.prune(files, rules), baseline=baseline, cache=a.cache_dir, aliases=not a.no_aliases, failed=failed if a.errors else None, time_limit=limit
        ).cache()
    if a.report_dir:
        report.write_report(found, a.report_dir, a.format)
    else:
        print(report.report(found, a.format, {"files": files.count(), "rules": len(rules.rules)} if a.format == "text" else None))
    if a.write_baseline:
        with open(a.write_baseline, "w", encoding="utf-8") as f:
            json.dump([r.asDict() for r in found.select("id", "file", "line").distinct().collect()], f, indent=2)
    if a.metrics:
        row = engine.metrics(found, files)
        print(json.dumps(row.first().asDict()), file=sys.stderr) if a.metrics == "-" else report.write_metrics(row, a.metrics)
    if a.errors:
        bad = files.where(F.col("parse_status") != "ok").select(F.lit(None).cast("string").alias("rule_id"), F.col("file_path").alias("file"), F.col("parse_status").alias("error"))
        told = engine.rule_errors(failed, engine.prune(files, rules))
        with open(a.errors, "w", encoding="utf-8") as f:
            json.dump([r.asDict() for r in (bad if told is None else bad.unionByName(told)).orderBy("file", "rule_id").collect()], f, indent=2)
    if a.times:
        spent = engine.rule_times(files, engine.prune(files, rules), limit)
        with open(a.times, "w", encoding="utf-8") as f:
            json.dump({k: [r.asDict() for r in engine.times_by(spent, k).collect()] for k in ("rule_id", "file")}, f, indent=2)
    if a.dump_taints:
        marked = code.dfg_nodes(files).where("kind in ('Param', 'Return')").groupBy("name").agg(F.max(F.col("kind") == "Return").alias("tainted_return"))
        with open(a.dump_taints, "w", encoding="utf-8") as f:
            f.write(report.taint_dump(marked))
    if a.apply_fixes:
        post.apply_fixes(files, found).write.mode("overwrite").parquet(a.apply_fixes)
    return int(bool(a.fail_on) and post.fails_on(found, parse_severity(a.fail_on)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "verify":
        errors = verify(a.path)
        for file, error in errors:
            print(f"{file}: {error}")
        return int(bool(errors))
    if a.command == "inspect":
        for r in load_rules(a.path).rules:
            print(debug.rule_text(r))
        return 0
    own = spark or SparkSession.builder.master(f"local[{a.threads}]").config("spark.ui.enabled", "false").getOrCreate()
    return scan(a, own)


if __name__ == "__main__":
    sys.exit(main())
