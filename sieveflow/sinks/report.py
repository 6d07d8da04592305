"""Reports of findings: text, JSON and SARIF.

A report as one text comes to the driver in order, as it is for reading; :func:`write_report` writes one of any size by tasks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut
from sieveflow.functions.scalar import sarif_level

FIELDS = ("id", "rule_id", "rule_file", "severity", "file", "line", "column", "excerpt", "message", "remediation", "fix")
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
TOOL = "sieveflow"
#: Terminal colours of severities.
COLOURS = {"CRITICAL": 35, "HIGH": 31, "ERROR": 31, "MEDIUM": 33, "LOW": 34, "INFO": 36}


def ordered(findings: DataFrame) -> DataFrame:
    keys = [c for c in ("file", "ord", "line", "column", "id") if c in findings.columns]
    return findings.orderBy(*keys)


def rows(findings: DataFrame) -> list[dict]:
    return [{k: r[k] for k in FIELDS} for r in ordered(findings).collect()]


def json_report(findings: DataFrame) -> str:
    """``{"findings": [...], "total": n}``; a finding without a fix has no such key."""
    found = [{k: v for k, v in r.items() if k != "fix" or v is not None} for r in rows(findings)]
    return json.dumps({"findings": found, "total": len(found)}, indent=2, ensure_ascii=False)


def write_report(findings: DataFrame, folder: str, fmt: str = "json") -> None:
    """A JSON or SARIF report of any size, written by all tasks: the files of ``folder`` one after the other, in the order of their paths, are the report.

    Findings are sorted over range partitions and each is a line of its own; all but the last of the order end in a comma.
    """
    spark = findings.sparkSession
    if fmt == "json":
        head, tail, each = ['{"findings": ['], ['], "total": %d}'], _json_line()
    elif fmt == "sarif":
        tool = json.dumps({"driver": {"name": TOOL}})
        head, tail, each = [f'{{"version": "2.1.0", "$schema": "{SARIF_SCHEMA}", "runs": [{{"tool": {tool}, "results": ['], ["]}]}"], _sarif_line()
    else:
        raise ValueError(f"unknown format: {fmt}")
    keys = [c for c in ("file", "ord", "line", "column", "id") if c in findings.columns]
    place = F.struct(*keys)
    found = cut(findings.select(*keys, place.alias("place"), each.alias("text")), "report")
    n, last = found.agg(F.count("*"), F.max("place")).first()
    write = lambda rows, name: spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    write(head, "0-head")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    comma = F.lit("") if last is None else F.when(place == F.struct(*[F.lit(last[c]).cast(found.schema[c].dataType).alias(c) for c in keys]), "").otherwise(",")
    rows_ = found.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows_.select(F.concat("text", comma).alias("value")).write.mode("overwrite").text(f"{folder}/1-findings")
    write([t % n if "%d" in t else t for t in tail], "2-tail")


def _json_line() -> Column:
    """A finding as JSON; without a fix it has no such key."""
    keep = {"ignoreNullFields": "false"}
    without = [c for c in FIELDS if c != "fix"]
    return F.when(F.col("fix").isNull(), F.to_json(F.struct(*without), keep)).otherwise(F.to_json(F.struct(*FIELDS), keep))


def _sarif_line() -> Column:
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), sarif_level().alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations")))


def sarif_rows(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id", sarif_level().alias("level"), "message", "file", "line", "column")


def sarif_report(findings: DataFrame) -> str:
    results = [
        {
            "ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["line"], "startColumn": r["column"]}}}],
        }
        for r in ordered(sarif_rows(findings)).collect()
    ]
    run = {"tool": {"driver": {"name": TOOL}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": SARIF_SCHEMA, "runs": [run]}, indent=2, ensure_ascii=False)


def text_report(findings: DataFrame, info: dict | None = None, colour: bool = False) -> str:
    """A box of figures, a block for each finding, and the total."""
    found = rows(findings)
    out = []
    if info:
        lines = [f"{k}: {v}" for k, v in info.items()]
        width = max(map(len, lines)) + 2
        out += ["+" + "-" * width + "+", *(f"| {x.ljust(width - 2)} |" for x in lines), "+" + "-" * width + "+", ""]
    for r in found:
        tag = f"\x1b[{COLOURS[r['severity']]}m{r['severity']}\x1b[0m" if colour else r["severity"]
        out += [f"{tag} {r['rule_id']}", f"  {r['file']}:{r['line']}:{r['column']}", f"  {r['message']}"]
        out += [f"  > {line}" for line in (r["excerpt"] or "").splitlines()]
        out += [f"  {k}: {r[k]}" for k in ("remediation", "fix") if r[k]]
        out.append("")
    return "\n".join([*out, f"Total: {len(found)}"])


def report(findings: DataFrame, fmt: str = "text", info: dict | None = None) -> str:
    if fmt not in ("text", "json", "sarif"):
        raise ValueError(f"unknown format: {fmt}")
    return {"json": json_report, "sarif": sarif_report}[fmt](findings) if fmt != "text" else text_report(findings, info)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A row of figures as a JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(metrics.first().asDict(), f, indent=2)


def taint_dump(taints: DataFrame) -> str:
    return json.dumps([r.asDict() for r in taints.orderBy("name").collect()], indent=2)


def write_errors(errors: DataFrame, path: str) -> None:
    """(file_path, parse_status) of files that failed, appended."""
    errors.where(F.col("parse_status") != "ok").select("file_path", "parse_status").write.mode("append").json(path)
