"""Caches of findings by content: only files that changed, or all once the rules did, are analysed again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut, exists, shuffled
from sieveflow.rules.model import RuleSet
from sieveflow.schemas import FINDINGS

ENTRIES = "file string, file_hash string, rules_hash string"
CALLS = "file string, src string, dst string, file_hash string, rules_hash string"
STORED = FINDINGS + ", ord int, file_hash string, rules_hash string"


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2(F.coalesce("source", F.lit("")).cast("binary"), 256))


def split(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, new) files with file_hash, by path and content."""
    k = known.select(F.col("file").alias("file_path"), "file_hash").distinct()
    on = ["file_path", "file_hash"]
    return files.join(shuffled(k), on, "left_semi"), files.join(shuffled(k), on, "left_anti")


@dataclass
class Cached:
    """Findings of all files; tables (ord, file, error) of what failed in this run; calls (src, dst) of all files, if they were asked for."""

    findings: DataFrame
    failed: list[DataFrame]
    calls: DataFrame | None = None


def cached(files: DataFrame, rules: RuleSet, path: str, analyse: Callable[[DataFrame, list], DataFrame], calls_of: Callable[[DataFrame], DataFrame] | None = None) -> Cached:
    """Stored findings, and those of new files, which are stored.

    The table of entries tells a file without findings from one never seen. All tables are appended to
    and read under the rules' fingerprint, so a change of rules leaves old rows unread. ``analyse`` gets new files and
    a list for what fails; files where something did get no entry and no stored rows, only their findings of this run.
    ``calls_of`` gives (file, src, dst), kept likewise, so that a call graph is of all files and not of the new ones.
    """
    spark = files.sparkSession
    rules_hash = rules.fingerprint()
    read = lambda name, schema: (
        spark.read.schema(schema).parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)
    ).where(F.col("rules_hash") == rules_hash)
    hashed = with_hash(files)
    now = hashed.select(F.col("file_path").alias("file"), "file_hash")
    _, new = split(hashed, read("entries", ENTRIES))
    new = cut(new, "new-files")  # what is stored below must be what was analysed
    failed: list[DataFrame] = []
    found = cut(analyse(new.drop("file_hash"), failed), "found")
    marks = new.select(F.col("file_path").alias("file"), "file_hash", F.lit(rules_hash).alias("rules_hash"))
    bad = None
    for f in failed:
        bad = f.select("file") if bad is None else bad.unionByName(f.select("file"))
    good = marks if bad is None else cut(marks.join(bad, "file", "left_anti"), "good")

    def store(rows: DataFrame, name: str, schema: str) -> None:
        names = [f.strip().split()[0].strip("`") for f in schema.split(",")]
        rows.select(*names).write.mode("append").parquet(f"{path}/{name}")

    store(found.join(shuffled(good), "file"), "findings", STORED)
    calls = cut(calls_of(new.drop("file_hash")), "calls") if calls_of else None
    if calls is not None:
        store(calls.join(shuffled(good), "file"), "calls", CALLS)
    store(good, "entries", ENTRIES)  # last: a run that breaks off stores nothing that counts
    kept = lambda name, schema: read(name, schema).join(shuffled(now), ["file", "file_hash"], "left_semi").distinct().drop("file_hash", "rules_hash")
    out = kept("findings", STORED).join(read("entries", ENTRIES).select("file").distinct(), "file", "left_semi")
    graph = kept("calls", CALLS) if calls is not None else None
    if bad is not None:
        out = out.unionByName(found.join(bad.distinct(), "file", "left_semi").select(out.columns))
        graph = graph.unionByName(calls.join(bad.distinct(), "file", "left_semi").select(graph.columns)) if graph is not None else None
    return Cached(out, failed, graph.select("src", "dst").distinct() if graph is not None else None)


def forget_missing(spark, path: str, files: DataFrame, rules: RuleSet) -> DataFrame:
    """Entries of files that are still there: what a rewritten cache would hold."""
    known = spark.read.schema(ENTRIES).parquet(f"{path}/entries").where(F.col("rules_hash") == rules.fingerprint())
    return known.join(shuffled(files.select(F.col("file_path").alias("file"))), "file", "left_semi")


def rules_fingerprint(rules: DataFrame) -> DataFrame:
    """One row: the hash of all (id, hash) of a rules table in the order of ids."""
    each = F.struct("id", F.sha2("spec_json", 256).alias("h"))
    parts = F.transform(F.array_sort(F.collect_list(each)), lambda x: F.concat(x["id"], F.lit(":"), x["h"], F.lit(";")))
    return rules.agg(F.sha2(F.array_join(parts, ""), 256).alias("fingerprint"))
