"""From hits to findings: identity, baseline, suppression, dedup, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut, shuffled
from sieveflow.functions.scalar import finding_id
from sieveflow.rules.model import RuleSet
from sieveflow.schemas import BASELINE, RANK, parse_severity, severity_rank

#: Suppressed lines up to which they are broadcast; beyond, findings and lines are joined by a shuffle.
MARKS = 100_000
#: Known hits that a task tells apart.
TASK_HITS = 2_000_000


def findings_of(hits: DataFrame, rules: RuleSet) -> DataFrame:
    """Hits (ord, file, line, column, excerpt[, severity]) with the rule's columns and an id; ord stays for order."""
    columns = {"rule_id": "id", "rule_file": "source_file", "own": "severity", "message": "message", "remediation": "remediation", "fix": "fix"}
    if len(rules.rules) == 1:  # nothing to look up
        j = hits.withColumns({c: F.lit(getattr(rules.rules[0], of)).cast("string") for c, of in columns.items()})
    else:
        table = rules.frame(hits.sparkSession).select("ord", *[F.col(of).alias(c) for c, of in columns.items()])
        j = hits.join(F.broadcast(table), "ord")  # a row for each rule
    severity = F.coalesce(F.col("severity"), F.col("own")) if "severity" in hits.columns else F.col("own")
    return j.select(
        finding_id("rule_id", "file", "line", "column").alias("id"), "rule_id", "rule_file", severity.alias("severity"), "file",
        F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"), "excerpt", "message", "remediation", "fix", "ord",
    )


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline (id, file, line) lacks."""
    return findings.join(shuffled(baseline.select("id", "file", "line").distinct()), ["id", "file", "line"], "left_anti")


def without_suppressed(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings not on a line that holds the suppressing comment. The lines that do are counted first: mostly there are none, and nothing is joined."""
    # Not ``explode``: the optimizer would filter by the marks, and so read all texts, before the files are dealt over the cores.
    marks = cut(files.select(F.col("file_path").alias("file"), F.explode_outer("suppressed").alias("line")).where("line is not null"), "marks")
    n = marks.count()
    return findings.join(F.broadcast(marks) if n <= MARKS else shuffled(marks), ["file", "line"], "left_anti") if n else findings


def firsts(hits: DataFrame, rules: RuleSet, known: int = 0) -> DataFrame | None:
    """Hits with one row for each finding's id: the row that :func:`dedup` keeps. None if ids can't be told by rule, file and line.

    An id is made of a rule's id, file, line and column, so these tell findings apart without it. Hits are dealt by file, once and
    without ids or what the rules table has: those of a file come one after another and take a few bytes each. They are hashed (or,
    with excerpts, sorted) only where they have come together, not before. With more than ``TASK_HITS`` of ``known`` hits for each core, the number of tasks goes by
    these: Spark would put as many into one as make its bytes, which are very few a hit.
    """
    ids = [r.id for r in rules.rules]
    every = set(ids)
    if any(i[:n] in every for i in every for n, c in enumerate(i) if c == ":"):
        return None  # "a" in file "b:c" and "a:b" in file "c" share an id
    at: dict[str, int] = {}
    same = [at.setdefault(i, k) for k, i in enumerate(ids)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("ord") + 1)
    order, places = ["ord"], ["file", "line", "column"]
    if "severity" in hits.columns:
        hits = hits.withColumn("severity", F.coalesce("severity", of([r.severity for r in rules.rules])))
        order.append("severity")
    hits = hits.withColumn("rule", of(same) if len(at) < len(ids) else F.col("ord"))
    many = known > TASK_HITS * hits.sparkSession.sparkContext.defaultParallelism
    told = (hits.repartition(-(-known // TASK_HITS), "file") if many else hits.repartition("file")).groupBy("rule", *places)
    told = told.agg(F.min(F.struct(*order)).alias("first"), F.min(F.struct(*order, "excerpt")).alias("whole"))
    return told.select(*places, F.col("whole.excerpt").alias("excerpt"), *[F.col(f"first.{c}").alias(c) for c in order])


def dedup(findings: DataFrame, order: tuple[str, ...] = ("ord", "file", "line", "column")) -> DataFrame:
    """One finding for each id: the first in rule and place order. The least row is found by a partial aggregate, not a sort.

    Rows are compared column by column, so the columns before the excerpt are those of the least row cut there: a plan that
    asks for no excerpt neither shuffles nor sorts excerpts, which are a line for each match in it.
    """
    rest = [c for c in findings.columns if c != "id" and c not in order]
    short = rest[: rest.index("excerpt")] if "excerpt" in rest else rest
    aggs = [F.min(F.struct(*order, *short)).alias("first")]
    if len(short) < len(rest):
        aggs.append(F.min(F.struct(*order, *rest)).alias("whole"))
    of = lambda c: "first" if c in order or c in short else "whole"
    return findings.groupBy("id").agg(*aggs).select("id", *[F.col(f"{of(c)}.{c}").alias(c) for c in findings.columns if c != "id"])


def merge(base: DataFrame, more: DataFrame, files: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Findings and those of plugins, which are filtered like them; the engine's come first among equals."""
    more = without_suppressed(more if baseline is None else without_baseline(more, baseline), files)
    return dedup(base.unionByName(more.withColumn("ord", F.col("ord") + (1 << 20))))


def top_severity(findings: DataFrame, strict_empty: bool = True) -> DataFrame:
    """One row: the highest rank. Without findings it is LOW's, or null with ``strict_empty`` False."""
    top = F.max(severity_rank("severity"))
    return findings.agg((F.coalesce(top, F.lit(RANK["LOW"])) if strict_empty else top).alias("severity_rank"))


def fails_on(findings: DataFrame, threshold: str, strict_empty: bool = True) -> bool:
    rank = top_severity(findings, strict_empty).first()[0]
    return rank is not None and rank >= RANK[parse_severity(threshold)]


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(id, file, line) of a file or folder of JSON: a finding in each line, or arrays of findings."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    as_array = first is not None and first[0].lstrip().startswith("[")
    return spark.read.schema(BASELINE).option("multiLine", as_array).json(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    findings.select("id", "file", "line").distinct().write.mode("overwrite").json(path)


def by_rule_and_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


def rollup(findings: DataFrame) -> DataFrame:
    return findings.rollup("severity", "rule_id").agg(F.count("*").alias("findings"))


def success_rate(files: str | Column, failed: str | Column) -> Column:
    n, bad = (F.col(c) if isinstance(c, str) else c for c in (files, failed))
    return F.when(n > 0, (n - bad) / n * 100).otherwise(0.0)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_fixes(files: DataFrame, findings: DataFrame) -> DataFrame:
    """A copy of the sources (file_path, fixed, applied, skipped) with each finding's fix in place of its excerpt.

    Fixes of a file are applied from the last place to the first, so that places stay valid; one whose
    excerpt isn't where it should be, or which overlaps an applied one, is left out and counted as skipped. ``...`` in a fix is
    what the excerpt holds between its first and last parenthesis.
    """
    todo = findings.where(F.col("fix").isNotNull()).groupBy("file").agg(F.collect_list(F.struct("line", "column", "excerpt", "fix")).alias("fixes"))

    @F.pandas_udf("fixed string, applied int, skipped int")
    def fixed(source, fixes):
        import pandas as pd

        return pd.DataFrame([fix_source(s, f) for s, f in zip(source, fixes, strict=True)], columns=["fixed", "applied", "skipped"])

    j = files.select("file_path", "source").join(shuffled(todo), files.file_path == todo.file)
    return j.select("file_path", fixed("source", "fixes").alias("x")).select("file_path", "x.fixed", "x.applied", "x.skipped")


def fix_source(source: str, fixes: list[dict]) -> tuple[str, int, int]:
    """The fixed text, and the numbers of applied and of skipped fixes. Columns count bytes."""
    starts, lines = [0], source.split("\n")
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    end, applied = len(source) + 1, 0
    for f in sorted(fixes, key=lambda f: (f["line"], f["column"]), reverse=True):
        at = -1
        if 0 < f["line"] < len(starts):
            before = lines[f["line"] - 1].encode("utf-8", "surrogatepass")[: f["column"] - 1]
            at = starts[f["line"] - 1] + len(before.decode("utf-8", "surrogatepass" if before.isascii() else "ignore"))
        old = f["excerpt"]
        if at < 0 or not old or at + len(old) > end or source[at : at + len(old)] != old:
            continue
        new = f["fix"]
        if "..." in new and "(" in old and ")" in old:
            new = new.replace("...", old[old.index("(") + 1 : old.rindex(")")])
        source = source[:at] + new + source[at + len(old) :]
        end, applied = at, applied + 1
    return source, applied, len(fixes) - applied
