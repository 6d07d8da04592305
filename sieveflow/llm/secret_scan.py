"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger table holds
the findings of each scanned (blob, rule version) pair; only pairs that it lacks are scanned, once
each however many paths or versions share the blob, and appended. Findings are then joined back to
all paths. Only paths and digests are shuffled for that: what is to be scanned is found by a
broadcast of the few rows that are (where the ledger knows most blobs) or of the few that aren't
(where most are new); only where neither is few do texts meet them by a shuffle. Two writers may
append the same pair; their entries are equal, and one is read. The scan itself is made of SQL functions: ``split`` and ``regexp_extract_all`` on the same
pattern alternate gaps and matches, whose lengths (in code points) add up to the offsets.

Cases: a null text is the empty blob; repeated rows and copies share a blob; a null doc_id is a path
like any other; other columns are ignored; an empty table gives no rows and leaves the ledger as it
is. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveflow.functions.durable import exists

from .common import cut, fresh_path, text_or_empty

#: Bound of the rows (a path and a digest) that are broadcast to pick the texts to scan.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """kind; the pattern; its value, as a pattern anchored at the match's end; the least length of the value."""

    kind: str
    pattern: str
    value: str
    least: int
    base: bool = True


#: The base rules of the contract, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", "", 20),
    Rule("hex", r"[0-9a-f]{24,}", "", 24),
)
#: What the method adds: further kinds of key, after the base kinds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "", 40, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "", 15, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "", 29, False),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", "", 0, False),
)
RULES = BASE + MORE
VERSION = "1"


def pieces_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<kind_order, at, gap, size, kept>>: each match of the rule with the gap before it, in order.

    A first look with ``rlike`` spares texts without any match the rest.
    """
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = (lambda m: F.regexp_extract(m, rule.value, 1)) if rule.value else (lambda m: m)
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), (F.length(value(m)) >= rule.least).alias("kept")))
    numbered = F.transform(both, lambda x, i: F.struct(F.lit(order).alias("kind_order"), i.alias("at"), x["gap"].alias("gap"), x["size"].alias("size"), x["kept"].alias("kept")))
    return F.when(text.rlike(rule.pattern), numbered).otherwise(F.array().cast("array<struct<kind_order:int,at:int,gap:int,size:int,kept:boolean>>"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(texts: DataFrame, key: str = "blob", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, base (spans of base rules, sorted) and spans (all, sorted) of texts in which a rule matches; equal keys have equal texts.

    Only the lengths of gaps and matches leave the text. They are summed up along it by a window, so a text's work is
    that of sorting its matches, however many there are.
    """
    t = F.col(text_col)
    every = F.concat(*[pieces_of(t, r, i) for i, r in enumerate(rules)])
    rows = texts.select(F.col(key).alias("blob"), F.monotonically_increasing_id().alias("row"), every.alias("p"))
    rows = rows.select("blob", "row", F.inline("p"))
    along = W.partitionBy("row", "kind_order").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(along).cast("int")).where("kept")
    kinds = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind_order") + 1)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind_order", "end", kinds.alias("kind"))
    found = ends.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    is_base = [i for i, r in enumerate(rules) if r.base]
    return found.select(F.col("blob").alias(key), F.filter("spans", lambda x: x["kind_order"].isin(is_base)).alias("base"), "spans")


LEDGER = "blob string, rule_version string, base array<struct<start:int,kind_order:int,end:int,kind:string>>, spans array<struct<start:int,kind_order:int,end:int,kind:string>>"


def unscanned(versions: DataFrame, digests: DataFrame, unseen: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``versions`` (path, blob, text) to scan: those of ``unseen`` (path, blob), out of all ``digests``."""
    same = lambda other: versions.path.eqNullSafe(other["at"]) & (versions.blob == other["of"])
    new = unseen.select(F.col("path").alias("at"), F.col("blob").alias("of"))
    if new.limit(bound + 1).count() <= bound:
        return versions.join(F.broadcast(new), same(new), "left_semi")  # at most ``bound`` rows
    rest = digests.distinct().join(new, digests.path.eqNullSafe(new["at"]) & (digests.blob == new["of"]), "left_anti")
    rest = cut(rest.select(F.col("path").alias("at"), F.col("blob").alias("of")), "scanned")
    if rest.limit(bound + 1).count() <= bound:
        return versions.join(F.broadcast(rest), same(rest), "left_anti")  # at most ``bound`` rows
    # The path is in the key, so that the copies of one blob spread over all tasks.
    return versions.join(new.hint("shuffle_hash"), same(new), "left_semi")


def secret_scan(versions: DataFrame, ledger: str | None = None, path_col: str = "doc_id", text_col: str = "text",
                rules: tuple[Rule, ...] = RULES, rule_version: str = VERSION, bound: int = BROADCAST_ROWS) -> DataFrame:
    """path, blob, base, spans of each version; the ledger gains what it lacked."""
    spark = versions.sparkSession
    ledger = ledger or fresh_path(spark, "ledger")
    v = versions.select(F.col(path_col).alias("path"), text_or_empty(text_col).alias("text"))
    v = v.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    known = spark.read.schema(LEDGER).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], LEDGER)
    known = known.where(F.col("rule_version") == rule_version)

    # One row to stand for each blob that is new.
    digests = cut(v.select("path", "blob"), "digests")
    one = digests.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("first"))
    unseen = one.join(known.select("blob"), "blob", "left_anti").select("blob", F.col("first.path").alias("path"))
    unseen = cut(unseen, "unseen")
    entry = lambda df: df.groupBy("blob").agg(F.first("base").alias("base"), F.first("spans").alias("spans"))
    if not unseen.isEmpty():
        scanned = scan(unscanned(v, digests, unseen, bound), "blob", "text", rules)
        # Blobs in which nothing was found are entries too.
        noted = unseen.select("blob").join(scanned, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), _or_none("base"), _or_none("spans"))
        noted.write.mode("append").parquet(ledger)
    found = spark.read.schema(LEDGER).parquet(ledger) if exists(spark, ledger) else known
    found = entry(found.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)))
    return digests.join(found, "blob", "left").select("path", "blob", _or_none("base"), _or_none("spans"))


def _or_none(spans: str) -> Column:
    return F.coalesce(spans, F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")).alias(spans)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias(id_col), *[count(r.kind) for r in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
