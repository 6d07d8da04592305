"""Files and rules to findings: one logical plan with a branch for each kind of matcher."""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut, shuffled
from sieveflow.operators import cache as C
from sieveflow.operators import calls, graph, jsonpath, policy, post, taint, text, tree
from sieveflow.rules.model import AstPattern, AstQuery, JsonPathEq, JsonPathRegex, Policy, Rule, RuleSet, Taint, TextRegex, TextRegexMulti
from sieveflow.schemas import FINDINGS
from sieveflow.sources import code, corpus, readers


@dataclass
class Tables:
    """Tables derived from files, each built when a rule first needs it; ``known``: matches that are written."""

    files: DataFrame
    known: int = 0
    _nodes: DataFrame | None = None
    _tree: DataFrame | None = None

    @property
    def nodes(self) -> DataFrame:
        if self._nodes is None:
            self._nodes = readers.nodes(self.files)
        return self._nodes

    @property
    def typed_nodes(self) -> DataFrame:
        return self.nodes.join(shuffled(self.files.select("file_path", "file_type")), "file_path")

    @property
    def tree(self) -> DataFrame:
        if self._tree is None:
            # Each part of each pattern looks at it: the files are parsed for it once.
            self._tree = cut(code.typed_nodes(self.files), "tree")
        return self._tree


def hits(t: Tables, rules: RuleSet, aliases: bool = True, failed: list[DataFrame] | None = None, time_limit: float | None = None,
         gate: bool = True) -> DataFrame | None:
    """All matches (ord, file, line, column, excerpt, and with taint rules severity); None without rules.

    Taint rules with named sources and sinks hold only if the call graph of these files joins the names; with
    ``gate`` False that is left to the caller (:func:`gated`).

    Rules that fail or take more than ``time_limit`` seconds over a file are skipped for it. A list ``failed``
    gets tables (ord, file, error) of those; without one, a warning tells how many there are. What can fail is
    run at once for that.
    """
    parts: list[DataFrame] = []

    def sound(rows: DataFrame) -> DataFrame:
        rows = cut(rows, "matched")
        t.known += rows.count()
        tell(rows.where("error is not null").select("ord", "file", "error"), rules, failed)
        return rows.where("error is null").drop("error")

    if found := rules.of(TextRegex):
        plain = text.line_hits(t.files, found)
        parts.append(plain)
        if aliases and any(r.matcher.call for _, r in found):
            parts.append(text.alias_hits(t.files, found, plain, text.import_aliases(t.nodes)))
    if found := rules.of(TextRegexMulti):
        parts.append(sound(text.occurrence_rows(t.files, found, time_limit)))
    if found := rules.of(JsonPathEq) + rules.of(JsonPathRegex):
        parts.append(jsonpath.path_hits(t.typed_nodes, found))
    if found := rules.of(AstQuery):
        parts.append(tree.query_hits(t.tree, found))
    if found := rules.of(AstPattern):
        parts.append(tree.pattern_hits(t.tree, found))
    if found := rules.of(Policy):
        parts.append(sound(policy.policy_hits(t.files, t.nodes, found)))
    if found := rules.of(Taint):
        parts = [p.withColumn("severity", F.lit(None).cast("string")) for p in parts]
        flows = cut(graph.file_flows(t.files), "flows")  # joined several times
        symbols = flows.select("file_path", F.explode("clean").alias("name"), F.lit(True).alias("sanitized"))
        paths = flows.where("tainted").select("file_path")
        # Only PHP sinks are also joined by the names that a symbol leads to.
        php = any(r.applies("php") for _, r in found)
        direct = flows.select("file_path", F.inline("leads")) if php else None
        captures = sound(taint.taint_captures(t.files, found, time_limit))
        got = taint.taint_hits(captures, symbols, paths, direct)
        if any(r.interfile for _, r in found):
            got = got.unionByName(taint.interfile_hits(captures, calls.passes(calls.parts_of(t.files)), found))
        if gate and named(rules):
            got = gated(got, rules, graph.calls_in(t.files).select("src", "dst").distinct())
        parts.append(got)
    return reduce(DataFrame.unionByName, parts) if parts else None


def tell(bad: DataFrame, rules: RuleSet, failed: list[DataFrame] | None) -> None:
    """Adds a table (ord, file, error) to ``failed``; without a list, warns of its number and the first of it."""
    if failed is not None:
        failed.append(bad)
    elif n := bad.count():
        some = ", ".join(f"{rules.rules[r.ord].id} in {r.file} ({r.error})" for r in bad.limit(3).collect())
        warnings.warn(f"{n} times a rule was skipped for a file: {some}", RuntimeWarning, stacklevel=3)


def named(rules: RuleSet) -> list[tuple[int, Rule]]:
    """Taint rules that name their sources and sinks."""
    return [(i, r) for i, r in rules.of(Taint) if r.sources and r.sinks]


def gated(rows: DataFrame, rules: RuleSet, call_edges: DataFrame) -> DataFrame:
    """``rows`` (with ord) without those of rules whose named sources and sinks no chain of calls joins."""
    joined = taint.names_flow(named(rules), call_edges)
    return rows.where(~F.col("ord").isin([i for i, ok in joined.items() if not ok] or [-1]))


def file_calls(files: DataFrame) -> DataFrame:
    """file, src, dst: the calls of each file on its own, to be kept with its findings."""
    return graph.calls_in(files).withColumnRenamed("file_path", "file")


def raw_findings(files: DataFrame, rules: RuleSet, aliases: bool = True, failed: list[DataFrame] | None = None, time_limit: float | None = None, gate: bool = True) -> DataFrame:
    """Findings before any filter, with duplicates."""
    return _findings(files, hits(Tables(files), rules, aliases, failed, time_limit, gate), rules)


def _findings(files: DataFrame, got: DataFrame | None, rules: RuleSet) -> DataFrame:
    if got is None:
        return files.sparkSession.createDataFrame([], FINDINGS + ", ord int")
    return post.findings_of(got, rules)


def prune(files: DataFrame, rules: RuleSet) -> RuleSet:
    """Without rules for languages that no file has. At most a row for each file type comes to the driver."""
    types = {r[0] for r in files.select("file_type").distinct().collect()}
    return rules.for_types(types)


def analyze(files: DataFrame, rules: RuleSet, *, baseline: DataFrame | None = None, suppress: bool = True, cache: str | None = None,
            aliases: bool = True, plugin_findings: DataFrame | None = None, failed: list[DataFrame] | None = None, time_limit: float | None = None) -> DataFrame:
    """Deduplicated findings of the rules in the files, not in the baseline and not suppressed. ``failed`` and ``time_limit``: see :func:`hits`.

    With ``cache``, a folder, only files whose content it doesn't know under these rules are analysed. Where a rule
    failed or took too long over a file, that file isn't kept, so it is tried again.
    """
    first = None
    if cache is None:
        t = Tables(files)
        got = hits(t, rules, aliases, failed, time_limit)
        first = None if got is None else post.firsts(got, rules, t.known)
        raw = _findings(files, got if first is None else first, rules)
    else:
        raw = C.cached(files, rules, cache, lambda f, bad: raw_findings(f, rules, aliases, bad, time_limit, gate=False), file_calls if named(rules) else None)
        for bad in raw.failed:
            tell(bad, rules, failed)
        raw = gated(raw.findings, rules, raw.calls) if raw.calls is not None else raw.findings
        over = [i for i, r in rules.of(Taint) if r.interfile]
        if over:  # what a file gives depends on others, so nothing of it is kept
            place = F.element_at(F.array(*map(F.lit, over)), F.col("ord") + 1)
            now = raw_findings(files, RuleSet([rules.rules[i] for i in over]), aliases, failed, time_limit).withColumn("ord", place)
            raw = raw.where(~F.col("ord").isin(over)).unionByName(now)
    out = raw if baseline is None else post.without_baseline(raw, baseline)
    out = post.without_suppressed(out, files) if suppress else out
    out = out if first is not None else post.dedup(out)
    return out if plugin_findings is None else post.merge(out, plugin_findings, files, baseline)


def scan(spark: SparkSession, path: str, rules: RuleSet, *, patterns: tuple[str, ...] = (), default_excludes: bool = True, max_size: int = corpus.MAX_FILE_SIZE,
         suppress_comment: str = corpus.SUPPRESS_COMMENT, **options) -> DataFrame:
    """Findings in a folder: read, prune the rules, analyse."""
    files = corpus.load_corpus(spark, path, patterns, default_excludes, max_size=max_size, comment=suppress_comment)
    return analyze(files, prune(files, rules), **options)


def rule_errors(failed: list[DataFrame], rules: RuleSet) -> DataFrame | None:
    """rule_id, file, error of what :func:`hits` has told; None if nothing in the plan could fail."""
    if not failed:
        return None
    table = rules.frame(failed[0].sparkSession).select("ord", F.col("id").alias("rule_id"))
    return reduce(DataFrame.unionByName, failed).join(F.broadcast(table), "ord").select("rule_id", "file", "error")  # a row for each rule


def rule_times(files: DataFrame, rules: RuleSet, time_limit: float | None = None) -> DataFrame:
    """rule_id, file, matches, seconds: a row for each rule over text and each file that it applies to, measured in one pass over the sources.

    Rules over nodes and trees are joins of all files at once; they have no time of their own in a file.
    """
    measured = rules.of(TextRegex) + rules.of(TextRegexMulti) + rules.of(Taint)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, kind, source in zip(b.file_path, b.file_type, b.source, strict=True):
                layout = text.Layout(source or "")
                for _, r in measured:
                    if r.applies(kind):
                        began = time.perf_counter()
                        n = taint.matches_of(r, layout, kind, text.Clock(time_limit))
                        rows.append((r.id, file, n, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["rule_id", "file", "matches", "seconds"])

    return files.select("file_path", "file_type", "source").mapInPandas(run, "rule_id string, file string, matches long, seconds double")


def times_by(spent: DataFrame, key: str = "rule_id") -> DataFrame:
    """Sums of :func:`rule_times` for each rule, or for each ``file``."""
    return spent.groupBy(key).agg(F.sum("matches").alias("matches"), F.sum("seconds").alias("seconds")).orderBy(F.desc("seconds"), key)


def metrics(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, findings, matched_rules, files_with_findings."""
    n = files.agg(F.count("*").alias("files"))
    g = findings.agg(F.count("*").alias("findings"), F.countDistinct("rule_id").alias("matched_rules"), F.countDistinct("file").alias("files_with_findings"))
    return n.join(F.broadcast(g), F.lit(True))  # a row each
