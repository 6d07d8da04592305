"""Looking inside: trees and graphs as text, rules as text, likely taint by names, timelines of events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveflow.functions.durable import shuffled
from sieveflow.operators import graph, tree
from sieveflow.rules.model import Rule
from sieveflow.sources import code, corpus

STAGES = ("parsing", "rule-compilation", "rule-evaluation", "matching")
#: Names that look like sources and sinks.
LIKELY_SOURCES = ("input", "get", "request", "read", "recv", "argv", "getenv", "param")
LIKELY_SINKS = ("eval", "exec", "system", "popen", "print", "write", "query", "execute", "send")


def ir(files: DataFrame, what: str = "ast", fmt: str = "tree") -> DataFrame:
    """file_path, text of ast, cfg, ssa (the dataflow) or callgraph as tree, json, dot or mermaid."""
    t = code.ast_nodes(files)
    if what == "callgraph":
        e = graph.call_edges(t, corpus.lines(files))
        names = e.select(F.col("src").alias("name")).unionByName(e.select(F.col("dst").alias("name"))).distinct()
        nodes = names.select(F.lit("").alias("file_path"), F.abs(F.xxhash64("name")).alias("id"), F.col("name").alias("label"))
        edges = e.select(F.lit("").alias("file_path"), F.abs(F.xxhash64("src")).alias("src"), F.abs(F.xxhash64("dst")).alias("dst"))
    elif what == "cfg":
        n, edges = tree.control_flow(t)
        nodes = n.select("file_path", "id", F.coalesce("code", F.lit("")).alias("label"), "line")
    elif what == "ssa":
        nodes = code.dfg_nodes(files).select("file_path", "id", F.concat_ws(" ", "kind", "name").alias("label"))
        edges = code.dfg_edges(files).where("edge_type = 'flow'").select("file_path", "src", "dst")
    elif what == "ast":
        if fmt == "tree":
            return graph.to_tree(t)
        nodes = t.select("file_path", "id", F.concat_ws(" ", "kind", "value").alias("label"))
        edges = t.where("parent is not null").select("file_path", F.col("parent").alias("src"), F.col("id").alias("dst"))
    else:
        raise ValueError(f"unknown graph: {what}")
    if fmt not in ("json", "dot", "mermaid"):
        raise ValueError(f"unknown format: {fmt}")
    return {"json": graph.to_json, "dot": graph.to_dot, "mermaid": graph.to_mermaid}[fmt](nodes, edges)


def rule_text(rule: Rule) -> str:
    lines = [f"rule {rule.id} [{rule.severity}] {rule.category}", f"  languages: {', '.join(rule.languages)}", f"  message: {rule.message}"]
    lines.append(f"  matcher: {type(rule.matcher).__name__}")
    lines += [f"    {k}: {v}" for k, v in vars(rule.matcher).items()]
    return "\n".join(lines)


def likely_taint(files: DataFrame) -> DataFrame:
    """file_path, source, sink, severity: pairs of calls whose names look like one and the other in a file."""
    calls = code.ast_nodes(files).where(F.col("kind").isin("Call", "CallExpression") & F.col("value").isNotNull())
    last = F.lower(F.element_at(F.split("value", r"\.|::|->"), -1))
    named = calls.select("file_path", last.alias("name")).distinct()
    a = named.where(F.col("name").isin(*LIKELY_SOURCES)).withColumnRenamed("name", "source")
    b = named.where(F.col("name").isin(*LIKELY_SINKS)).withColumnRenamed("name", "sink")
    severity = F.when(F.col("sink").isin("eval", "exec", "system", "popen", "execute"), "HIGH").otherwise("MEDIUM")
    return a.join(shuffled(b), "file_path").select("file_path", "source", "sink", severity.alias("severity"))


class Timeline:
    """Events in order, each with its stage, description and time since the first."""

    def __init__(self, sink: Callable[[tuple], None] | None = None):
        self.rows: list[tuple[int, str, str, float]] = []
        self.began = time.monotonic()
        self.sink = sink

    def add(self, stage: str, description: str) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage: {stage}")
        self.rows.append((len(self.rows), stage, description, time.monotonic() - self.began))
        if self.sink:
            self.sink(self.rows[-1])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "idx int, stage string, description string, elapsed double")


def stage_summary(events: DataFrame) -> DataFrame:
    """stage, n in the order of the pipeline."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)])
    return events.groupBy("stage").agg(F.count("*").alias("n"), F.sum("elapsed").alias("elapsed")).orderBy(order[F.col("stage")])
