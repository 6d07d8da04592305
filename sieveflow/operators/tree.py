"""Tree matchers over nested-set intervals: a descendant is a range predicate, never recursion, and is found by one sort of a file's nodes.

``ast_nodes`` has lo and hi for each node: hi is the greatest lo below it, so n is below a exactly if
a.lo < n.lo <= a.hi in the same file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut, shuffled
from sieveflow.functions.scalar import end_of_text
from sieveflow.rules.model import Rule

from . import text
from .text import applies


def _json_text(value: str = "value"):
    j = F.to_json(F.array(value))
    return F.when(F.col(value).isNull(), "null").otherwise(j.substr(F.lit(2), F.length(j) - 2))


def with_type(ast_nodes: DataFrame, files: DataFrame) -> DataFrame:
    return ast_nodes.join(shuffled(files.select("file_path", "file_type")), "file_path")


def query_hits(ast_nodes: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Nodes (with file_type) whose kind and value match the regexes of a rule; all nodes of a file, however many."""
    tests = []
    for i, r in rules:
        m = r.matcher
        hit = applies(r) & F.col("kind").rlike(end_of_text(m.kind))
        if m.value is not None:
            hit &= F.coalesce(F.col("value").rlike(end_of_text(m.value)), F.lit(False))
        tests.append(F.when(hit, F.lit(i)))
    hit = F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))
    return ast_nodes.select(hit.alias("ord"), F.col("file_path").alias("file"), "line", "column", _json_text().alias("excerpt"))


def within(nodes: DataFrame, ancestors: DataFrame, keep: str = "left_semi") -> DataFrame:
    """Nodes that have one of ``ancestors`` strictly above them (or with left_anti, none)."""
    return text.covered(nodes, ancestors, "file_path", ("lo", "hi"), strict=True, keep=keep == "left_semi")


def within_few(nodes: DataFrame, ancestors: DataFrame, keep: str = "left_semi") -> DataFrame:
    """The same for a bounded number of ancestors, which are broadcast: nodes stay where they are, whatever the size of a tree."""
    a = F.broadcast(ancestors.select(F.col("file_path").alias("af"), F.col("lo").alias("alo"), F.col("hi").alias("ahi")))
    return nodes.join(a, (F.col("file_path") == F.col("af")) & (F.col("alo") < F.col("lo")) & (F.col("ahi") >= F.col("hi")), keep)


def holding(nodes: DataFrame, below: DataFrame, keep: str = "left_semi") -> DataFrame:
    """Nodes that are, or have below them, one of ``below`` (or with left_anti, none)."""
    return text.holding(nodes, below, "file_path", ("lo", "hi"), keep=keep == "left_semi")


def pattern_hits(ast_nodes: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Nodes of a kind, within an ancestor of a kind, that hold each metavariable's kind and value; each on its own."""
    out = None
    for i, r in rules:
        m = r.matcher
        found = ast_nodes.where(applies(r) & (F.col("kind") == m.kind))
        if m.within:
            found = within(found, ast_nodes.where(F.col("kind") == m.within))
        for v in m.metavariables:
            some = ast_nodes.where((F.col("kind") == v.kind) & (F.lit(True) if v.value is None else F.coalesce(F.col("value") == v.value, F.lit(False))))
            found = holding(found, some)
        hits = found.select(F.lit(i).alias("ord"), F.col("file_path").alias("file"), "line", "column", _json_text().alias("excerpt"))
        out = hits if out is None else out.unionByName(hits)
    return out


def unsanitised_routes(ast_nodes: DataFrame) -> DataFrame:
    """file_path of files (nodes with file_type) that hand a request to a response.

    JavaScript and TypeScript: a call of ``res.send`` that holds the identifier ``req`` and no call of
    ``sanitize``. Python: a return statement that holds the identifier ``request``.
    """
    call = F.col("kind").isin("Call", "CallExpression")
    js = ast_nodes.where(F.col("file_type").isin("javascript", "typescript"))
    send = js.where(call & F.col("value").startswith("res.send"))
    send = holding(send, js.where((F.col("kind") == "Identifier") & (F.col("value") == "req")))
    send = holding(send, js.where(call & (F.col("value") == "sanitize")), "left_anti")
    py = ast_nodes.where("file_type = 'python'")
    back = holding(py.where("kind = 'ReturnStatement'"), py.where("kind = 'Identifier' and value = 'request'"))
    return send.select("file_path").unionByName(back.select("file_path")).distinct()


def control_flow(ast_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the call sequence of each file: calls in pre-order, each joined to the next."""
    calls = ast_nodes.where(F.col("kind").isin("Call", "CallExpression")).select("file_path", F.col("lo").alias("id"), "line", F.col("value").alias("code"))
    calls = cut(calls, "calls")  # nodes and edges are joined to each other, and files are parsed once
    after = F.lead("id").over(W.partitionBy("file_path").orderBy("id"))
    edges = calls.select("file_path", F.col("id").alias("src"), after.alias("dst")).where("dst is not null")
    return calls, edges
