"""Matchers of nodes by path and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.scalar import end_of_text, path_matches
from sieveflow.rules.model import JsonPathEq, Rule

from .text import applies

#: Kinds of nodes that have values to compare.
KINDS = ("k8s", "terraform", "yaml", "json")


def json_string(value_json: str = "value_json"):
    """The text of a JSON string; null for other values."""
    c = F.col(value_json)
    return F.when(c.startswith('"'), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0])


def path_hits(nodes: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Nodes (with file_type) whose path matches a rule's glob and whose value is equal, or is a string that matches.

    Equality is of canonical JSON: ``1``, ``"1"`` and ``true`` differ.
    """
    tests = []
    for i, r in rules:
        m = r.matcher
        value = F.col("value_json") == m.value_json if isinstance(m, JsonPathEq) else F.coalesce(F.col("_s").rlike(end_of_text(m.regex)), F.lit(False))
        tests.append(F.when(applies(r) & path_matches("path", m.path) & value, F.lit(i)))
    seen = nodes.where(F.col("kind").isin(*KINDS)).withColumn("_s", json_string())
    hit = F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))
    return seen.select(hit.alias("ord"), F.col("file_path").alias("file"), "line", "column", F.col("value_json").alias("excerpt"))
