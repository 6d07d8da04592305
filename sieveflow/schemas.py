"""Schemas of the engine's tables and the order of severities."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "file_path string, file_type string, source string, size long, suppressed array<int>, parse_status string"
LINES = "file_path string, file_type string, line int, text string"
NODES = "file_path string, id long, kind string, path string, value_json string, line int, `column` int"
AST_NODES = "file_path string, id int, parent int, kind string, value string, line int, `column` int, lo int, hi int"
DFG_NODES = "file_path string, id long, name string, kind string, sanitized boolean, branch int"
DFG_EDGES = "file_path string, src long, dst long, edge_type string"
SYMBOLS = "file_path string, name string, sanitized boolean, def long, alias_of string, symbol_kind string, scope string, module string"
FINDINGS = (
    "id string, rule_id string, rule_file string, severity string, file string, line int, `column` int, "
    "excerpt string, message string, remediation string, fix string"
)
BASELINE = "id string, file string, line int"

#: Severities from the least. ERROR ranks below LOW.
SEVERITIES = ("INFO", "ERROR", "LOW", "MEDIUM", "HIGH", "CRITICAL")
RANK = {s: i for i, s in enumerate(SEVERITIES)}
#: Kinds of dataflow nodes.
DFG_KINDS = ("Def", "Param", "Use", "Assign", "Return", "Branch")


def parse_severity(text: str) -> str:
    """Upper-case severity; ``warning`` is MEDIUM; anything unknown is an error."""
    s = text.strip().upper()
    s = "MEDIUM" if s == "WARNING" else s
    if s not in RANK:
        raise ValueError(f"unknown severity: {text}")
    return s


def severity_rank(severity: str | Column = "severity") -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in RANK.items()))[c]
