"""Policies: registered functions over a file's tables, and what their results mean.

There is no runtime for compiled policies here, so a policy is a Python function of the file's JSON
input (its path, type, nodes and source), or a function of the nodes table to a DataFrame of hits.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.durable import shuffled
from sieveflow.rules.model import Rule

from .text import ERROR, HITS, applies

#: name -> function of a file's input (dict) to a result.
FUNCTIONS: dict[str, Callable[[dict], object]] = {}
#: name -> function of the nodes table to (file_path, line, column, message).
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, function: Callable[[dict], object]) -> None:
    FUNCTIONS[name] = function


def register_table(name: str, function: Callable[[DataFrame], DataFrame]) -> None:
    TABLES[name] = function


def denials(result: object) -> list[tuple[str, int, int]]:
    """(message, line, column) of what a policy returned.

    A result is a string, an object with ``msg`` or ``message`` and perhaps line and column, an object
    of names that are true, a list of results, or a list of ``{"result": ...}``. Places default to 0.
    """
    if isinstance(result, str):
        return [(result, 0, 0)]
    if isinstance(result, list):
        return [d for r in result for d in denials(r)]
    if isinstance(result, dict):
        if "result" in result:
            return denials(result["result"])
        text = result.get("msg", result.get("message"))
        if isinstance(text, str):
            return [(text, int(result.get("line") or 0), int(result.get("column") or 0))]
        return [(str(k), 0, 0) for k, v in result.items() if v is True]
    return []


def policy_hits(files: DataFrame, nodes: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """A hit for each denial; the excerpt is its message. A policy that fails over a file has a row with an error there."""
    out = None
    for i, r in ((i, r) for i, r in rules if r.matcher.name in TABLES):
        own = nodes.join(shuffled(files.where(applies(r)).select("file_path")), "file_path", "left_semi")
        hits = TABLES[r.matcher.name](own).select(
            F.lit(i).alias("ord"), F.col("file_path").alias("file"), F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"), F.col("message").alias("excerpt"), F.lit(None).cast("string").alias("error")
        )
        out = hits if out is None else out.unionByName(hits)
    plain = [(i, r, FUNCTIONS[r.matcher.name]) for i, r in rules if r.matcher.name in FUNCTIONS]
    if missing := [r.matcher.name for _, r in rules if r.matcher.name not in FUNCTIONS and r.matcher.name not in TABLES]:
        raise KeyError(f"policies that aren't registered: {missing}")
    if plain:
        by_file = nodes.groupBy("file_path").agg(F.collect_list(F.struct("kind", "path", "value_json", "line", "column")).alias("nodes"))
        inputs = files.select("file_path", "file_type", "source").join(shuffled(by_file), "file_path", "left")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for file, kind, source, found in zip(b.file_path, b.file_type, b.source, b.nodes, strict=True):
                    own = [{**n, "value": json.loads(n["value_json"])} for n in (found if found is not None else ())]
                    given = {"file_path": file, "file_type": kind, "source": source, "nodes": own}
                    for i, r, f in plain:
                        if r.applies(kind):
                            try:
                                rows += [(i, file, line, column, text, None) for text, line, column in denials(f(given))]
                            except Exception as e:  # noqa: BLE001  a policy's failure is its own, and is told
                                rows.append((i, file, 0, 0, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["ord", "file", "line", "column", "excerpt", "error"])

        hits = inputs.mapInPandas(run, HITS + ERROR)
        out = hits if out is None else out.unionByName(hits)
    return out
