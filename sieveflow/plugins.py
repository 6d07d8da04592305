"""Plugins: sources of files, transforms, analysers and reporters, in process or as a process that speaks JSON lines.

A plugin declares what it can do; the engine calls it in :func:`run`. A process plugin runs inside
``mapInPandas``, one process for each Python worker, and speaks JSON-RPC 2.0, a message a line.
"""

from __future__ import annotations

import base64
import json
import subprocess
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from queue import Empty, Queue
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.batches import in_pieces
from sieveflow.functions.scalar import finding_id, virtual_path
from sieveflow.sources import corpus

CAPABILITIES = ("discover", "transform", "analyze", "report", "rules")
METHODS = {"discover": "repo.discover", "transform": "file.transform", "analyze": "file.analyze", "report": "scan.report"}
HITS = "rule_id string, severity string, file string, line int, `column` int, excerpt string, message string"
WIRE = "path string, content_b64 string, language string"


class PluginError(RuntimeError):
    pass


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str = "0"
    api_version: str = "1.0"
    entry: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ()
    concurrency: str = "single"
    timeout_ms: int = 30_000
    mem_mb: int = 0
    reads_fs: bool = False
    needs_content: bool = True
    config_schema: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, doc: dict) -> Manifest:
        """A manifest's document; refuses other major versions and unknown capabilities."""
        known = {k: v for k, v in doc.items() if k in cls.__dataclass_fields__}
        if not known.get("name"):
            raise PluginError("a plugin has no name")
        if str(known.get("api_version", "1")).split(".")[0] != "1":
            raise PluginError(f"{known['name']}: version {known['api_version']} of the interface is not supported")
        if bad := [c for c in known.get("capabilities", ()) if c not in CAPABILITIES]:
            raise PluginError(f"{known['name']}: unknown capabilities {bad}")
        entry = known.get("entry", ())
        return cls(**{**known, "entry": tuple([entry] if isinstance(entry, str) else entry), "capabilities": tuple(known.get("capabilities", ()))})

    def check(self, config: dict) -> None:
        """Required keys and simple types of the configuration."""
        kinds = {"string": str, "integer": int, "boolean": bool, "number": (int, float), "array": list, "object": dict}
        for k in self.config_schema.get("required", ()):
            if k not in config:
                raise PluginError(f"{self.name}: {k} is required")
        for k, p in self.config_schema.get("properties", {}).items():
            if k in config and not isinstance(config[k], kinds.get(p.get("type"), object)):
                raise PluginError(f"{self.name}: {k} is not of type {p['type']}")


class Process:
    """A running plugin process."""

    def __init__(self, manifest: Manifest, config: dict | None = None):
        self.m, self.number = manifest, 0
        self.p = subprocess.Popen(list(manifest.entry), stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")  # noqa: S603
        self.lines: Queue = Queue()
        threading.Thread(target=self._read, daemon=True).start()
        self.call("plugin.init", {"config": config or {}, "api_version": manifest.api_version})
        self.call("plugin.ping", {})

    def _read(self) -> None:
        for line in self.p.stdout:
            self.lines.put(line)
        self.lines.put(None)

    def call(self, method: str, params: Any) -> Any:
        self.number += 1
        try:
            self.p.stdin.write(json.dumps({"jsonrpc": "2.0", "id": self.number, "method": method, "params": params}) + "\n")
            self.p.stdin.flush()
        except OSError as e:
            raise PluginError(f"{self.m.name}: {e}") from None
        while True:
            try:
                line = self.lines.get(timeout=self.m.timeout_ms / 1000)
            except Empty:
                self.p.kill()
                raise PluginError(f"{self.m.name}: {method} took more than {self.m.timeout_ms} ms") from None
            if line is None:
                raise PluginError(f"{self.m.name}: the process ended")
            try:
                got = json.loads(line)
            except ValueError:
                continue
            if not isinstance(got, dict) or got.get("method") == "plugin.log" or got.get("id") != self.number:
                continue
            if "error" in got:
                raise PluginError(f"{self.m.name}: {got['error']}")
            return got.get("result")

    def close(self) -> None:
        try:
            self.call("plugin.shutdown", {})
        except PluginError:
            pass
        self.p.kill()


@dataclass
class Plugin:
    """What a plugin does. In-process functions take and give dicts; a process has its manifest's entry."""

    manifest: Manifest
    config: dict = field(default_factory=dict)
    discover: Callable[[dict], list[dict]] | None = None
    transform: Callable[[dict], list[dict]] | None = None
    analyze: Callable[[dict], list[dict]] | None = None
    report: Callable[[dict], None] | None = None

    def can(self, what: str) -> bool:
        return getattr(self, what, None) is not None or bool(self.manifest.entry) and what in self.manifest.capabilities

    def opened(self) -> Callable[[str, dict], Any]:
        """A function of (what, params); processes start on the first call."""
        state: dict[str, Process] = {}

        def call(what: str, params: dict) -> Any:
            if (own := getattr(self, what)) is not None:
                return own(params)
            if "p" not in state:
                state["p"] = Process(self.manifest, self.config)
            return state["p"].call(METHODS[what], params)

        call.close = lambda: state["p"].close() if "p" in state else None
        return call


class Registry:
    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}
        self.off: set[str] = set()

    def register(self, plugin: Plugin) -> None:
        if plugin.manifest.name in self.plugins:
            raise PluginError(f"duplicate plugin: {plugin.manifest.name}")
        plugin.manifest.check(plugin.config)
        self.plugins[plugin.manifest.name] = plugin

    def disable(self, name: str) -> None:
        self.off.add(name)

    def enable(self, name: str) -> None:
        self.off.discard(name)

    def of(self, what: str) -> list[Plugin]:
        return [p for n, p in self.plugins.items() if n not in self.off and p.can(what)]


def _listed(result: Any, key: str) -> list[dict]:
    """Results may be a list, an object with the list, or one object."""
    if isinstance(result, dict):
        result = result.get(key, [result] if result else [])
    return [r for r in result or () if isinstance(r, dict)]


def wire(file: dict, with_content: bool = True) -> dict:
    out = {"path": file["file_path"], "language": file["file_type"], "size": file.get("size")}
    if with_content:
        out["content_b64"] = base64.b64encode((file["source"] or "").encode()).decode()
    return out


def _over_files(files: DataFrame, plugin: Plugin, what: str, rows_of: Callable[[dict, Any], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    shown = files if plugin.manifest.reads_fs else files.withColumn("_shown", virtual_path("file_path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = plugin.opened()
        try:
            for b in batches:
                rows: list[tuple] = []
                for file in b.to_dict("records"):
                    sent = wire(file, plugin.manifest.needs_content)
                    sent["path"] = file.get("_shown", file["file_path"])
                    try:
                        rows += rows_of(file, call(what, sent))
                    except PluginError:
                        raise
                    except Exception:  # noqa: BLE001  a plugin's failure on one file is that file's
                        continue
                yield pd.DataFrame(rows, columns=names)
        finally:
            call.close()

    return in_pieces(shown, run, schema, "source")


def discovered(files: DataFrame, plugin: Plugin, params: dict | None = None) -> DataFrame:
    """``files`` and those that the plugin finds (``path``, ``content_b64``, ``language``)."""
    call = plugin.opened()
    try:
        found = _listed(call("discover", params or {}), "files")
    finally:
        call.close()
    spark = files.sparkSession
    rows = [(f["path"], f.get("content_b64") or "", f.get("language")) for f in found]
    more = spark.createDataFrame(rows, WIRE)
    kind = F.coalesce("language", corpus.detect_type("path"))
    more = corpus.files_of(more.select(F.col("path").alias("file_path"), kind.alias("file_type"), F.decode(F.unbase64("content_b64"), "utf-8").alias("source")))
    return corpus.discovered(files, more)


def transformed(files: DataFrame, plugin: Plugin) -> DataFrame:
    """``files`` with what the plugin makes of each: the same path replaces, others are added."""

    def rows_of(file: dict, result: Any) -> list[tuple]:
        return [(file["file_path"] if "_shown" in file and f.get("path") == file["_shown"] else f["path"], f.get("content_b64") or "", f.get("language")) for f in _listed(result, "files") if "path" in f]

    return corpus.transformed(files, _over_files(files, plugin, "transform", rows_of, WIRE))


def analysed(files: DataFrame, plugin: Plugin, first_ord: int = 0) -> DataFrame:
    """Findings of a plugin, with the engine's columns and ids."""

    def rows_of(file: dict, result: Any) -> list[tuple]:
        return [
            (str(f.get("rule_id", plugin.manifest.name)), str(f.get("severity", "MEDIUM")).upper(), file["file_path"], int(f.get("line") or 0), int(f.get("column") or 0), str(f.get("excerpt", "")), str(f.get("message", "")))
            for f in _listed(result, "findings")
        ]

    got = _over_files(files, plugin, "analyze", rows_of, HITS)
    none = F.lit(None).cast("string")
    return got.select(
        finding_id("rule_id", "file", "line", "column").alias("id"), "rule_id", none.alias("rule_file"), "severity", "file", "line", "column", "excerpt", "message",
        none.alias("remediation"), none.alias("fix"), F.lit(first_ord).alias("ord"),
    )


def reported(findings: DataFrame, metrics: dict, plugins: list[Plugin]) -> None:
    """Hand the findings to reporters, as a report does: collected and in order."""
    from sieveflow.sinks.report import rows

    found = rows(findings)
    for p in plugins:
        call = p.opened()
        try:
            call("report", {"findings": found, "metrics": metrics})
        finally:
            call.close()


def count_by_plugin(findings: dict[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in findings.items()}
