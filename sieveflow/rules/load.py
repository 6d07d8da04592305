"""Rule documents (YAML in two dialects, JSON) to rules. Runs on the driver, as rules are few; tables of documents are verified where they are."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut, shuffled
from sieveflow.schemas import parse_severity
from sieveflow.sources.readers import canonical

from . import pattern as P
from .model import (
    AstPattern, AstQuery, JsonPathEq, JsonPathRegex, MetaVariable, Policy, Rule, RuleSet, Scan, Taint, TaintPattern, TextRegex, TextRegexMulti, languages,
)

#: Keys that make a YAML rule one of code patterns.
PATTERN_KEYS = {
    "pattern", "pattern-not", "pattern-either", "patterns", "pattern-sources", "pattern-sinks", "pattern-regex", "metavariable-pattern",
}
WASM_LEAST, WASM_MOST = 8, 10 * 1024 * 1024


class RuleError(ValueError):
    pass


def _check(regex: str, rule: str) -> str:
    import regex as rx

    try:
        rx.compile(regex)
    except rx.error as e:
        raise RuleError(f"rule {rule}: {e} in {regex[:100]}") from None
    return regex


def _common(doc: dict, source_file: str | None) -> dict[str, Any]:
    try:
        severity = parse_severity(str(doc.get("severity", "MEDIUM")))
    except ValueError as e:
        raise RuleError(f"rule {doc.get('id')}: {e}") from None
    meta = doc.get("metadata") or {}
    options = doc.get("options") or {}
    return {
        "id": str(doc["id"]), "severity": severity, "message": str(doc.get("message") or doc.get("description") or ""),
        "category": str(doc.get("category") or meta.get("category") or "general"), "remediation": doc.get("remediation"), "fix": doc.get("fix"),
        "interfile": bool(options.get("interfile", False)), "languages": languages(doc.get("languages")), "source_file": source_file,
    }


# Native YAML and JSON


def native_rules(doc: dict, source_file: str | None = None) -> list[Rule]:
    """Rules of one native document; a document may hold a tree query and a tree pattern."""
    base = _common(doc, source_file)
    found: list[Rule] = []
    for regex in doc.get("text_patterns") or ():
        found.append(Rule(matcher=TextRegex(_check(str(regex), base["id"])), **base))
    if q := doc.get("ast_query"):
        q = {"kind": q} if isinstance(q, str) else q
        value = q.get("value")
        matcher = AstQuery(_check(str(q["kind"]), base["id"]), None if value is None else _check(str(value), base["id"]))
        found.append(Rule(matcher=matcher, **base))
    if p := doc.get("ast-pattern") or doc.get("ast_pattern"):
        mvs = p.get("metavariables") or {}
        mvs = tuple(MetaVariable(str(m["kind"]), None if m.get("value") is None else str(m["value"])) for m in mvs.values())
        found.append(Rule(matcher=AstPattern(str(p["kind"]), p.get("within"), mvs), **base))
    if policy := doc.get("policy"):
        found.append(Rule(matcher=Policy(str(policy)), **base))
    return found


def json_rules(doc: dict, source_file: str | None = None) -> list[Rule]:
    """``{"rules": {namespace: {id: rule}}}``; a rule's query has a path and a value, a pattern, or both."""
    found = []
    for space, rules in (doc.get("rules") or {}).items():
        for name, r in rules.items():
            q = r.get("query") or {}
            langs = r.get("languages") or ([q["type"]] if q.get("type") else None)
            base = _common({**r, "id": f"{space}.{name}", "languages": langs}, source_file)
            path = str(q.get("path", ""))
            if "value" in q:
                found.append(Rule(matcher=JsonPathEq(path, canonical(q["value"])), **base))
            if "pattern" in q:
                found.append(Rule(matcher=JsonPathRegex(path, _check(str(q["pattern"]), base["id"])), **base))
    return found


# Code patterns


@dataclass
class _Walk:
    """What a tree of pattern entries comes to: flat lists, in which alternatives and conjunctions are alike."""

    allow: list[tuple[str, bool]]
    deny: list[str]
    inside: list[str]
    not_inside: list[str]
    focus: str | None


def _variables(node: object, into: dict[str, str]) -> dict[str, str]:
    """Regexes of metavariables anywhere in a rule; nested patterns stand in where there is no regex."""
    if isinstance(node, list):
        for x in node:
            _variables(x, into)
    elif isinstance(node, dict):
        if isinstance(m := node.get("metavariable-regex"), dict):
            into[str(m["metavariable"]).lstrip("$")] = str(m["regex"])
        if isinstance(m := node.get("metavariable-pattern"), dict):
            name = str(m["metavariable"]).lstrip("$")
            own = [p for p, is_regex in _walk(m).allow]
            if own and name not in into:
                into[name] = "|".join(P.translate(p).regex for p in own)
        for k, v in node.items():
            if k not in ("metavariable-pattern", "metavariable-regex"):
                _variables(v, into)
    return into


def _texts(x: object) -> list[str]:
    return [str(i) for i in x] if isinstance(x, list) else [str(x)]


def _walk(node: object, into: _Walk | None = None) -> _Walk:
    w = into or _Walk([], [], [], [], None)
    if isinstance(node, str):
        w.allow.append((node, False))
    elif isinstance(node, list):
        for x in node:
            _walk(x, w)
    elif isinstance(node, dict):
        for k, v in node.items():
            if k == "pattern":
                w.allow += [(t, False) for t in _texts(v)]
            elif k == "pattern-regex":
                w.allow += [(t, True) for t in _texts(v)]
            elif k == "pattern-not" and isinstance(v, (str, list)):
                w.deny += _texts(v)
            elif k == "pattern-inside" and isinstance(v, (str, list)):
                w.inside += _texts(v)
            elif k == "pattern-not-inside" and isinstance(v, (str, list)):
                w.not_inside += _texts(v)
            elif k == "focus-metavariable":
                w.focus = str(v[0] if isinstance(v, list) else v).lstrip("$")
            elif k in ("patterns", "pattern-either"):
                _walk(v, w)
    return w


def _scan(text: str, mv: dict[str, str], rule: str, is_regex: bool = False, whole: bool = False) -> tuple[Scan, dict[str, int]]:
    c = P.Compiled(text, {}) if is_regex else P.exact(text, mv)
    return Scan(_check(c.regex, rule), P.unit_of(c.regex, is_regex) if not whole else "line"), c.groups


def _lines(patterns: list[str]) -> list[str]:
    """Each line of a context pattern is a pattern of its own; lines of only an ellipsis are none."""
    return [t for p in patterns for line in p.splitlines() if (t := line.strip()) and t != "..."]


def _taint(entries: object, mv: dict[str, str], rule: str) -> tuple[TaintPattern, ...]:
    found = []
    for e in entries if isinstance(entries, list) else [entries] if entries else []:
        own = _variables(e, dict(mv))
        w = _walk(e)
        allow = [_scan(t, own, rule, r) for t, r in w.allow]
        inside = [_scan(t, own, rule) for t in _lines(w.inside)]
        not_inside = [_scan(t, own, rule)[0] for t in _lines(w.not_inside)]
        deny = _scan(w.deny[-1], own, rule)[0] if w.deny else None
        group = lambda gs: gs.get(w.focus, 0) if w.focus else 0  # noqa: E731, B023
        if allow:
            found.append(TaintPattern(
                tuple(s for s, _ in allow), tuple(group(g) for _, g in allow), deny, tuple(s for s, _ in inside), tuple(group(g) for _, g in inside), tuple(not_inside),
            ))
    return tuple(found)


def pattern_rules(doc: dict, source_file: str | None = None) -> list[Rule]:
    """The rule of a document of code patterns; none if no positive pattern is left."""
    base = _common(doc, source_file)
    mv = _variables(doc, {})
    name = base["id"]
    if "pattern-sources" in doc or "pattern-sinks" in doc:
        parts = [_taint(doc.get(f"pattern-{k}"), mv, name) for k in ("sources", "sinks", "sanitizers", "reclass")]
        return [Rule(matcher=Taint(*parts), **base)]
    if any(k in doc for k in ("patterns", "pattern-inside", "pattern-not-inside", "pattern-either")):
        w = _walk({k: v for k, v in doc.items() if k in PATTERN_KEYS | {"pattern-inside", "pattern-not-inside"}})
        if not w.allow:
            return []
        # Context patterns and positive ones are looked for a line at a time, given regexes over the source.
        allow = tuple(_scan(t, mv, name, r, whole=not r)[0] for t, r in w.allow)
        ranges = [tuple(_scan(t, mv, name, whole=True)[0] for t in x) for x in (w.inside, w.not_inside)]
        deny = [P.exact(t, mv).regex for t in w.deny]
        deny_scan = Scan(_check("|".join(f"(?:{d.removeprefix('(?s)')})" for d in deny), name)) if deny else None
        return [Rule(matcher=TextRegexMulti(allow, deny_scan, *ranges), **base)]
    if "pattern" in doc:
        text = str(doc["pattern"])
        call = re.match(r"\s*([A-Za-z_][\w.]*)\s*\(", text)
        return [Rule(matcher=TextRegex(_check(P.anywhere(text, mv).regex, name), call[1] if call else ""), **base)]
    if "pattern-regex" in doc:
        return [Rule(matcher=TextRegex(_check(str(doc["pattern-regex"]), name)), **base)]
    return []


# Documents and folders


def yaml_rules(text: str, source_file: str | None = None) -> list[Rule]:
    import yaml

    found: list[Rule] = []
    for doc in yaml.safe_load_all(text):
        entries = doc.get("rules", [doc]) if isinstance(doc, dict) else doc or []
        for e in entries:
            if not isinstance(e, dict) or "id" not in e:
                raise RuleError(f"{source_file}: a rule has no id")
            found += pattern_rules(e, source_file) if PATTERN_KEYS & e.keys() else native_rules(e, source_file)
    return found


def check_wasm(data: bytes) -> None:
    """Magic and size of a compiled policy; there is nothing here to run one, see the registry of policies."""
    if not WASM_LEAST <= len(data) <= WASM_MOST:
        raise RuleError(f"a compiled policy has {len(data)} bytes")
    if data[:4] != b"\0asm":
        raise RuleError("not a compiled policy")


def wasm_rules(path: str) -> list[Rule]:
    """A compiled policy with its sidecar document; its rule calls the registered policy of that name."""
    import yaml

    with open(path, "rb") as f:
        check_wasm(f.read())
    for ext in (".json", ".yaml", ".yml"):
        if os.path.exists(path + ext):
            with open(path + ext, encoding="utf-8") as f:
                doc = yaml.safe_load(f)
            base = _common({"id": os.path.basename(path)[:-5], **(doc or {})}, path)
            return [Rule(matcher=Policy(str((doc or {}).get("policy") or base["id"])), **base)]
    raise RuleError(f"{path} has no sidecar document")


def rules_of_file(path: str) -> list[Rule]:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "wasm":
        return wasm_rules(path)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if ext == "json":
        return json_rules(json.loads(text), path)
    return yaml_rules(text, path)


def rule_files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    found = []
    for folder, dirs, names in os.walk(path):
        dirs[:] = sorted(d for d in dirs if d != ".git" and not os.path.islink(os.path.join(folder, d)))
        found += [os.path.join(folder, n) for n in sorted(names) if n.lower().endswith((".yaml", ".yml", ".json", ".wasm")) and not re.search(r"\.wasm\.(json|ya?ml)$", n)]
    return found


def unique(rules: list[Rule]) -> RuleSet:
    """Refuses an id of two documents. A document's own rules may share its id."""
    seen: dict[str, tuple] = {}
    for r in rules:
        at = (r.source_file, r.message, r.severity)
        if seen.setdefault(r.id, at) != at or (type(r.matcher) in [type(x.matcher) for x in rules if x.id == r.id and x is not r]):
            raise RuleError(f"duplicate rule id: {r.id}")
    return RuleSet(rules)


def load_rules(path: str) -> RuleSet:
    """All rules of a file or folder, in the order of their paths."""
    return unique([r for f in rule_files(path) for r in rules_of_file(f)])


def load_rule_dirs(paths: list[str]) -> RuleSet:
    """Folders one after the other; ids are checked within each."""
    out = RuleSet()
    for p in paths:
        out = out + load_rules(p)
    return out


def verify(path: str) -> list[tuple[str, str]]:
    """(file, error) of each file that doesn't load, and of each id met twice."""
    errors, seen = [], {}
    for f in rule_files(path):
        try:
            for r in rules_of_file(f):
                if seen.setdefault(r.id, f) != f:
                    errors.append((f, f"duplicate rule id: {r.id}"))
        except Exception as e:  # noqa: BLE001
            errors.append((f, str(e)))
    return errors


def verify_table(documents: DataFrame) -> DataFrame:
    """file, error of a table (file, text) of rule documents in YAML or JSON: what doesn't load, and ids that an earlier document has.

    Documents are read where they are; ids meet by a shuffle, and the first document of each is found by a minimum.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b.file, b.text, strict=True):
                try:
                    found = json_rules(json.loads(text or ""), file) if file.lower().endswith(".json") else yaml_rules(text or "", file)
                    rows += [(file, r, None) for r in dict.fromkeys(x.id for x in found)]
                except Exception as e:  # noqa: BLE001  whatever keeps a document from loading is told
                    rows.append((file, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "rule_id", "error"])

    read = documents.select("file", "text").mapInPandas(run, "file string, rule_id string, error string")
    read = cut(read, "rule-documents")
    first = read.where("rule_id is not null").groupBy("rule_id").agg(F.min("file").alias("first"))
    twice = read.join(shuffled(first), "rule_id").where("file != first").select("file", F.concat(F.lit("duplicate rule id: "), "rule_id").alias("error"))
    return read.where("error is not null").select("file", "error").unionByName(twice)
