"""Rules and their matchers."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sieveflow.schemas import RANK


@dataclass(frozen=True)
class Scan:
    """A regex and what it is run over: a line at a time or the whole source."""

    regex: str
    unit: str = "line"  # or "source"


@dataclass(frozen=True)
class TextRegex:
    """One finding for each line that the regex matches. ``call``: the dotted call whose aliases are looked for where nothing matches."""

    regex: str
    call: str = ""


@dataclass(frozen=True)
class TextRegexMulti:
    """Occurrences of any ``allow`` regex, within an ``inside`` range if there are any, within no ``not_inside`` range, and not denied."""

    allow: tuple[Scan, ...]
    deny: Scan | None = None
    inside: tuple[Scan, ...] = ()
    not_inside: tuple[Scan, ...] = ()


@dataclass(frozen=True)
class JsonPathEq:
    path: str
    value_json: str


@dataclass(frozen=True)
class JsonPathRegex:
    path: str
    regex: str


@dataclass(frozen=True)
class AstQuery:
    kind: str
    value: str | None = None


@dataclass(frozen=True)
class MetaVariable:
    kind: str
    value: str | None = None


@dataclass(frozen=True)
class AstPattern:
    kind: str
    within: str | None = None
    metavariables: tuple[MetaVariable, ...] = ()


@dataclass(frozen=True)
class Policy:
    """A registered policy function by name; what it denies is a finding."""

    name: str


@dataclass(frozen=True)
class TaintPattern:
    """What marks a source, sanitizer, reclassifier or sink. ``focus``: the group of each allow regex that holds the symbol, 0 for none."""

    allow: tuple[Scan, ...]
    focus: tuple[int, ...] = ()
    deny: Scan | None = None
    inside: tuple[Scan, ...] = ()
    inside_focus: tuple[int, ...] = ()
    not_inside: tuple[Scan, ...] = ()


@dataclass(frozen=True)
class Taint:
    sources: tuple[TaintPattern, ...]
    sinks: tuple[TaintPattern, ...]
    sanitizers: tuple[TaintPattern, ...] = ()
    reclass: tuple[TaintPattern, ...] = ()


Matcher = TextRegex | TextRegexMulti | JsonPathEq | JsonPathRegex | AstQuery | AstPattern | Policy | Taint


@dataclass(frozen=True)
class Rule:
    id: str
    matcher: Matcher
    severity: str = "MEDIUM"
    message: str = ""
    category: str = "general"
    remediation: str | None = None
    fix: str | None = None
    interfile: bool = False
    languages: tuple[str, ...] = ("generic",)
    source_file: str | None = None
    sources: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()

    def applies(self, file_type: str) -> bool:
        return "generic" in self.languages or file_type.lower() in self.languages

    def spec(self) -> str:
        return json.dumps({"kind": type(self.matcher).__name__, **asdict(self.matcher)}, sort_keys=True)

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode() + self.spec().encode()).hexdigest()


@dataclass
class RuleSet:
    """Rules in load order, which is their order in findings."""

    rules: list[Rule] = field(default_factory=list)

    def of(self, kind: type) -> list[tuple[int, Rule]]:
        return [(i, r) for i, r in enumerate(self.rules) if isinstance(r.matcher, kind)]

    def for_types(self, types: set[str]) -> RuleSet:
        """Without the rules whose languages don't occur. Positions stay as they were among what is left."""
        return RuleSet([r for r in self.rules if any(r.applies(t) for t in types)])

    def fingerprint(self) -> str:
        parts = "".join(f"{r.id}\0{r.hash()}\0" for r in sorted(self.rules, key=lambda r: (r.id, r.hash())))
        return hashlib.sha256(parts.encode()).hexdigest()

    def __add__(self, other: RuleSet) -> RuleSet:
        return RuleSet(self.rules + other.rules)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rules table, a row for each rule."""
        rows = [
            (i, r.id, r.severity, RANK[r.severity], r.category, r.message, r.remediation, r.fix, r.interfile, type(r.matcher).__name__, list(r.languages), r.source_file, r.spec())
            for i, r in enumerate(self.rules)
        ]
        return spark.createDataFrame(
            rows,
            "ord int, id string, severity string, severity_rank int, category string, message string, remediation string, fix string, "
            "interfile boolean, matcher string, languages array<string>, source_file string, spec_json string",
        )


def languages(found: object) -> tuple[str, ...]:
    """Trimmed, lower-case, each once; generic if there are none."""
    names = [found] if isinstance(found, str) else list(found or ())
    out = dict.fromkeys(str(n).strip().lower() for n in names if str(n).strip())
    return tuple(out) or ("generic",)
