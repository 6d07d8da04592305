"""Taint rules: where patterns find sources, sanitisers and sinks, joined per file.

What the patterns capture is found in Arrow batches over the sources (occurrences with positions);
all combining after that is joins on file and symbol.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveflow.functions.batches import in_pieces
from sieveflow.functions.durable import shuffled
from sieveflow.rules.model import Rule, Scan, Taint, TaintPattern, TextRegexMulti
from sieveflow.sources.code import SUPERGLOBALS

from .calls import Scopes, tainted_variables
from .layout import Layout, Ranges
from .text import ERROR, Clock, find_all, not_in_context, occurrences, spans

ROLES = ("sources", "sanitizers", "reclass", "sinks")
CAUGHT = "ord int, file string, file_type string, role string, sym string, line int, `column` int, excerpt string, text string, function string"
_LHS = re.compile(r"(\$?[A-Za-z_]\w*)\s*(?::\s*[A-Za-z_]\w*)?\s*=\s*[^=]*\Z")


def caught(p: TaintPattern, text: str | Layout, role: str, language: str, clock: Clock | None = None) -> list[tuple[str, int, int]]:
    """(symbol, start, end) of what a pattern marks.

    A symbol is the focus group's text; or the left side of the assignment before the match; or the
    variables in the match; or in PHP the superglobals of its line. A source or sink whose ``inside`` is
    not in the file marks nothing; a sanitiser's is only looked at where it is.
    """
    layout, clock = text if isinstance(text, Layout) else Layout(text), clock or Clock()
    text = layout.text
    inside = Ranges(spans(p.inside, layout, clock))
    if p.inside and not inside.starts and role in ("sources", "sinks"):
        return []
    out = not_in_context(p, layout, clock)
    found: list[tuple[str, int, int]] = []
    for k, s in enumerate(p.allow):
        group = p.focus[k] if k < len(p.focus) else 0
        for at, m in find_all(s, text, clock):
            a, b = at + m.start(), at + m.end()
            if inside.starts and not inside.hold((a, b)) or out(a, b):
                continue
            if role == "sinks":
                found.append(("", a, b))
                continue
            if group and m[group]:
                names = [m[group].strip()]
            elif left := _LHS.search(layout.line_before(a)):
                names = [left[1]]
            else:
                names = re.findall(r"\$\w+", text[a:b])
                if not names and language == "php":
                    names = [f"${g}" for g in SUPERGLOBALS if f"${g}" in layout.whole_lines(a, b)]
            found += [(n.lstrip("$"), a, b) for n in names]
    # Context patterns with a focus mark their own symbols.
    for k, s in enumerate(p.inside if role != "sinks" else ()):
        if group := p.inside_focus[k] if k < len(p.inside_focus) else 0:
            found += [(m[group].strip().lstrip("$"), at + m.start(group), at + m.end(group)) for at, m in find_all(s, text, clock) if m[group]]
    return found


def taint_captures(files: DataFrame, rules: list[tuple[int, Rule]], seconds: float | None = None) -> DataFrame:
    """All that the patterns of taint rules mark, in one pass over the sources; a row with an error where a rule took too long over a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, kind, text in zip(b.file_path, b.file_type, b.source, strict=True):
                layout = Layout(text or "")
                scopes = Scopes(file, kind, layout)
                for i, r in rules:
                    if text and r.applies(kind):
                        own, clock = [], Clock(seconds)
                        try:
                            for role in ROLES:
                                for p in getattr(r.matcher, role):
                                    for sym, s, e in caught(p, layout, role, kind, clock):
                                        own.append((i, file, kind, role, sym, *layout.place(s), layout.whole_lines(s, e), text[s:e], scopes.of(s), None))
                        except TimeoutError as e:
                            own = [(i, file, kind, None, None, 0, 0, None, None, None, f"timeout: {e}")]
                        rows += own
            yield pd.DataFrame(rows, columns=["ord", "file", "file_type", "role", "sym", "line", "column", "excerpt", "text", "function", "error"])

    return in_pieces(files.select("file_path", "file_type", "source"), run, CAUGHT + ERROR, "source").distinct()


def matches_of(rule: Rule, layout: Layout, language: str, clock: Clock) -> int | None:
    """How many places a rule over text marks in a file (lines, occurrences, or what its patterns capture); None where its time ran out."""
    m = rule.matcher
    try:
        if isinstance(m, Taint):
            return sum(len(caught(p, layout, role, language, clock)) for role in ROLES for p in getattr(m, role))
        if isinstance(m, TextRegexMulti):
            return len(occurrences(m, layout, clock))
        return len({layout.place(at + m_.start())[0] for at, m_ in find_all(Scan(m.regex), layout.text, clock)})
    except TimeoutError:
        return None


def interfile_hits(captures: DataFrame, edges: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Hits of rules that look over files: sinks that hold a variable to which calls, returns and assignments lead from a source.

    ``edges`` is of the whole corpus (:func:`sieveflow.operators.calls.passes`). A variable is one of its function, whatever the file.
    """
    own = captures.where(F.col("ord").isin([i for i, r in rules if r.interfile]))
    clean = own.where("role = 'sanitizers'").select("ord", "file", "sym").distinct()
    sources = own.where("role = 'sources' and sym != ''").join(shuffled(clean), ["ord", "file", "sym"], "left_anti")
    reached = tainted_variables(edges, sources.select("ord", "function", F.col("sym").alias("variable")).distinct(), ("ord",))
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0))))
    sinks = own.where("role = 'sinks'").select("ord", "file", "line", "column", "excerpt", "function", names.alias("variable"))
    hit = sinks.join(shuffled(reached), ["ord", "function", "variable"], "left_semi")
    return hit.select("ord", "file", "line", "column", "excerpt", F.lit(None).cast("string").alias("severity")).distinct()


def taint_hits(captures: DataFrame, symbols: DataFrame, paths: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Hits (ord, file, line, column, excerpt, severity) at sinks.

    A sink of a file counts if a source is left there that no sanitiser takes away, and the file has a
    tainted path (``paths``: file_path), or the sink names the source itself. A sink whose variables are
    all sanitised does not; one without variables does, but for PHP. Sources that a reclassifier marks
    make a finding LOW. ``direct`` has (file_path, sym, var) where the dataflow leads from a symbol to
    a variable.
    """
    of = lambda role: captures.where(F.col("role") == role)
    sources = of("sources").select("ord", "file", "sym").distinct()
    sources = sources.join(shuffled(of("sanitizers").select("ord", "file", "sym").distinct()), ["ord", "file", "sym"], "left_anti")
    low = of("reclass").select("ord", "file", "sym", F.lit(True).alias("low")).distinct()
    sources = sources.join(shuffled(low), ["ord", "file", "sym"], "left")

    sinks = of("sinks").select("ord", "file", "file_type", "line", "column", "excerpt", "text")
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\$([A-Za-z0-9_]+)"), F.lit(1)))
    sinks = sinks.withColumn("vars", names)
    # How many of a sink's variables are sanitised in its file.
    key = ["ord", "file", "line", "column", "text"]
    clean = symbols.where("sanitized").select(F.col("file_path").alias("file"), F.regexp_replace("name", r"^\$", "").alias("var")).distinct()
    safe = sinks.select(*key, F.explode("vars").alias("var")).join(shuffled(clean), ["file", "var"], "left_semi").groupBy(*key).agg(F.count("*").alias("n_safe"))
    sinks = sinks.join(shuffled(safe), key, "left")
    some = F.size("vars") > 0
    sinks = sinks.where(F.when(some, F.coalesce("n_safe", F.lit(0)) < F.size("vars")).otherwise(F.col("file_type") != "php"))

    j = sinks.join(shuffled(sources), ["ord", "file"])
    flagged = paths.select(F.col("file_path").alias("file"), F.lit(True).alias("path")).distinct()
    j = j.join(shuffled(flagged), "file", "left")
    named = F.array_contains("vars", F.col("sym"))
    if direct is not None:
        d = direct.select(F.col("file_path").alias("file"), "sym", "var").groupBy("file", "sym").agg(F.collect_set("var").alias("leads"))
        j = j.join(shuffled(d), ["file", "sym"], "left")
        named |= F.coalesce(F.arrays_overlap("leads", "vars"), F.lit(False))
    php = (F.col("file_type") == "php") & named
    j = j.where(F.coalesce("path", F.lit(False)) | php)
    severity = F.when(F.bool_and(F.coalesce("low", F.lit(False))), "LOW")
    return j.groupBy("ord", "file", "line", "column", "excerpt").agg(severity.alias("severity"))


def named_ends(rules: list[tuple[int, Rule]], spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(ord, node) of the named sources, and of the named sinks."""
    frame = lambda of: spark.createDataFrame([(i, n) for i, r in rules for n in of(r)], "ord int, node string")
    return frame(lambda r: r.sources), frame(lambda r: r.sinks)


def names_flow(rules: list[tuple[int, Rule]], call_edges: DataFrame) -> dict[int, bool]:
    """For rules with named sources and sinks: whether the call graph joins them."""
    from .graph import reach, undirected

    named = [(i, r) for i, r in rules if r.sources and r.sinks]
    if not named:
        return {}
    sources, sinks = named_ends(named, call_edges.sparkSession)
    # One walk for all rules.
    reached = reach(undirected(call_edges), sources, key=("ord",))
    joined = {r[0] for r in reached.join(sinks, ["ord", "node"], "left_semi").select("ord").distinct().collect()}
    return {i: i in joined for i, _ in named}


def is_taint(rule: Rule) -> bool:
    return isinstance(rule.matcher, Taint)
