"""Text matchers: lines by built-in regex functions, occurrences with context in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveflow.functions.batches import arrow_pieces
from sieveflow.functions.durable import shuffled
from sieveflow.functions.scalar import end_of_text
from sieveflow.rules.model import Rule, Scan, TaintPattern, TextRegexMulti
from sieveflow.sources.corpus import lines

from . import literals
from .layout import Layout, Ranges

#: What a matcher gives: the rule's position, the file, the place and the excerpt.
HITS = "ord int, file string, line int, `column` int, excerpt string"
#: Matches of one regex in one line, at most: a guard against expressions that match everywhere.
LINE_MATCHES = 1000
#: Seconds that one rule may take over one file; beyond them the rule is skipped for the file, and that is told.
TIME_LIMIT = 5.0
ERROR = ", error string"
NAMES = ["ord", "file", "line", "column", "excerpt", "error"]
#: Characters of excerpts that a task's Python holds before it hands them on.
HELD = 4 << 20
#: Characters of a text, and seconds, up to which a line scan first tries the whole text at once.
WHOLE, WHOLE_SECONDS = 1 << 20, 0.5


class Clock:
    """What is left of a rule's time over a file; an expression that runs out of it raises TimeoutError."""

    def __init__(self, seconds: float | None = None):
        self.end = time.monotonic() + (TIME_LIMIT if seconds is None else seconds)

    def left(self) -> float:
        if (left := self.end - time.monotonic()) <= 0:
            raise TimeoutError("the time limit of a rule over a file")
        return left


def applies(rule: Rule, file_type: str | Column = "file_type") -> Column:
    c = F.col(file_type) if isinstance(file_type, str) else file_type
    return F.lit(True) if "generic" in rule.languages else F.lower(c).isin(*rule.languages)


def line_hits(files: DataFrame, rules: list[tuple[int, Rule]], text: str = "text") -> DataFrame:
    """Every (rule, line) whose regex matches, for any number of rules in one scan; see :mod:`literals` for many."""
    if text == "text" and "source" in files.columns and len((some := literals.literal_rules(rules))[0]) >= literals.MANY:
        found = literals.literal_hits(files, some[0])
        return found.unionByName(line_hits(files, some[1])) if some[1] else found
    src = lines(files)
    tests = [F.when(applies(r) & F.col(text).rlike(end_of_text(r.matcher.regex)), F.lit(i)) for i, r in rules]
    hit = F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))
    return src.select(hit.alias("ord"), F.col("file_path").alias("file"), "line", F.lit(1).alias("column"), F.col(text).alias("excerpt"))


def import_aliases(nodes: DataFrame) -> DataFrame:
    """file_path, alias, module of the imports among nodes (``import.m``, ``import_from.m.n``)."""
    imports = nodes.where(F.col("path").rlike(r"^import(_from)?\."))
    module = F.regexp_replace("path", r"^import(_from)?\.", "")
    alias = F.get_json_object("value_json", "$.alias")
    last = F.element_at(F.split(module, r"\.|::"), -1)
    return imports.select("file_path", F.coalesce(alias, last).alias("alias"), module.alias("module")).distinct()


def alias_hits(files: DataFrame, rules: list[tuple[int, Rule]], found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lines that call what a rule looks for under an import's alias, in files where the rule itself found nothing.

    The expression depends on the file, so it is a column; only files with a matching import get this far.
    """
    spark = files.sparkSession
    calls = spark.createDataFrame([(i, r.matcher.call, end_of_text(r.matcher.regex)) for i, r in rules if r.matcher.call], "ord int, call string, regex string")
    # ``call`` begins with an import's module; the rest of the call follows its alias.
    begins = (F.col("call") == F.col("module")) | F.col("call").startswith(F.concat("module", F.lit(".")))
    rest = F.substring(F.col("call"), F.length("module") + 1, F.length("call"))
    quoted = lambda c: F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    other = aliases.join(F.broadcast(calls), begins).select(
        "file_path", "ord", "regex", "call",
        F.concat(F.col("alias"), rest).alias("name"),
    ).where("name != call")
    rx = F.replace(F.col("regex"), quoted(F.col("call")), quoted(F.col("name")))
    other = other.select("file_path", "ord", rx.alias("rx")).join(shuffled(found.select(F.col("file").alias("file_path"), "ord").distinct()), ["file_path", "ord"], "left_anti")
    got = lines(files).join(shuffled(other), "file_path").where(F.expr("text rlike rx"))
    return got.select("ord", F.col("file_path").alias("file"), "line", F.lit(1).alias("column"), F.col("text").alias("excerpt")).distinct()


# Occurrences


def find_all(scan: Scan, text: str, clock: Clock | None = None, whole: bool = True) -> Iterator:
    """Matches in order; line scans see one line at a time (with its end) and stop at ``LINE_MATCHES`` in each. ``whole``: try the text at once first."""
    import regex

    rx, clock = regex.compile(scan.regex), clock or Clock()
    if scan.unit == "source":
        yield from ((0, m) for m in rx.finditer(text, timeout=clock.left()) if m.end() > m.start())
        return
    if whole and len(text) <= WHOLE and literals.plain(scan.regex) and (found := _over_lines(rx, text, clock)) is not None:
        yield from ((0, m) for m in found)
        return
    at = 0
    for line in text.splitlines(keepends=True) if "\r" not in text else _unix_lines(text):
        for n, m in enumerate(rx.finditer(line, timeout=clock.left())):
            if n >= LINE_MATCHES:
                break
            if m.end() > m.start():
                yield at, m
        at += len(line)


def _over_lines(rx, text: str, clock: Clock) -> list | None:
    """What a plain regex finds line by line, from one look at the whole text; None if a match goes over a line's end or the look takes long.

    A look in vain isn't taken from the rule's time.
    """
    if "\r" not in text and len(text.splitlines()) != text.count("\n") + (text[-1:] not in ("\n", "")):
        return None  # other ends of lines
    left, began = clock.left(), time.monotonic()
    found, end, n = [], -1, 0
    try:
        for m in rx.finditer(text, timeout=min(WHOLE_SECONDS, left)):
            a, b = m.span()
            if a > end:
                end, n = text.find("\n", a), 0
                if end < 0:
                    end = len(text)
            if b > end + 1:
                break
            n += 1
            if n <= LINE_MATCHES:
                found.append(m)
        else:
            return found
    except TimeoutError:
        pass
    clock.end += time.monotonic() - began
    return None


def _unix_lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def spans(scans: tuple[Scan, ...], text: str | Layout, clock: Clock | None = None) -> list[tuple[int, int]]:
    return list(map(tuple, spans_table(scans, text if isinstance(text, Layout) else Layout(text), clock).tolist()))


def spans_table(scans: tuple[Scan, ...], layout: Layout, clock: Clock | None = None) -> np.ndarray:
    """Rows of start and end, in order, each once."""
    parts = []
    for s in scans:
        if (got := _spans_over_lines(s, layout, clock)) is None:
            got = np.array([(at + m.start(), at + m.end()) for at, m in find_all(s, layout.text, clock, False)], np.int64).reshape(-1, 2)
        parts.append(got)
    if len(parts) == 1 and (len(parts[0]) < 2 or (np.diff(parts[0][:, 0]) > 0).all()):
        return parts[0]
    return _in_order(parts)


def _in_order(parts: list[np.ndarray]) -> np.ndarray:
    found = np.concatenate([np.empty((0, 2), np.int64), *parts])
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return found[np.concatenate(([True], (np.diff(found, axis=0) != 0).any(axis=1)))] if len(found) else found


def _spans_over_lines(scan: Scan, layout: Layout, clock: Clock | None) -> np.ndarray | None:
    """Places of :func:`_over_lines`, told for all matches at once; None where it has to be told otherwise."""
    import regex

    if scan.unit != "line" or len(layout.text) > WHOLE or not literals.plain(scan.regex) or "\r" not in layout.text and layout.other_ends:
        return None
    clock = clock or Clock()
    left, began = clock.left(), time.monotonic()
    try:
        rows = regex.compile(scan.regex).finditer(layout.text, timeout=min(WHOLE_SECONDS, left), concurrent=False)
        found = np.fromiter(chain.from_iterable(m.span() for m in rows), np.int64).reshape(-1, 2)
    except TimeoutError:
        found = None
    if found is not None:
        line = np.searchsorted(layout.newlines, found[:, 0])
        if (found[:, 1] <= np.append(layout.newlines, len(layout.text))[line] + 1).all():
            return found[np.arange(len(found)) - np.searchsorted(line, line) < LINE_MATCHES]
    clock.end += time.monotonic() - began
    return None


def not_in_context(m: TextRegexMulti | TaintPattern, layout: Layout, clock: Clock) -> Callable[[int, int], bool]:
    """A test of spans: denied, within a barred range, or in a block that holds what bars it."""
    import regex

    barred = Ranges(spans(m.not_inside, layout, clock))
    deny = regex.compile(m.deny.regex) if m.deny else None
    in_block = [(regex.compile(s.regex), literals.held(s.regex)) for s in m.not_inside]

    def test(a: int, b: int) -> bool:
        return bool(
            deny and deny.search(layout.text[a:b], timeout=clock.left()) or barred.hold((a, b)) or any(layout.block_matches(a, x, clock.left, some) for x, some in in_block)
        )

    return test


def occurrences(m: TextRegexMulti, text: str | Layout, clock: Clock | None = None) -> list[tuple[int, int]]:
    """Spans of the matcher's occurrences in a text."""
    return list(map(tuple, occurrence_table(m, text if isinstance(text, Layout) else Layout(text), clock or Clock()).tolist()))


def occurrence_table(m: TextRegexMulti, layout: Layout, clock: Clock) -> np.ndarray:
    """Rows of start and end: :func:`not_in_context`, with what ranges and blocks say told for all matches at once."""
    import regex

    inside = Ranges(spans_table(m.inside, layout, clock))
    if m.inside and not len(inside.table):
        return np.empty((0, 2), np.int64)
    bars = [spans_table((s,), layout, clock) for s in m.not_inside]
    barred = Ranges(bars[0] if len(bars) == 1 else _in_order(bars))
    found = spans_table(m.allow, layout, clock)
    found = found[~barred.held(found) & (inside.held(found) if m.inside else True)]
    if m.deny:
        deny = regex.compile(m.deny.regex)
        found = found[np.array([not deny.search(layout.text[a:b], timeout=clock.left()) for a, b in found.tolist()], bool)]
    for s, known in zip(m.not_inside, bars, strict=True):
        found = found[~layout.blocks_matched(found[:, 0], regex.compile(s.regex), clock.left, literals.held(s.regex), known)]
    return found


def occurrence_hits(files: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Findings of :class:`TextRegexMulti` rules: the place of each occurrence and its whole lines."""
    return occurrence_rows(files, rules).where("error is null").drop("error")


def occurrence_rows(files: DataFrame, rules: list[tuple[int, Rule]], seconds: float | None = None) -> DataFrame:
    """Hits, and a row with an error for each rule and file that took too long."""

    def of(layout: Layout, found: np.ndarray) -> Iterator[tuple]:
        """Lines, columns, excerpts of what was found, in parts of bounded size: a line is told with each of its matches."""
        first, last = layout.bounds(found)
        part = np.cumsum(last - first) // HELD
        for x in np.split(np.arange(len(found)), np.flatnonzero(np.diff(part)) + 1):
            yield *layout.places(found[x, 0]), [layout.text[a:b].rstrip("\r\n") for a, b in zip(first[x].tolist(), last[x].tolist(), strict=True)]

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        """Rule, file, lines, columns, excerpts, error."""
        for file, kind, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            layout = Layout(text or "")
            for i, r in rules:
                if text and r.applies(kind or ""):
                    try:
                        found = occurrence_table(r.matcher, layout, Clock(seconds))
                    except TimeoutError as e:
                        yield i, file, np.zeros(1, int), np.zeros(1, int), [None], f"timeout: {e}"
                        continue
                    if len(found):
                        yield from ((i, file, *x, None) for x in of(layout, found))

    def table(parts: list[tuple]) -> pa.RecordBatch:
        each = lambda k: pa.array([x for p in parts for x in [p[k]] * len(p[4])], pa.int32() if k == 0 else pa.string())
        whole = lambda k: pa.array(np.concatenate([p[k] for p in parts]).astype(np.int32))
        return pa.RecordBatch.from_arrays([each(0), each(1), whole(2), whole(3), pa.array([x for p in parts for x in p[4]], pa.string()), each(5)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in arrow_pieces(whole, "source")):
            parts, held = [], 0
            for p in rows(b):
                parts.append(p)
                held += sum(map(len, p[4])) if p[5] is None else 0
                if held > HELD:
                    yield table(parts)
                    parts, held = [], 0
            if parts:
                yield table(parts)

    return files.select("file_path", "file_type", "source").mapInArrow(run, HITS + ERROR)


# Ranges as tables


def spans_frame(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """id, start, end (code points, end exclusive) of all matches of a text, by built-in functions.

    ``split`` gives the gaps and ``regexp_extract_all`` the matches, whose lengths are summed up along the text.
    """
    t = F.col(text_col)
    gaps, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    texts = df.where(t.rlike(pattern)).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), sizes.alias("sizes"))
    rows = texts.select("id", "row", F.posexplode("sizes").alias("pos", "x"))
    along = W.partitionBy("row").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("x.gap") + F.coalesce("x.size", F.lit(0))).over(along).cast("int")
    ends = rows.select("id", F.col("x.size").alias("size"), end.alias("end")).where("size is not null")
    return ends.select("id", (F.col("end") - F.col("size")).alias("start"), "end")


def contained(matches: DataFrame, ranges: DataFrame, keep: bool = True) -> DataFrame:
    """Matches (id, start, end, ...) that lie within a range of the same id, or with ``keep`` False those that don't."""
    return covered(matches, ranges, "id", ("start", "end"), keep=keep)


def covered(rows: DataFrame, ranges: DataFrame, key: str, ends: tuple[str, str], strict: bool = False, keep: bool = True) -> DataFrame:
    """``rows`` that a range of their key covers: one that starts no later (with ``strict``, earlier) and ends no earlier.

    Rows and ranges of a key are put in order of their starts once; of the ranges before a row only the furthest end
    matters. So the work is that of a sort, whatever the number of pairs. A key's rows are one task's.
    """
    a, b = ends
    payload = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    kind = payload_type(rows)
    own = rows.select(F.col(key).alias("_key"), F.col(a).cast("long").alias("_at"), F.lit(0 if strict else 1).alias("_turn"), F.lit(None).cast("long").alias("_end"), payload.alias("_row"))
    over = ranges.select(F.col(key).alias("_key"), F.col(a).cast("long").alias("_at"), F.lit(1 if strict else 0).alias("_turn"), F.col(b).cast("long").alias("_end"), F.lit(None).cast(kind).alias("_row"))
    before = W.partitionBy("_key").orderBy("_at", "_turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    far = own.unionByName(over).withColumn("_far", F.max("_end").over(before)).where("_row is not null")
    is_ = F.coalesce(F.col("_far") >= F.col("_row").getField(b), F.lit(False))
    return far.where(is_ if keep else ~is_).select("_row.*")


def payload_type(rows: DataFrame) -> str:
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("x")).schema["x"].dataType.simpleString()


def holding(rows: DataFrame, inner: DataFrame, key: str, ends: tuple[str, str], keep: bool = True) -> DataFrame:
    """``rows`` that have one of ``inner`` within them, by the same order: of those that start no earlier only the nearest end matters."""
    a, b = ends
    payload = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    own = rows.select(F.col(key).alias("_key"), F.col(a).cast("long").alias("_at"), F.lit(0).alias("_turn"), F.lit(None).cast("long").alias("_end"), payload.alias("_row"))
    held = inner.select(F.col(key).alias("_key"), F.col(a).cast("long").alias("_at"), F.lit(1).alias("_turn"), F.col(b).cast("long").alias("_end"), F.lit(None).cast(payload_type(rows)).alias("_row"))
    # From the last start backwards, which keeps the frame a running one.
    after = W.partitionBy("_key").orderBy(F.desc("_at"), F.desc("_turn")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = own.unionByName(held).withColumn("_near", F.min("_end").over(after)).where("_row is not null")
    is_ = F.coalesce(F.col("_near") <= F.col("_row").getField(b), F.lit(False))
    return near.where(is_ if keep else ~is_).select("_row.*")
