"""Many line rules at the cost of a few: text that a regex can't match without, found for all rules by one automaton.

Each regex is read for literals of which every match holds one. All rules' literals are the keys of one automaton, which
goes over a file once, whatever their number; only the lines and rules that meet in it are given to the regexes,
which decide as they do without it. Rules without such a literal are left to the caller.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.batches import arrow_pieces
from sieveflow.functions.scalar import end_of_text
from sieveflow.rules.model import Rule

#: Rules from which the automaton is worth its pass, characters of the shortest literal, alternatives at most.
MANY, SHORTEST, ALTERNATIVES = 4, 3, 16
#: What the two kinds of regexes read differently.
_OTHER = re.compile(r"\\[0vhHRXGzZQE]|\(\?[a-zA-Z]*[ixu]|&&")
#: Groups other than plain and named ones, and braces other than counts.
_ODD = re.compile(r"\(\?(?!:|P<)|\{(?!\d+(?:,\d*)?\}|,\d+\})")
_END = re.compile(r"\r?\n\Z")
_LINE = re.compile(r"\r?\n")


def required(pattern: str) -> tuple[str, ...]:
    """Literals of which each match holds at least one; none if that can't be told."""
    if _OTHER.search(pattern):
        return ()
    try:
        return _best(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return ()


@lru_cache(1024)
def plain(pattern: str) -> bool:
    """Whether a regex takes at least a character and looks at nothing around its match but a word's boundary.

    Of such a one, what is found within a line of a text is what is found in the line alone, as long as no match goes over a line's end.
    """
    if _OTHER.search(pattern) or _ODD.search(pattern):
        return False
    try:
        items = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return items.getwidth()[0] > 0 and _plain(items)


def _plain(items) -> bool:
    for op, value in items:
        if op is sre.SUBPATTERN:
            ok = _plain(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            ok = _plain(value[2])
        elif op is sre.BRANCH:
            ok = all(map(_plain, value[1]))
        else:
            ok = op in (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN) or op is sre.AT and value in (sre.AT_BOUNDARY, sre.AT_NON_BOUNDARY)
        if not ok:
            return False
    return True


@lru_cache(1024)
def held(pattern: str) -> tuple[str, ...]:
    """:func:`required` of a plain regex, none of others."""
    return required(pattern) if plain(pattern) else ()


def _worth(literals: tuple[str, ...]) -> int:
    return min(map(len, literals)) if literals else 0


def _best(items) -> tuple[str, ...]:
    """The best of a sequence: its longest literal, or what one of its parts requires."""
    found: list[tuple[str, ...]] = []
    run = ""
    for op, value in items:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        found.append((run,))
        run = ""
        if op is sre.SUBPATTERN:
            found.append(_best(value[3]))
        elif op is sre.ATOMIC_GROUP:
            found.append(_best(value))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_best(value[2]))
        elif op is sre.BRANCH:
            arms = [_best(arm) for arm in value[1]]
            if all(arms) and sum(map(len, arms)) <= ALTERNATIVES:
                found.append(tuple(dict.fromkeys(x for arm in arms for x in arm)))
    found.append((run,))
    best = max(found, key=_worth)
    return best if _worth(best) >= SHORTEST else ()


def literal_rules(rules: list[tuple[int, Rule]]) -> tuple[list[tuple[int, Rule]], list[tuple[int, Rule]]]:
    """(rules with a required literal, the others)."""
    some = [(i, r) for i, r in rules if required(r.matcher.regex)]
    held = {i for i, _ in some}
    return some, [(i, r) for i, r in rules if i not in held]


def literal_hits(files: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Every (rule, line) whose regex matches: ord, file, line, column, excerpt."""
    keys: dict[str, list[int]] = {}
    for k, (_, r) in enumerate(rules):
        for literal in required(r.matcher.regex):
            keys.setdefault(literal, []).append(k)
    kinds = [r for _, r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for literal, of in keys.items():
            automaton.add_word(literal, of)
        automaton.make_automaton()
        for b in (p for whole in batches for p in arrow_pieces(whole, "source")):
            out: tuple[list, ...] = ([], [], [], [])
            for file, kind, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not source:
                    continue
                applies = [r.applies(kind or "") for r in kinds]
                starts: list[int] | None = None
                met: set[tuple[int, int]] = set()
                for at, of in automaton.iter(source):
                    if starts is None:
                        body = _END.sub("", source)
                        ends = [(m.start(), m.end()) for m in _LINE.finditer(body)]
                        starts = [0, *(b for _, b in ends)]
                    line = bisect_right(starts, at)
                    met.update((line, k) for k in of if applies[k])
                for line, k in met:
                    out[0].append(k)
                    out[1].append(file)
                    out[2].append(line)
                    out[3].append(body[starts[line - 1] : ends[line - 1][0] if line <= len(ends) else len(body)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], ["k", "file", "line", "text"])

    near = files.select("file_path", "file_type", "source").mapInArrow(run, "k int, file string, line int, text string")
    test = None
    for k, (_, r) in enumerate(rules):
        hit = F.col("text").rlike(end_of_text(r.matcher.regex))
        test = F.when(F.col("k") == k, hit) if test is None else test.when(F.col("k") == k, hit)
    order = F.element_at(F.array(*[F.lit(i) for i, _ in rules]), F.col("k") + 1)
    return near.where(test).select(order.alias("ord"), "file", "line", F.lit(1).alias("column"), F.col("text").alias("excerpt"))
