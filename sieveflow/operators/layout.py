"""Places in one text: lines, columns, brace pairs and ranges, each found in one pass and then looked up."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cached_property
from itertools import accumulate

import numpy as np

_BRACES = re.compile(r"[{}]")
#: Characters between two places whose byte offsets are kept.
_STRIDE = 512


class Ranges:
    """Spans, by their starts, with the furthest end of all that start no later."""

    def __init__(self, spans: list[tuple[int, int]] | np.ndarray):
        """An array's rows are in order already."""
        self.table = spans if isinstance(spans, np.ndarray) else np.array(sorted(spans), np.int64).reshape(-1, 2)
        self.far = np.maximum.accumulate(self.table[:, 1])

    @cached_property
    def starts(self) -> list[int]:
        return self.table[:, 0].tolist()

    @cached_property
    def furthest(self) -> list[int]:
        return self.far.tolist()

    def hold(self, span: tuple[int, int]) -> bool:
        """Whether one range holds all of a span: of those that start in time, the one that ends last has to."""
        i = bisect_right(self.starts, span[0]) - 1
        return i >= 0 and self.furthest[i] >= span[1]

    def held(self, spans: np.ndarray) -> np.ndarray:
        """:meth:`hold` of each row of spans."""
        if not len(self.far):
            return np.zeros(len(spans), bool)
        i = np.searchsorted(self.table[:, 0], spans[:, 0], "right") - 1
        return (i >= 0) & (self.far[i] >= spans[:, 1])


class Layout:
    """What the places of a text are looked up in. Each table is linear in the text and made when it is first needed."""

    def __init__(self, text: str):
        self.text = text
        self._judged: dict[tuple[int, object], bool] = {}
        self._met: dict[str, np.ndarray] = {}

    def _places(self, characters: str) -> np.ndarray:
        """Where the text has one of some ASCII characters."""
        if self.text.isascii():
            codes = np.frombuffer(self.text.encode(), np.uint8)
            return np.flatnonzero(np.logical_or.reduce([codes == ord(c) for c in characters]))
        return np.fromiter((m.start() for m in re.finditer(f"[{characters}]", self.text)), np.int64)

    @cached_property
    def newlines(self) -> np.ndarray:
        return self._places("\n")

    @cached_property
    def starts(self) -> np.ndarray:
        """Where lines start, as an array."""
        return np.concatenate(([0], self.newlines + 1))

    @cached_property
    def line_starts(self) -> list[int]:
        return self.starts.tolist()

    @cached_property
    def other_ends(self) -> bool:
        """Whether Python sees ends of lines where there is no line feed."""
        return len(self.text.splitlines()) != len(self.newlines) + (self.text[-1:] not in ("\n", ""))

    @cached_property
    def _bytes_before(self) -> list[int] | None:
        """Bytes before each stride of a text, None for one of ASCII alone."""
        if self.text.isascii():
            return None
        sizes = (len(self.text[i : i + _STRIDE].encode("utf-8", "surrogatepass")) for i in range(0, len(self.text), _STRIDE))
        return [0, *accumulate(sizes)]

    def byte_offset(self, at: int) -> int:
        if self._bytes_before is None:
            return at
        i = min(at // _STRIDE, len(self._bytes_before) - 1)
        return self._bytes_before[i] + len(self.text[i * _STRIDE : at].encode("utf-8", "surrogatepass"))

    def place(self, at: int) -> tuple[int, int]:
        """1-based line, 1-based byte column."""
        line = bisect_right(self.line_starts, at)
        return line, self.byte_offset(at) - self.byte_offset(self.line_starts[line - 1]) + 1

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`place` of each: lines and columns."""
        line = np.searchsorted(self.starts, at, "right")
        if self._bytes_before is None:
            return line, at - self.starts[line - 1] + 1
        return line, np.array([self.place(i)[1] for i in at.tolist()], np.int64)

    def bounds(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where :meth:`whole_lines` goes for each row of spans, before what it strips."""
        ends = np.append(self.newlines, len(self.text))
        return self.starts[np.searchsorted(self.starts, spans[:, 0], "right") - 1], ends[np.searchsorted(self.starts, np.maximum(spans[:, 0], spans[:, 1] - 1), "right") - 1]

    def line_before(self, at: int) -> str:
        """A place's line up to it."""
        return self.text[self.line_starts[bisect_right(self.line_starts, at) - 1] : at]

    def whole_lines(self, start: int, end: int) -> str:
        """The lines that a span touches, without the last one's end."""
        first = self.line_starts[bisect_right(self.line_starts, start) - 1]
        after = bisect_right(self.line_starts, max(start, end - 1))
        last = self.line_starts[after] - 1 if after < len(self.line_starts) else len(self.text)
        return self.text[first:last].rstrip("\r\n")

    @cached_property
    def _braces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of braces, the opening brace around what follows each (-1 for none), opening braces that are closed, and where their blocks end.

        Braces of one depth are put in order of their places: there each block's two follow each other.
        """
        at = self._places("{}")
        opens = np.array([self.text[i] == "{" for i in at.tolist()], bool)
        run = np.cumsum(np.where(opens, 1, -1))
        depth = run - np.minimum.accumulate(np.minimum(run, 0))  # closing braces that close nothing don't count
        order = np.argsort(depth, kind="stable")
        last = np.maximum.accumulate(np.where(opens[order], np.arange(len(at)), 0)) if len(at) else order
        around = np.empty(len(at), np.int64)
        around[order] = at[order[last]] if len(at) else -1
        around[depth == 0] = -1
        before = np.concatenate(([0], depth[:-1])) if len(at) else depth
        real = np.flatnonzero(opens | (before > 0))
        level = np.maximum(depth, before)[real]
        pairs = real[np.argsort(level, kind="stable")]
        first = np.flatnonzero(opens[pairs[:-1]] & ~opens[pairs[1:]])
        return at, around, at[pairs[first]], at[pairs[first + 1]] + 1

    @cached_property
    def _blocks(self) -> tuple[list[int], list[int], dict[int, int]]:
        """The same for looks at single places; where each opening one's block ends is a table."""
        at, around, opening, end = self._braces
        return at.tolist(), around.tolist(), dict(zip(opening.tolist(), end.tolist(), strict=True))

    def opening(self, at: int) -> int:
        """The place of the brace that opens the innermost block around a place, -1 if there is none."""
        places, around, _ = self._blocks
        i = bisect_left(places, at) - 1
        return around[i] if i >= 0 else -1

    def openings(self, at: np.ndarray) -> np.ndarray:
        """:meth:`opening` of each."""
        places, around, _, _ = self._braces
        i = np.searchsorted(places, at) - 1
        return np.where(i >= 0, around[i], -1) if len(places) else np.full(len(at), -1)

    def met(self, literal: str) -> np.ndarray:
        """Where a literal is in the text, overlapping ones too."""
        if literal not in self._met:
            found, i = [], self.text.find(literal)
            while i >= 0:
                found.append(i)
                i = self.text.find(literal, i + 1)
            self._met[literal] = np.array(found, np.int64)
        return self._met[literal]

    def blocks_matched(self, at: np.ndarray, expression, timeout, literals: tuple[str, ...] = (), known: np.ndarray | None = None) -> np.ndarray:
        """:meth:`block_matches` of each. What blocks hold a literal is told for all at once.

        ``known``: what a plain expression (of which literals are known) finds in the text, apart from each other and in order. A block that
        has one of these before its end isn't searched.
        """
        opening, back = np.unique(self.openings(at), return_inverse=True)
        look = opening >= 0
        found = np.zeros(len(opening), bool)
        if literals:
            opened, ends = self._braces[2:]
            end = np.full(len(opening), len(self.text))
            if len(opened):
                sort = np.argsort(opened)
                i = np.minimum(np.searchsorted(opened, opening, sorter=sort), len(opened) - 1)
                end = np.where(opened[sort[i]] == opening, ends[sort[i]], end)
            first = self.starts[np.searchsorted(self.starts, np.maximum(opening, 0), "right") - 1]

            def holds(starts: np.ndarray, after: np.ndarray) -> np.ndarray:
                """Blocks that have one of some spans in them: the first that starts no earlier ends no later."""
                i = np.searchsorted(starts, first)
                return (i < len(starts)) & (after[np.minimum(i, len(starts) - 1)] <= end) if len(starts) else np.zeros(len(first), bool)

            look &= np.logical_or.reduce([holds(met, met + len(x)) for x in literals for met in (self.met(x),)])
            if known is not None:
                found = look & holds(known[:, 0], known[:, 1] + 1)
                look &= ~found
        for i in np.flatnonzero(look).tolist():
            found[i] = self.block_found(int(opening[i]), expression, timeout)
        return found[back]

    def block_found(self, opening: int, expression, timeout) -> bool:
        """Whether a compiled expression is found in the block that a brace opens; searched once."""
        key = (opening, expression.pattern)
        if key not in self._judged:
            self._judged[key] = expression.search(self.block(opening), timeout=timeout()) is not None
        return self._judged[key]

    def block_end(self, opening: int) -> int:
        """Where the block that a brace opens is over."""
        return self._blocks[2].get(opening, len(self.text))

    def block(self, opening: int) -> str:
        """The block that a brace opens, from the start of its line; to the end of the text if nothing closes it."""
        first = self.line_starts[bisect_right(self.line_starts, opening) - 1]
        return self.text[first : self._blocks[2].get(opening, len(self.text))]

    def enclosing_block(self, at: int) -> str:
        """The ``{...}`` around a place, from the start of the line that opens it; '' if there is none.

        Braces count wherever they are, in strings and comments too.
        """
        i = self.opening(at)
        return self.block(i) if i >= 0 else ""

    def block_matches(self, at: int, expression, timeout, literals: tuple[str, ...] = ()) -> bool:
        """Whether a compiled expression is found in the block around a place. Each block is searched once, however many places are in it.

        With ``literals``, of which every match holds one, blocks without any aren't searched.
        """
        if (i := self.opening(at)) < 0:
            return False
        if literals and (i, expression.pattern) not in self._judged:
            block = self.block(i)
            if not any(x in block for x in literals):
                self._judged[i, expression.pattern] = False
        return self.block_found(i, expression, timeout)
