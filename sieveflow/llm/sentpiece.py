"""SentencePiece encoding and decoding with exact N-best segmentation.

A text is a lattice of pieces over its characters, spaces written as U+2581 and one put before the
text. Forward, Viterbi scores give the best score of every prefix; backward from the end, A* extends
partial segmentations in the order of what they have plus the forward score of what is left, which is
exact, so the N best come out in order and nothing else is finished.

No piece goes across a space from its left side, across a line's end, or from a letter to punctuation,
so the lattice falls apart into chunks (a word or punctuation); a long chunk (a script without spaces, encoded
bytes) is cut further where no piece of the vocabulary that is in it goes across. What a chunk's best is, is sought
once and kept, in a bounded number of bytes. A document's N best are the N best sums of one segmentation per chunk, again by A*, where the heuristic
of the rest is its best: only the chunks with the smallest losses can take part.

Characters outside the vocabulary, and U+2581 itself in a text, are spelled in byte pieces, so that
decoding gives back every text. The vocabulary is a public file and is not trained. The file's scores
are minus the rank of each piece, as it was made for merges; read as a unigram vocabulary, a piece
weighs the log of its share by Zipf's law, so the best segmentation need not be the one that merging
would give.

Cases: a null text has null pieces; an empty text has none; repeated rows are encoded each; a null
doc_id is kept; extra columns are kept in :func:`encode` and never used, whatever their names; an
empty table gives no rows; texts are encoded whole, in chunks, and no chunk's agenda outgrows its
arcs times N. Of equal scores the search's first comes first, which is the same in every run.
"""

from __future__ import annotations

import heapq
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import small_batches

N_BEST = 3
#: Bytes of the chunks that a worker keeps, about, in each of two generations.
_KEPT_BYTES = 40 << 20
#: Characters of the longest chunk that is kept; a longer one is first cut where no piece goes across.
_LONG = 128
#: Bytes that a kept chunk takes beside its characters and ids.
_ENTRY = 150

Best = tuple[float, tuple[int, ...]]


def lattice_nbest(chunk: str, v: pieces.Vocabulary, n: int) -> list[Best]:
    """The n best (score, ids) of the segmentations of ``chunk``, spaces as U+2581 (\\x00: that character itself)."""
    size = len(chunk)
    prefixes = v.prefixes
    forward = array("d", [0.0]) + array("d", [-1e300]) * size

    def spelled(c: str) -> tuple[float, tuple[int, ...]]:
        ids = tuple([v.bytes_[b] for b in (pieces.SPACE if c == "\0" else c).encode("utf-8", "surrogatepass")])
        return v.unknown * len(ids), ids

    for i in range(size):
        at = forward[i]
        for j in range(i + 1, size + 1):
            try:
                x = prefixes[chunk[i:j]]
            except KeyError:  # no piece begins like this
                break
            if x is not None and at + x[0] > forward[j]:
                forward[j] = at + x[0]
        if prefixes.get(chunk[i]) is None and (t := at + spelled(chunk[i])[0]) > forward[i + 1]:
            forward[i + 1] = t
    found: list[Best] = []
    # (minus the score of the best completion, where it stands, a number, the score so far, what follows)
    # Among equals the one nearest to the beginning goes on, or ties in a long run would all be kept open.
    agenda: list[tuple] = [(-forward[size], size, 0, 0.0, None)]
    pushed = 0
    while agenda and len(found) < n:
        _, end, _, have, path = heapq.heappop(agenda)
        if end == 0:
            ids_: list[int] = []
            while path:
                own, path = path
                ids_ += own
            found.append((have, tuple(ids_)))
            continue
        # The pieces that end here are looked up again, so that a long chunk's arcs are never all held.
        for start in range(max(0, end - v.longest), end):
            if (x := prefixes.get(chunk[start:end])) is None:
                if start < end - 1:
                    continue
                x = spelled(chunk[start])
            s, own = x
            pushed += 1
            heapq.heappush(agenda, (-(have + s + forward[start]), start, pushed, have + s, (own, path)))
    return found


def best_and_loss(chunk: str, v: pieces.Vocabulary) -> tuple[float, tuple[int, ...], float]:
    """Score and ids of the best segmentation, and what the second best loses against it.

    The second best has an end of the best, then another piece before it, then the best of what is left:
    the smallest loss among the pieces that end where one of the best path's ends, but for these.
    """
    size = len(chunk)
    prefixes, missing = v.prefixes, _MISSING
    forward, second = [0.0] + [-1e300] * size, [-1e300] * (size + 1)
    back: list = [None] * (size + 1)
    for i in range(size):
        at = forward[i]
        get = prefixes.get
        j = i + 1
        x = get(chunk[i], missing)
        if x is missing or x is None:
            c = pieces.SPACE if chunk[i] == "\0" else chunk[i]
            spelled = tuple([v.bytes_[b] for b in c.encode("utf-8", "surrogatepass")])
            t = at + v.unknown * len(spelled)
            if t > forward[j]:
                second[j], forward[j], back[j] = forward[j], t, (i, spelled)
            elif t > second[j]:
                second[j] = t
        while x is not missing:
            if x is not None:
                t = at + x[0]
                if t > forward[j]:
                    second[j] = forward[j]
                    forward[j] = t
                    back[j] = (i, x[1])
                elif t > second[j]:
                    second[j] = t
            if j == size:
                break
            j += 1
            x = get(chunk[i:j], missing)
    parts: list[tuple[int, ...]] = []
    loss, end = 1e300, size
    while end:
        if (d := forward[end] - second[end]) < loss:
            loss = d
        end, own = back[end]
        parts.append(own)
    ids = tuple([i for own in reversed(parts) for i in own])
    return forward[size], ids, loss if loss < 1e299 else np.inf


_MISSING = object()


def cuts(v: pieces.Vocabulary) -> re.Pattern:
    """What a chunk is: spaces and a run without ASCII punctuation, or spaces, punctuation and such a run.

    No piece has another character before punctuation, but for a few (quotes and the like, found here),
    after which there is no cut.
    """
    marks = set(string.punctuation)
    joined = {p[i - 1] for p in v.ids for i in range(1, len(p)) if p[i] in marks and p[i - 1] not in marks and p[i - 1] != pieces.SPACE}
    m = re.escape(string.punctuation)
    goes_on = f"(?:(?<=[{re.escape(''.join(sorted(joined)))}])[{m}]+[^ \n{m}]*)*" if joined else ""
    return re.compile(f" *(?:[^ \n{m}]+|[{m}]+[^ \n{m}]*){goes_on}|\n| +")


#: Place among the best ids, how many of them give way, and what comes there.
Edit = tuple[int, int, tuple[int, ...]]


class Encoder:
    """Segments texts with a vocabulary; keeps the chunks that it has met in two generations."""

    def __init__(self, path: str, n: int):
        self.v, self.n = pieces.load(path), n
        if any("\n" in p for p in self.v.ids if len(p) > 1):
            raise ValueError("a piece goes across lines")
        # chunk -> loss of the second best (8 bytes) and the best's ids (4 bytes each), as one small object
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0
        self.cut = cuts(self.v)
        self.surface = [self.v.surface.get(i, b"") for i in range(max(self.v.surface) + 1)]
        self.weight = np.full(len(self.surface), self.v.unknown)
        self.weight[list(self.v.ids.values())] = [self.v.scores[p] for p in self.v.ids]

    def chunk(self, c: str) -> bytes:
        if (x := self.old.get(c)) is None:
            spaced = c.replace(pieces.SPACE, "\0").replace(" ", pieces.SPACE)
            _, ids, loss = best_and_loss(spaced, self.v)
            if not loss:  # equally good ones have an order, which the search keeps
                ids = lattice_nbest(spaced, self.v, 1)[0][1]
            x = pack(f"<d{len(ids)}i", loss, *ids)
        if len(c) > _LONG:
            return x
        self.bytes += _ENTRY + len(c) + len(x)
        if self.bytes > _KEPT_BYTES:
            self.old, self.new, self.bytes = self.new, {}, 0
        self.new[c] = x
        return x

    def apart(self, chunk: str) -> list[str]:
        """The chunk in parts of some length at least, cut where no piece goes across: their lattices make up its own."""
        spaced = chunk.replace(pieces.SPACE, "\0").replace(" ", pieces.SPACE)
        prefixes, size = self.v.prefixes, len(chunk)
        out, begin, reach = [], 0, 0
        for i in range(size):
            if i >= reach and i - begin >= _LONG // 4:
                out.append(chunk[begin:i])
                begin = i
            for j in range(i + 1, min(size, i + self.v.longest) + 1):
                try:
                    x = prefixes[spaced[i:j]]
                except KeyError:
                    break
                if x is not None and j > reach:
                    reach = j
        return [*out, chunk[begin:]]

    def encode(self, text: str) -> tuple[np.ndarray, list[tuple[float, int, tuple[Edit, ...]]]]:
        """(best ids, the n best as (score, pieces, edits of the best ids))."""
        if not text:
            return np.zeros(0, np.int32), [(0.0, 0, ())]
        chunks = self.cut.findall(" " + text)
        if max(map(len, chunks)) > _LONG:
            chunks = [p for c in chunks for p in (self.apart(c) if len(c) > _LONG else (c,))]
        got = list(map(self.new.get, chunks))
        if None in got:
            got = [x or self.new.get(c) or self.chunk(c) for x, c in zip(got, chunks, strict=True)]
        raw = np.frombuffer(b"".join(got), np.int32)
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4)
        heads = np.concatenate([[0], ends[:-1]])
        losses = np.stack([raw[heads], raw[heads + 1]], axis=1).view(np.float64).ravel()
        stay = np.ones(len(raw), bool)
        stay[heads] = stay[heads + 1] = False
        ids = raw[stay]
        # A chunk's ids without its two numbers in front.
        return ids, self.combine(chunks, float(self.weight[ids].sum()), len(ids), losses, heads - 2 * np.arange(len(heads)), ends - heads - 2)

    def combine(self, chunks: list[str], score: float, count: int, losses: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list:
        """A* over the chunks: each of the n - 1 smallest losses may be taken, nothing else can be among the n best."""
        n = self.n
        least = np.argsort(losses, kind="stable")[: n - 1].tolist()
        options = []
        for k in sorted(k for k in least if losses[k] < np.inf):
            best = lattice_nbest(chunks[k].replace(pieces.SPACE, "\0").replace(" ", pieces.SPACE), self.v, n)
            edit = (int(starts[k]), int(lengths[k]))
            options.append([(best[0][0] - s, len(p) - edit[1], (*edit, tuple(p))) for s, p in best])
        agenda: list[tuple] = [(0.0, count, (), 0)]
        out = []
        while agenda and len(out) < n:
            loss, pcs, taken, at = heapq.heappop(agenda)
            if at == len(options):
                out.append((score - loss, pcs, taken))
                continue
            for r, (more, extra, edit) in enumerate(options[at]):
                heapq.heappush(agenda, (loss + more, pcs + extra if r else pcs, (*taken, edit) if r else taken, at + 1))
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def encoder(path: str, n: int) -> Encoder:
    """One encoder for each worker process, so that chunks are kept over its tasks."""
    return Encoder(path, n)


#: Columns that :func:`encode` adds.
OUT = pa.schema([
    ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int32()), ("scores", pa.list_(pa.float64())), ("nbest_pieces", pa.list_(pa.int32())),
    ("nbest_edits", pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))), ("round_trip", pa.bool_()),
])
DDL = "ids array<int>, n_pieces int, scores array<double>, nbest_pieces array<int>, nbest_edits array<array<struct<start:int,length:int,ids:array<int>>>>, round_trip boolean"


def encode(docs: DataFrame, text_col: str = "text", n: int = N_BEST, piece_file: str = pieces.PIECE_FILE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, and ids (the best), n_pieces, scores and pieces of the n best, their edits (from the best
    ids to theirs: at ``start``, ``length`` ids give way to others; see :func:`nbest_ids`), and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(piece_file, n)
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):  # bounds what a batch holds
                ids, rows = [], []
                for t in b.column(b.num_columns - 1).to_pylist():
                    if t is None:
                        ids.append(None), rows.append((None, None, None, None, None))
                        continue
                    i, best = e.encode(t)
                    ids.append(i)
                    edits = [[dict(zip(("start", "length", "ids"), x, strict=True)) for x in b[2]] for b in best]
                    rows.append((len(i), [x[0] for x in best], [x[1] for x in best], edits, e.decode(i) == t))
                ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids], dtype=np.int64)
                values = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()), mask=pa.array([x is None for x in ids], pa.bool_())
                )
                rest = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(OUT)[1:], strict=True)] if rows else []
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, *rest], [*names, *OUT.names])

    names = [f"c{i}" for i in range(len(keep))]
    source = small_batches(docs).select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("t"))
    kinds = "".join(f"{x} {source.schema[x].dataType.simpleString()}, " for x in names)
    return source.mapInArrow(run, kinds + DDL).toDF(*keep, *OUT.names)


def nbest_ids(ids: str = "ids", edits: str = "nbest_edits") -> Column:
    """The ids of all n segmentations of :func:`encode`: the best ones with each one's edits, from the last to the first."""
    apply = "aggregate(reverse(e), {ids}, (x, d) -> concat(slice(x, 1, d.start), d.ids, slice(x, d.start + d.length + 1, greatest(size(x) - d.start - d.length, 0))))"
    return F.expr(f"transform({edits}, e -> {apply.format(ids=ids)})")


def decode(encoded: DataFrame, ids_col: str = "ids", piece_file: str = pieces.PIECE_FILE, as_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the text of ``ids_col``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(piece_file, 1)
        for b in batches:
            texts = [None if x is None else e.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*names, "t"])

    names = [f"c{i}" for i in range(len(keep))]
    source = encoded.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)], F.col(ids_col))
    kinds = "".join(f"{x} {source.schema[x].dataType.simpleString()}, " for x in names)
    return source.mapInArrow(run, kinds + "t string").toDF(*keep, as_col)

