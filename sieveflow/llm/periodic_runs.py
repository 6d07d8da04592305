"""Periodic runs of words, by block matching.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least
``max(LEAST, 2 * q)`` that can't be extended. For each power of two B a text's aligned blocks of B words are the
keys of one automaton (``pyahocorasick``, keys are sequences of word numbers), which is run over the text. A
run of length n has n - q places that are repeated q words later. An aligned block lies wholly among them where
2 * B - 1 <= n - q, so each run is met by a block of its scale at distance q: B = 2 for a period of 6, B = 4 for
those up to 5, and else the B with 2 * B - 1 <= q <= 4 * B - 2. Each such seed is extended both ways, word by
word, to the longest stretch of that period, which is a run if it is long enough and no shorter period divides
its own. Extension is exact, so nothing else is checked, and no seed is left out but those that lie in a stretch
that is known for their distance, or in a run of a period that divides it (they would give the same stretch).

Only stretches that could hold a run are searched: a run has LEAST / 2 words in a row that come again, so words
outside every sequence of that many words which the text has twice are in none. (Sequences are told by a 64-bit
hash; equal hashes of different ones only cost time.)

A document is one task's work, in memory that is linear in its words. Cases: a null, blank or short text has no
run and its words stay; words are the bytes between white space, case counts; repeated rows and ids are worked on
row by row; a null doc_id stays; other columns are ignored; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words of the shortest run.
LEAST = 12
#: Words compared at a time by an extension; twice as many each time.
_STEP = 32
Run = tuple[int, int, int]


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, least and greatest distance) for all periods up to ``longest``."""
    yield 2, 6, 6
    yield 4, 1, 5
    block = 4
    while 2 * block - 1 <= longest:
        yield block, 2 * block - 1, min(4 * block - 2, longest)
        block *= 2


def live_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of at least LEAST words, each of whose words is in a sequence of LEAST / 2 words that comes twice."""
    k = LEAST // 2
    m = len(ids) - k + 1
    if m < 2:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + m]
    _, at, n = np.unique(h, return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[at] > 1)
    if not len(again):
        return []
    first = np.concatenate([[True], np.diff(again) > k])
    starts = again[first]
    ends = again[np.concatenate([first[1:], [True]])] + k
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b - a >= LEAST]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two sequences."""
    i, step, n = 0, _STEP, min(len(a), len(b))
    while i < n:
        j = min(i + step, n)
        differ = a[i:j] != b[i:j]
        if differ.any():
            return i + int(differ.argmax())
        i += step
        step *= 2
    return n


def extend(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch around ``at`` and ``at + d`` in which words ``d`` apart are identical: start and end."""
    right = _same(ids[at:], ids[at + d :])
    left = _same(ids[:at][::-1], ids[: at + d][::-1])
    return at - left, at + d + right


def is_smallest(ids: np.ndarray, start: int, end: int, d: int) -> bool:
    """Whether no period that divides ``d`` is one of the stretch."""
    n, p = d, 2
    factors = []
    while p * p <= n:
        if n % p == 0:
            factors.append(p)
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        factors.append(n)
    return not any(_same(ids[start:end], ids[start + d // f : end]) == end - start - d // f for f in factors)


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs (start, length, period), by start, then period."""
    import ahocorasick

    out: set[Run] = set()
    for lo, hi in live_stretches(ids):
        y = tuple(ids[lo:hi].tolist())
        n = hi - lo
        #: By distance, the end of the last stretch that was found; for each word, a run around it that reaches furthest.
        ends: dict[int, int] = {}
        reach, period = [0] * n, [0] * n
        for block, least, most in scales(n // 2):
            if n < max(LEAST, 2 * least):
                continue
            keys: dict[tuple, list[int]] = {}
            for a in range(0, n - block + 1, block):
                keys.setdefault(y[a : a + block], []).append(a)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, places in keys.items():
                automaton.add_word(key, places)
            automaton.make_automaton()
            for last, places in automaton.iter(y):
                o = last - block + 1
                if places[0] > o - least:
                    continue
                for i in range(bisect_left(places, o - most), bisect_right(places, o - least)):
                    a = places[i]
                    d = o - a
                    if ends.get(d, 0) > last or (reach[a] > last and d % period[a] == 0):
                        continue
                    start, end = extend(ids, lo + a, d)
                    ends[d] = end - lo
                    if end - start < max(LEAST, 2 * d) or not is_smallest(ids, start, end, d):
                        continue
                    out.add((start, end - start, d))
                    for j in range(start - lo, end - lo):
                        if reach[j] < end - lo:
                            reach[j], period[j] = end - lo, d
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that a run repeats."""
    if not runs:
        return words
    ends = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        ends[start + period] += 1
        ends[start + length] -= 1
    return [w for w, n in zip(words, ends.cumsum().tolist(), strict=False) if not n]


def numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document, a tenth of them made periodic from some word on by a rule on their id."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, words_of: Callable[[object, list[bytes]], list[bytes]] | None = None, digests: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period), collapsed (the words that stay, joined by a space).

    ``words_of`` makes the words that are searched from a row's id and its own words. With ``digests`` the text is
    hashed where it is and collapsed_sha256 comes in place of it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    last = "collapsed_sha256" if digests else "collapsed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, texts = [], []
            for doc_id, text in zip(b.column(0).to_pylist() if words_of else [None] * b.num_rows, b.column(1), strict=True):
                words = (text.as_py() or b"").split()
                if words_of:
                    words = words_of(doc_id, words)
                found = find_runs(numbered(words)) if len(words) >= LEAST else []
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                kept = b" ".join(collapse(words, found))
                texts.append(hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, run_kind), pa.array(texts, pa.string())], ["doc_id", "runs", last])

    rows = small_batches(docs).select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, {last} string")


def digest(found: DataFrame) -> DataFrame:
    """One row a document: its number of runs, its longest, and digests of all runs and of what stays."""
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    d = found.withColumn("best", best)
    length = -F.col("best.less")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(said, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), "collapsed_sha256",
    )
