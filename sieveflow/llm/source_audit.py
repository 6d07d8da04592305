"""Audit of how the word use of sources diverges within a language.

Texts are cut into terms (letters A-Z, lower-cased, and all bytes from 0x80 on) where they are: a lookup table over
the concatenated UTF-8 buffer of a batch marks the bytes of terms, and their borders follow from differences.
Terms are slices of that buffer; xxhash numbers group them, and all slices of a group are compared byte by
byte with its first (where they differ, the group is told apart by its bytes). A batch passes on one row for each
of its groups and terms, so what is shuffled is counts.

The terms that a language keeps are the rows of a CSR matrix (an array column of sources and shares). A source's
share p of a term is an integer of a billion parts, smoothed by two: a source that lacks the term has a share too,
the same for all terms. The divergence of two sources, the sum of f(p, q) = (p - q)^2 div (p + q) over all kept
terms, is the sum of three parts, so no dense row is ever made:

* V * f(zero, zero), as if both sources lacked all V terms;
* for each source, by how much its own terms change that: from the numbers of its terms with one share;
* for terms of both, what the former two have wrong: expanded from the matrix, diagonal by diagonal, and summed
  for each pair of sources by ``np.add.reduceat`` over sorted pair numbers.

All arithmetic is on integers: f is below 2^31 as shares are at most 1,000,000,001, and products below 2^63.

The report's own size is the number of terms of the ten ranks and of ordered pairs of sources of a language. Sources
of one language are numbered in one task, and a term's sources are one array: both hold at most a language's sources,
whose square the contract returns.

Cases: null text, lang and source count as ''; a group whose documents hold no term is there with no counts; a language
that keeps no term has values of 0 in its pairs and no terms; one source alone has no pairs; repeated rows count
each; ties are ranked by the item's bytes; doc_id is never looked at; other columns are ignored; an empty table gives
no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, text_or_empty

#: Documents of a language that a kept term is in; smoothing; parts of a share; ranks of terms.
LEAST_DOCS, SMOOTH, PARTS, RANKS = 10, 2, 1_000_000_000, 10
#: Pairs of entries that are summed at a time.
_PAIRS = 1 << 20

_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a string array without nulls, and the start, end and text number of each term."""
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, 8 * wide.offset)
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(wide) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _IS_TERM[data]
    # A term begins where a byte of it follows none, or a text begins; it ends likewise.
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    first[borders] |= inside[borders]
    last[borders - 1] |= inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _LOWER[data], starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    raw, h = data.tobytes(), xxhash.xxh3_64_intdigest
    places = list(zip(starts.tolist(), ends.tolist(), strict=True))
    _, first, at = np.unique(np.fromiter((h(raw[a:z]) for a, z in places), np.uint64, len(places)), return_index=True, return_inverse=True)
    terms = [raw[slice(*places[i])] for i in first.tolist()]
    # Every slice against the first of its number.
    length = ends - starts
    odd = length != length[first][at]
    same = np.flatnonzero(~odd)
    n = length[same]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    differ = data[np.repeat(starts[same], n) + within] != data[np.repeat(starts[first][at][same], n) + within]
    odd[same] = np.logical_or.reduceat(differ, np.cumsum(n) - n)
    if odd.any():
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(odd).tolist():
            at[i] = more.setdefault(raw[slice(*places[i])], len(terms) + len(more))
        terms += more
    return at, terms


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) of all documents; a null term for each lang and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pairs = {}
            group = np.fromiter((pairs.setdefault(p, len(pairs)) for p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), np.int64, b.num_rows)
            data, starts, ends, text = slices(b.column(0))
            at, terms = grouped(data, starts, ends)
            width = max(len(terms), 1)
            # Occurrences of a text's term, then a group's occurrences and texts.
            in_text, times = np.unique(text * width + at, return_counts=True)
            key, where = np.unique(group[in_text // width] * width + in_text % width, return_inverse=True)
            n = np.bincount(where, times, len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
            seen = np.bincount(where, minlength=len(key)) if len(key) else n
            of = [*(key // width).tolist(), *range(len(pairs))]
            names = list(pairs)
            nothing = [0] * len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[g][0] for g in of], pa.string()), pa.array([names[g][1] for g in of], pa.string()),
                 pa.array([terms[i] for i in (key % width).tolist()] + [None] * len(pairs), pa.binary()),
                 pa.array([*n.tolist(), *nothing], pa.int64()), pa.array([*seen.tolist(), *nothing], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

    rows = small_batches(docs).select(*[text_or_empty(F.col(c).cast("string")).alias(c) for c in ("text", "lang", "source")])
    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (n + SMOOTH) / (total + SMOOTH * kept)), digit by digit, so that no product is beyond a long's range."""
    below, rest, out = total + SMOOTH * kept, n + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, below), rest % below
    return out + 1


def apart(p: Column, q: Column) -> Column:
    """(p - q)^2 div (p + q)."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, p + q)


def common_parts(matrix: DataFrame) -> DataFrame:
    """lang, a, b (a < b), more: what the terms that two sources share add to their divergence.

    ``matrix`` has lang and row, an array of (source number, share, share of a term that the source lacks).
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // (p + q)

    def summed(lang: str, keys: list[np.ndarray], values: list[np.ndarray], width: int) -> pa.RecordBatch:
        k, v = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total, k = np.add.reduceat(v[order], first), k[first]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k // width), pa.array(k % width), pa.array(total)], ["lang", "a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                rows = b.column(1).filter(pa.array([x == lang for x in langs]))
                indptr = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                entry = rows.flatten()
                source, p, none = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in entry.flatten())
                width = int(source.max(initial=0)) + 1
                row = np.repeat(np.arange(len(rows)), np.diff(indptr))
                keys, values, held = [], [], 0
                # The entries of a row are in order of their sources; a diagonal pairs each with the one so many places on.
                for step in range(1, int(np.diff(indptr).max(initial=0))):
                    i = np.flatnonzero(row[step:] == row[:-step])
                    j = i + step
                    keys.append(source[i] * width + source[j])
                    values.append(f(p[i], p[j]) - f(p[i], none[j]) - f(none[i], p[j]) + f(none[i], none[j]))
                    held += len(i)
                    if held > _PAIRS:
                        yield summed(lang, keys, values, width)
                        keys, values, held = [], [], 0
                if held:
                    yield summed(lang, keys, values, width)

    found = small_batches(matrix).select("lang", "row").mapInArrow(run, "lang string, a long, b long, more long")
    return found.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def source_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = cut(count_terms(docs), "term-counts")
    # A row for each kept term: its sources in an array, at most as many as its language has.
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "n")).alias("sources"), F.sum("n").alias("all_n"), F.sum("docs").alias("docs")
    )
    kept = cut(by_term.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    languages = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total"))
    entries = kept.select("lang", "term", "all_n", F.inline("sources"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = groups.select("lang", "source", zero("total").alias("total"), zero("kept").alias("kept"), zero("lang_total").alias("lang_total"))
    none = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = cut(groups.select("*", none.alias("none"), number.alias("number")), "groups")

    with_share = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "number", "none", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("all_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    with_share = cut(with_share, "shares")
    matrix = with_share.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("number", "p", "none"))).alias("row"))
    common = common_parts(matrix.where(F.size("row") > 1))

    # Own terms: how many have a share, against the other source's share of none.
    alike = with_share.groupBy("lang", "number", "none", "p").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("number").alias("b"), F.col("none").alias("b_none"))
    own = alike.join(other, "lang").where("number != b")
    change = F.col("times") * (apart(F.col("p"), F.col("b_none")) - apart(F.col("none"), F.col("b_none")))
    own = own.groupBy("lang", F.col("number").alias("a"), "b").agg(F.sum(change).alias("more"))
    # Each part counts for both orders of a pair.
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    parts = own.select("lang", low, high, "more").unionByName(common).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    left = groups.select("lang", F.col("number").alias("a"), "source", F.col("none").alias("a_none"), "kept")
    right = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), F.col("none").alias("b_none"))
    pairs = left.join(right, "lang").where("a < b").join(parts, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("kept") * apart(F.col("a_none"), F.col("b_none")), F.lit(0).cast("long")) + F.coalesce(F.col("more"), F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", "item", value.alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = with_share.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms)
