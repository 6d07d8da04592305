"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

The statistics see the text alone. The trees are grown on the driver from the statistics of a
bounded sample of labelled rows (``SAMPLE``, the ids with the least hash, so every label is as likely
and reruns agree) and flattened into arrays: a complete tree of depth d is 2^d - 1 features and
thresholds and 2^d leaf values. Scoring walks all trees of all documents of a batch at once, level by
level, with numpy indexing. All documents are scored, whole.

Cases: a null or blank text has all-zero statistics and a score like any other; without labels the
score is 0.5, and with labels of one class it is near that class; a null label is ignored, repeated
labels of a document are averaged; of several texts with one labelled id one is learned
from, the same in every run; a null doc_id is scored; other columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, small_batches

#: Bound of the sample of labelled rows that the trees learn from.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
PENALTY, LEAST_HESSIAN = 1.0, 2.0
THRESHOLD = 0.7

FEATURES = (
    "n_bytes", "n_words", "word_bytes", "distinct_words", "top_word", "same_as_last", "upper", "digits",
    "marks", "odd_marks", "bangs", "pipes", "no_ascii", "spaces", "n_lines", "line_bytes", "repeated_lines",
    "ended_lines", "marked_words", "short_words", "long_words", "distinct_pairs", "entropy", "capital_words",
)
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(rb"!\"#$%&'()*+,-./:;<=>?@[\]^_`{|}~")] = True
_ODD = np.zeros(256, bool)
_ODD[list(b"#$%&*+<=>@[]^_`{}~\\")] = True


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(raw), len(words)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(by[_UPPER].sum() + by[_LOWER].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    p = by[by > 0] / n
    ends = np.frombuffer(bytes(map(_last, words)), np.uint8)
    heads = np.frombuffer(bytes(map(_first, words)), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, m)
    same = sum(map(bytes.__eq__, words, words[1:])) if m > 1 else 0
    pairs = len(set(zip(words, words[1:], strict=False))) / (m - 1) if m > 1 else 1.0
    return [
        n, m, float(sizes.mean()), len(seen) / m, max(seen.values()) / m, same / m, by[_UPPER].sum() / letters, by[_DIGIT].sum() / n,
        by[_MARK].sum() / n, by[_ODD].sum() / n, by[33] / n, by[124] / n, by[128:].sum() / n, (by[32] + by[9:14].sum()) / n,
        len(lines), float(np.mean([len(x) for x in lines])), 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1] in b".!?:;\"'" for x in lines) / len(lines), _MARK[ends].mean(), (sizes <= 3).mean(), (sizes >= 12).mean(),
        pairs, float(-(p * np.log2(p)).sum()), _UPPER[heads].mean(),
    ]


def _last(w: bytes) -> int:
    return w[-1]


def _first(w: bytes) -> int:
    return w[0]


@dataclass(frozen=True)
class Trees:
    """base; feature and threshold (trees, 2^d - 1); leaf (trees, 2^d). A row goes right above a threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.leaf):
            return np.full(len(x), _sigmoid(self.base))
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return _sigmoid(self.base + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH, bins=BINS, rate=RATE) -> Trees:
    """Boosted trees on the logistic loss; splits are sought on quantile histograms."""
    inner, leaves = 2**depth - 1, 2**depth
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return empty
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Trees(base, empty.feature, empty.threshold, empty.leaf)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    z = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        p = _sigmoid(z)
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feat, thr, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins + 1)
        for d in range(depth):
            first, n = 2**d - 1, 2**d
            best = np.full(n, 1e-6)
            for f, b in enumerate(binned):
                slot = (at - first) * bins + b
                hg = np.bincount(slot, g, n * bins).reshape(n, bins).cumsum(axis=1)
                hh = np.bincount(slot, h, n * bins).reshape(n, bins).cumsum(axis=1)
                gl, hl, gt, ht = hg[:, :-1], hh[:, :-1], hg[:, -1:], hh[:, -1:]
                gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
                gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
                gain[:, len(edges[f]):] = 0
                k = gain.argmax(axis=1)
                better = (top := gain[np.arange(n), k]) > best
                best[better] = top[better]
                where = first + np.flatnonzero(better)
                feat[where], cut[where], thr[where] = f, k[better], edges[f][k[better]]
            at = 2 * at + 1 + (binned[feat[at], np.arange(len(y))] > cut[at])
        at -= inner
        value = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + PENALTY)
        z += value[at]
        feature.append(feat), threshold.append(thr), leaf.append(value)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """quality and statistics (array<double>) of at most ``sample`` labelled documents outside the held-out remainder."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", 4) != 2))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array([statistics(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), stats], ["doc_id", "quality", "stats"])

    # Broadcast: ``sample`` ids at most.
    found = small_batches(docs).select("doc_id", F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = found.select("doc_id", "quality", "text").mapInArrow(run, f"doc_id {kind}, quality double, stats array<double>")
    # Of different texts with one id the one of the least statistics stands for it, in every run.
    return stats.groupBy("doc_id").agg(F.min("stats").alias("stats"), F.first("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Trees:
    rows = labelled_sample(docs, labels, sample, text_col).orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = rows["stats"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x, (rows["quality"].to_numpy() >= 0.5).astype(float))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), as_col: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score. The trees (some 10 kB) travel with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(b.num_columns - 1)], float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(trees.score(x), pa.float64())], [*names, "s"])

    names = [f"c{i}" for i in range(len(keep))]
    source = small_batches(docs).select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("t"))
    kinds = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    return source.mapInArrow(run, f"{kinds}, s double").toDF(*keep, as_col)


def accepted(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at)], float).reshape(b.num_rows, -1)
            yield b.filter(pa.array(trees.score(x) >= threshold))

    at = docs.columns.index(text_col)
    return small_batches(docs).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, sample))
    return scored.select(
        "doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
