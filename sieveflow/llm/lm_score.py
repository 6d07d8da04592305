"""LM scoring by the likelihood of a subword lattice.

A word is a lattice: every way to cut it into pieces of an existing unigram vocabulary is a path, and
the forward recursion in log space sums all of them, so the result is the marginal probability and
not that of one segmentation. The vocabulary and its scores are never changed; the public files with
pieces that are here are made for merges and rank their pieces, so a piece's score is that of its rank by
Zipf's law, log(1 / (rank + 10)), normalised (see :mod:`pieces`). ``lattice_score`` is the document's
log10 probability under these pieces alone.

What is learned from the training documents are further arcs over whole words: a word with count c in N
training tokens has one of weight (c - D) / N, and the mass that the discount D frees, D * V / N, enters
the pieces (absolute discounting; D from the numbers of words seen once and twice). ``score`` is the
log10 probability of this lattice. The document's end is a token like a word (the pieces alone don't
spell it). A document's probability is the product over its words, whose lattices meet only at spaces,
so its scores are sums of their log10s.

Counts are of all documents. Each distinct word's lattice is run once. The ``HEAVY`` most frequent
words (a fixed bound) are broadcast and scored where the document is; the other words of a document
are joined to the table of words, so no hot word is ever shuffled.

Cases: a null or blank text is the end alone; repeated rows and ids are scored row by row; a null
doc_id counts as the empty text in the hold-out rule; without training rows N is 0 and the pieces
have all the mass; other columns are ignored; an empty table gives no rows; texts are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import crc_remainder, cut, small_batches

#: Words that are broadcast with their scores: some megabytes, whatever the corpus.
HEAVY = 100_000
#: Distinct words that a task counts before it passes them on.
_FLUSH = 200_000
END = b"\n"  # no word holds white space


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def log_marginal(word: str, weights: dict[str, float | None], byte: float) -> float:
    """ln of the summed weight of all segmentations of a space and ``word`` (forward recursion).

    ``weights`` holds every prefix of a piece too, with None, so that a search ends where no piece goes on.
    """
    s = pieces.SPACE + word
    n = len(s)
    alpha = [-math.inf] * (n + 1)
    alpha[0] = 0.0
    log1p, exp = math.log1p, math.exp
    for i in range(n):
        a = alpha[i]
        # Any character can be spelled in bytes, so each position is reached.
        x = a + byte * (1 if s[i] < "\x80" else len(s[i].encode("utf-8", "surrogatepass")))
        b = alpha[i + 1]
        alpha[i + 1] = x + log1p(exp(b - x)) if x > b else b + log1p(exp(x - b))
        for j in range(i + 1, n + 1):
            try:
                w = weights[s[i:j]]
            except KeyError:
                break
            if w is not None:
                x, b = a + w, alpha[j]
                alpha[j] = x + log1p(exp(b - x)) if x > b else b + log1p(exp(x - b))
    return alpha[n]


def count_words(docs: DataFrame, text_col: str = "text", train_col: str = "train") -> DataFrame:
    """word (binary), c (in training rows), c_all. Tasks count first, so few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            c = [seen[1][w] for w in words]
            every = [seen[0][w] + k for w, k in zip(words, c, strict=True)]
            for x in seen:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(every, pa.int64())], ["word", "c", "c_all"])

        for b in batches:
            for t, train in zip(b.column(0), b.column(1), strict=True):
                into = seen[bool(train.as_py())]
                into.update(tokens(t.as_py()))
                into[END] += 1
                if len(seen[0]) + len(seen[1]) > _FLUSH:
                    yield out()
        yield out()

    rows = small_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.col(train_col))
    counted = rows.mapInArrow(run, "word binary, c long, c_all long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


#: Logs of the pieces' weights and of a byte's.
Weights = tuple[dict[str, float], float]


def with_prefixes(weights: dict[str, float]) -> dict[str, float | None]:
    return {p[:i]: None for p in weights for i in range(1, len(p))} | weights


def with_lattice(words: DataFrame, weights: Weights) -> DataFrame:
    """``words`` (word, c, c_all) with lattice, the ln of its marginal; the end has no pieces."""
    sent = words.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, byte = sent.value
        w = with_prefixes(logs)
        for b in batches:
            ln = [None if x == END else log_marginal(x.decode("utf-8", "surrogatepass"), w, byte) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ln, pa.float64())], ["word", "c", "c_all", "lattice"])

    return words.mapInArrow(run, "word binary, c long, c_all long, lattice double")


def word_scores(docs: DataFrame, text_col: str = "text", train_col: str = "train", piece_file: str = pieces.PIECE_FILE) -> DataFrame:
    """word, known, base, score, lattice (log10 of a token), c, c_all, train_tokens: a row for each word of any document."""
    words = cut(with_lattice(count_words(docs, text_col, train_col), pieces.log_weights(piece_file)), "words")
    # Token and type counts: one row.
    n, v, n1, n2 = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))
    ).first()
    discount = n1 / (n1 + 2 * n2) if n1 else 0.5
    freed = discount * v / n if n else 1.0
    base = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    # In logs throughout: a long word's lattice is far below what a double holds.
    a = F.when(F.col("c") > 0, F.log((F.col("c") - F.lit(discount)) / F.lit(float(max(n, 1)))))
    b = F.coalesce(F.col("lattice"), F.when(F.col("c") == 0, F.lit(0.0))) + F.lit(math.log(freed))
    both = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    ln = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
    return words.select("word", (F.col("c") > 0).alias("known"), base.alias("base"), (ln / math.log(10)).alias("score"),
                        (F.coalesce("lattice", F.lit(0.0)) / math.log(10)).alias("lattice"), "c", "c_all", F.lit(n).cast("long").alias("train_tokens"))


#: Sums over a document's tokens, by their columns in the table of words.
SUMS = {"known": "n_known", "base": "base_score", "score": "score", "lattice": "lattice_score"}


def score_documents(docs: DataFrame, table: DataFrame, text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score, lattice_score of each row of ``docs`` (doc_id, text, train)."""
    spark = docs.sparkSession
    table = table.withColumn("known", F.col("known").cast("double"))
    top = table.orderBy(F.desc("c_all"), "word").limit(heavy).select("word", *SUMS).toArrow().to_pydict()
    known = spark.sparkContext.broadcast({bytes(w): x for w, *x in zip(*top.values(), strict=True)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "word", "times", "n_tokens", *SUMS, "doc_id", "train"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.float64()] * len(SUMS), None, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, row = known.value, TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, text, train in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ws = tokens(text)
                found = Counter(ws)
                found[END] = 1
                n = base = score = lattice = 0.0
                for w, times in found.items():
                    if (x := scores.get(w)) is None:
                        cols[0].append(row), cols[1].append(w), cols[2].append(times)
                        for c in cols[3:]:
                            c.append(None)
                    else:
                        n += times * x[0]
                        base += times * x[1]
                        score += times * x[2]
                        lattice += times * x[3]
                for c, x in zip(cols, (row, None, None, len(ws) + 1, n, base, score, lattice, doc_id, train), strict=True):
                    c.append(x)
                row += 1
            kinds = [b.column(0).type if t is None else t for t in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text"), "train")
    sums = ", ".join(f"{c} double" for c in SUMS)
    parts = cut(rows.mapInArrow(run, f"row long, word binary, times long, n_tokens long, {sums}, doc_id {kind}, train boolean"), "parts")
    rest = parts.where(F.col("word").isNotNull()).select("row", "word", "times").join(table.select("word", *SUMS), "word")
    rest = rest.groupBy("row").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"more_{c}") for c in SUMS])
    whole = parts.where(F.col("word").isNull()).drop("word", "times").join(rest, "row", "left")
    plus = {new: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c, new in SUMS.items()}
    return whole.select("doc_id", "train", "n_tokens", *[(x.cast("long") if c == "n_known" else x).alias(c) for c, x in plus.items()])


def lm_score(docs: DataFrame, piece_file: str = pieces.PIECE_FILE, heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score."""
    d = docs.select("doc_id", "text", (crc_remainder("doc_id", 5) != 1).alias("train"))
    table = cut(word_scores(d, piece_file=piece_file), "word-scores")
    total = table.select("train_tokens").limit(1)
    n = (first := total.first()) and first[0] or 0
    scored = score_documents(d, table, heavy=heavy)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score")
