"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than ``CHUNK`` characters is dealt out as overlapping chunks, so that no task encodes more
than one of them at a time. Each chunk is encoded with offsets. The library splits a text into words before
it merges bytes, and it finds words from left to right, looking ahead but never back: where a place is a
border of words both in the chunk that ends there and in the chunk that begins there, what the first counts
before it and the second from it on is what the whole text has. (The first chunk of a text is right as far
as it sees, so by induction all are.) Places within ``MARGIN`` of a chunk's ends don't count, as a word may
go on or an added token may be cut there. So a text's number is the sum of its chunks' numbers less, at each
seam, what the left chunk counts from the common border on and the right one before it.

Where a seam has no common border, its overlap is widened, ``GROWTH`` times a round up to half a chunk; a
seam that finds none then goes, and its chunks are one (a word that long is merged whole anyway). Rounds
read only the texts that are left.

Shorter texts are cut before white space that follows anything else, and between a letter and a mark, where no
word of the library's goes across whatever stands around it; each piece is what the library's splitter and
model make of it, and a worker encodes a piece once as long as it keeps its number (it keeps
so many of the last used). That holds for the byte-level splitter alone: files with another one, with a normaliser or
with added tokens that take white space are encoded text by text, without chunks.

Cases: a null text counts as empty (no bytes, no tokens); repeated rows and ids are counted row by row; a null
doc_id stays; strings of added tokens in a text are these tokens, as is the library's default; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_or_empty

#: Characters of a chunk, overlap of the first round on both sides of a seam, and how it grows.
CHUNK, OVERLAP, GROWTH = 65_536, 256, 4
#: Characters at a chunk's ends that prove nothing: more than the splitter looks ahead and any added token is long.
MARGIN = 32
#: Tokens above which a text is over the limit.
LIMIT = 512
#: Pieces that a worker keeps, and the longest of them.
_KEPT, _LONGEST = 200_000, 64
#: Characters of texts that are cut up at a time.
_AT_ONCE = 1 << 18
#: No word of the splitter goes from a letter to one of these marks, or from anything to white space (in the widest sense).
_MARKS = r",.;:!?*&%$#"
_LETTERS = " " + "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(rf"\s*[{_LETTER}]+(?=[\s{_MARKS}])|\s*\S+|\s+")
_WORD = re.compile(rf" ?[{_LETTER}]+")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splits_by_words(spec: dict) -> bool:
    """Whether the file's words are those of the plain byte-level splitter."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    added = spec.get("added_tokens") or []
    free = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word")) and len(a["content"]) < MARGIN and not re.search(rf"[\s{_MARKS}]", a["content"]) for a in added)
    return bool(plain and free and not spec.get("normalizer"))


class TokenCounter:
    """The library's tokenizer of a file's text, without truncation, padding or begin and end tokens."""

    def __init__(self, file_text: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work out
        from tokenizers import Tokenizer

        self.by_words = splits_by_words(json.loads(file_text))
        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: How the splitter writes a space and letters for the model.
        self.alphabet = {ord(c): "".join(w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in _LETTERS} if self.by_words else {}
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, piece by piece."""
        if not self.by_words:
            return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.kept) > _KEPT:  # what is still in use comes back from the older half
            self.kept, self.older = {}, self.kept
        cut_up = [_PIECE.findall(t) for t in texts]
        kept, older, new = self.kept, self.older, []
        for p in set().union(*cut_up).difference(kept):
            if p in older:
                kept[p] = older[p]
            else:
                new.append(p)
        found = self.of_pieces(new)
        once = {}
        for p, n in found.items():
            (kept if len(p) <= _LONGEST else once)[p] = n
        if once:
            return [sum(once[p] if p in once else kept[p] for p in pieces) for pieces in cut_up]
        return [sum(map(kept.__getitem__, pieces)) for pieces in cut_up]

    def of_pieces(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of each piece. A piece that is one word goes to the model at once."""
        merge, split, out, rest = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str, {}, []
        for p in pieces:
            if _WORD.fullmatch(p):
                out[p] = len(merge(p.translate(self.alphabet)))
            elif any(a in p for a in self.added):
                rest.append(p)
            else:
                out[p] = sum(len(merge(w)) for w, _ in split(p))
        out.update(zip(rest, map(len, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return out

    def borders(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """Number of tokens of a chunk, and the places where its words begin with the tokens before them."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        return len(words), [(offsets[i][0], i) for i in range(len(words)) if i == 0 or words[i] != words[i - 1]]


@lru_cache(maxsize=2)
def _counter(file_text: str) -> TokenCounter:
    return TokenCounter(file_text)


def seams_of(length: int, chunk: int, other: dict[int, int | None]) -> list[tuple[int, int]]:
    """(place, overlap) of a text's seams: those of the first round but for ``other``, where None is a seam that is gone."""
    first = ((k * chunk, other.get(k, min(OVERLAP, chunk // 2))) for k in range(1, -(-length // chunk)))
    return [(at, w) for at, w in first if w is not None]


def chunks(texts: DataFrame, chunk: int) -> DataFrame:
    """Chunks of ``texts`` (digest, text, other: array of seam and overlap), dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "k", "start", "text", "left", "left_w", "right", "right_w"]
        for b in batches:
            for digest, text, other in zip(b.column(0), b.column(1), b.column(2), strict=True):
                t = text.as_py()
                seams = seams_of(len(t), chunk, {x["seam"]: x["w"] for x in other.as_py() or ()})
                ends = [(None, 0), *seams, (None, 0)]
                for k, ((a, wa), (z, wz)) in enumerate(zip(ends, ends[1:], strict=False)):
                    start = (a or 0) - wa
                    row = (digest.as_py(), k, start, t[start : z + wz if z else len(t)], a, wa, z, wz)
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _KINDS, strict=True)], names)

    dealt = small_batches(texts).mapInArrow(run, "digest string, k long, start long, text string, left long, left_w long, right long, right_w long")
    return dealt.repartition(max(_partitions(texts), texts.sparkSession.sparkContext.defaultParallelism), "digest", "k")


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encoded(dealt: DataFrame, file_text: str) -> DataFrame:
    """For each chunk a row with its number of tokens, and one for each of its seams with the borders in the overlap."""
    sent = dealt.sparkSession.sparkContext.broadcast(file_text)  # one vocabulary file
    schema = "digest string, k long, total long, seam long, w long, is_left boolean, places map<long,long>"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.map_(pa.int64(), pa.int64())]
    names = ["digest", "k", "total", "seam", "w", "is_left", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for b in batches:
            rows = []
            for digest, k, start, text, left, left_w, right, right_w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total, places = counter.borders(text)
                rows.append((digest, k, total, None, None, None, None))
                for seam, w, is_left in ((left, left_w, False), (right, right_w, True)):
                    if seam is not None:
                        # Of the left chunk what comes after a border goes, of the right one what comes before it.
                        inside = [(start + p, n - total if is_left else -n) for p, n in places if seam - w + MARGIN <= start + p <= seam + w - MARGIN]
                        rows.append((digest, k, None, seam, w, is_left, inside))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # Copies of one text give the same rows.
    return dealt.mapInArrow(run, schema).dropDuplicates(["digest", "k", "seam"])


def spliced(rows: DataFrame) -> DataFrame:
    """digest, n_tokens, failed (array of seam and w without a common border; empty if all have one)."""
    seams = rows.where("seam IS NOT NULL").groupBy("digest", "seam", "w").agg(
        F.max_by("places", F.col("is_left").cast("int")).alias("a"), F.min_by("places", F.col("is_left").cast("int")).alias("b")
    )
    common = F.array_min(F.array_intersect(F.map_keys("a"), F.map_keys("b")))
    at = seams.withColumn("at", common).select("digest", "seam", "w", (F.col("a")[F.col("at")] + F.col("b")[F.col("at")]).alias("plus"))
    parts = rows.where("total IS NOT NULL").select("digest", F.col("total").alias("plus"), F.lit(None).cast("long").alias("seam"), F.lit(None).cast("long").alias("w"))
    parts = parts.unionByName(at.select("digest", "plus", "seam", "w"))
    lost = F.when(F.col("plus").isNull(), F.struct("seam", "w"))
    return parts.groupBy("digest").agg(F.sum("plus").alias("n_tokens"), F.collect_list(lost).alias("failed"))


def count_huge(texts: DataFrame, file_text: str, chunk: int = CHUNK) -> DataFrame:
    """digest, n_tokens of ``texts`` (digest, text), by chunks."""
    half, state, done = chunk // 2, None, None
    while True:
        rest = texts.withColumn("other", F.lit(None).cast(_OTHER)) if state is None else texts.join(state, "digest")
        found = cut(spliced(encoded(chunks(rest, chunk), file_text)), "token-chunks")
        ready = found.where(F.size("failed") == 0).select("digest", "n_tokens")
        done = ready if done is None else done.unionByName(ready)
        failed = found.where(F.size("failed") > 0).select("digest", "failed")
        if failed.isEmpty():
            return done
        # Wider, or gone where half a chunk was not enough. What other seams have by now stays.
        seam = lambda x: (x["seam"] / chunk).cast("long")
        wider = F.transform("failed", lambda x: F.struct(seam(x).alias("seam"), F.when(x["w"] < half, F.least(x["w"] * GROWTH, F.lit(half))).alias("w")))
        if state is None:
            other = wider
        else:
            failed = failed.join(state, "digest")
            other = F.concat(F.filter("other", lambda o: ~F.exists("failed", lambda x: seam(x) == o["seam"])), wider)
        state = cut(failed.select("digest", other.cast(_OTHER).alias("other")), "token-seams")


_OTHER = "array<struct<seam:bigint,w:bigint>>"


def count_short(docs: DataFrame, file_text: str) -> DataFrame:
    """``docs`` (doc_id, n_bytes, text) with n_tokens in place of text."""
    sent = docs.sparkSession.sparkContext.broadcast(file_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for b in batches:
            texts, n, size = [], [], 0
            for t in b.column(2).to_pylist():
                texts.append(t)
                size += len(t)
                if size > _AT_ONCE:
                    n += counter.count(texts)
                    texts, size = [], 0
            n += counter.count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_file: str | None = None, chunk: int = CHUNK, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text)."""
    with open(tokenizer_file or default_file(), encoding="utf-8") as f:
        file_text = f.read()
    text = text_or_empty(F.col("text").cast("string"))
    d = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    if splits_by_words(json.loads(file_text)):
        huge = F.char_length("text") > chunk
        counts = count_huge(d.where(huge).select(F.sha2("text", 256).alias("digest"), "text"), file_text, chunk)
        # A text's digest is made where its number is fetched; the texts stay where they are.
        long = d.where(huge).select("doc_id", "n_bytes", F.sha2("text", 256).alias("digest")).join(counts, "digest")
        out = count_short(d.where(~huge), file_text).unionByName(long.select("doc_id", "n_bytes", "n_tokens"))
    else:
        out = count_short(d, file_text)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
