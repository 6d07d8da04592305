import json
import random

import pytest
from tokenizers import Tokenizer

from sieveflow.llm import token_counts as T

from .helpers import DOCS, LONG, docs, empty, rows

FILE = T.default_file()
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def check(df, table, library, **options):
    got = sorted(((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(df, **options).collect()), key=repr)
    want = ((str(i), len((t or "").encode()), n := library(t), n > 512) for i, t in table)
    assert got == sorted(want, key=repr)


def test_cases(spark, library):
    table = [(r[0], r[1]) for r in rows()]
    check(docs(spark, extra=True), table, library)
    assert T.token_counts(empty(spark)).collect() == []


def test_huge_texts_by_chunks(spark, library):
    rng = random.Random(3)
    noise = "".join(rng.choice("ab \n\t'slvre\x1c\x85\xa0᠎​　é1日!") for _ in range(6000))
    texts = [
        LONG[:9000], "x" * 5000, " " * 5000, "a b " * 2000, "日本語" * 900, ("z" * 900 + " ") * 6, SPECIAL * 600, "a " + SPECIAL * 600, "\n\n  " * 900 + "q", "don't we'll " * 500,
        noise, "y" * 700, "y" * 701, "y" * 1400, "w " * 800 + "k" * 3000 + " w" * 900, None, "",
    ]
    table = [*enumerate(texts), (0, texts[0]), (50, texts[0])]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in table], DOCS)
    check(df, table, library, chunk=700)


def test_seams_widen_until_they_go(spark, library):
    # Borders only far from the first seam: 256 characters on both sides have none.
    text = "v" * 1500 + " tail" * 900 + "u" * 4000 + "."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    check(df, [(1, text)], library, chunk=2000)
    assert T.seams_of(2000, 700, {1: None, 2: 350}) == [(1400, 350)]
    assert T.seams_of(700, 700, {}) == []


def test_pieces_are_safe_places_to_cut(library):
    counter, rng = T.TokenCounter(open(FILE, encoding="utf-8").read()), random.Random(7)
    marks = [*"ab  \n\t\r\x0b'slvre,.;:!?*&%$#<|>\x1c\x1f\x85\xa0᠎​ 　éßªµ1²日", SPECIAL, "'ll", "the"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    assert counter.count(texts) == [library(t) for t in texts]
    assert counter.count(texts) == [library(t) for t in texts]  # and from what it keeps


def test_kept_pieces_are_bounded(library, monkeypatch):
    monkeypatch.setattr(T, "_KEPT", 5)
    counter = T.TokenCounter(open(FILE, encoding="utf-8").read())
    for _ in range(3):
        for t in ("one two three four five six seven", "six seven eight nine ten", "one"):
            assert counter.count([t]) == [library(t)]
    assert len(counter.kept) + len(counter.older) < 30


def test_other_files_go_whole(spark):
    """A file with a normaliser is encoded text by text, whatever the length."""
    path = FILE.replace("byte_bpe_50k", "word_bpe_49k")
    assert not T.splits_by_words(json.load(open(path, encoding="utf-8")))
    t = Tokenizer.from_file(path)
    table = [(1, "Some Words  here, " * 100), (2, None), (3, "É<|endoftext|>x")]
    got = T.token_counts(spark.createDataFrame(table, "doc_id long, text string"), path, chunk=50).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in table}
