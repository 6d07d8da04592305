import random

import pytest

from sieveflow.llm import line_dedup as L

from .helpers import LINE, docs, empty


def brute(table):
    """(id, text) in order -> texts without lines that have an earlier neighbour within one edit."""
    seen, out = [], []

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) > len(b):
            a, b = b, a
        i = 0
        while i < len(a) and a[i] == b[i]:
            i += 1
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    for i, t in table:
        keep = []
        for line in t.split("\n"):
            if len(line) >= L.MIN_CHARS:
                hit = any(near(line, s) for s in seen)
                seen.append(line)
                if hit:
                    continue
            keep.append(line)
        out.append((i, "\n".join(keep)))
    return out


@pytest.mark.parametrize("bound", [L.BROADCAST_ROWS, 0])
def test_against_all_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "BROADCAST_ROWS", bound)
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randint(18, 26))) for _ in range(60)]

    def edited(s):
        k = rng.randrange(len(s))
        return rng.choice([s[:k] + s[k + 1 :], s[:k] + "c" + s[k:], s[:k] + "d" + s[k + 1 :], s, s[: k // 2] + "zz" + s[k:]])

    table = [(i, "\n".join(edited(rng.choice(lines)) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    got = L.line_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == brute(table)


def test_cases(spark):
    df = docs(spark, extra=True)
    out = L.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].text is None and by[3].n_lines == 0 and by[4].text == "" and by[99].text is None
    assert by[8].text.startswith(LINE) and by[9].text == "second own line of another document" and by[10].text == "third own line, with a near copy before it"
    assert by[1].text == "" and by[1].n_dropped == 1  # a copy of document 0
    assert [r.text for r in rows if r.doc_id == 0] == [by[0].text] * 2 and by[0].n_dropped == 0
    assert by[15].text == "one\r\ntwo\r\n"


def test_empty(spark):
    assert L.line_dedup(empty(spark)).collect() == []


def test_long_lines(spark):
    a = "lorem ipsum dolor " * 300
    got = L.line_dedup(spark.createDataFrame([(1, a), (2, a[:2000] + "X" + a[2000:]), (3, a[:-1] + "Y"), (4, a[:1000] + a[1003:])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_long_lines_against_all_pairs(spark):
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abcdefgh 日💡") for _ in range(n))
    lines = [made(n) for n in (63, 64, 65, 127, 128, 129, 192, 500, 1025)]

    def edited(s, k):
        return rng.choice([s[:k] + s[k + 1 :], s[:k] + "X" + s[k:], s[:k] + "Y" + s[k + 1 :]])

    table = [(0, "\n".join(lines))]
    for line in lines:
        for k in {0, 1, len(line) - 1, len(line) // 2, *(c + d for c in range(64, len(line), 64) for d in (-1, 0, 1) if c + d < len(line))}:
            table.append((len(table), edited(line, k) + "\n" + made(30) + "\n" + edited(edited(line, k), max(0, k - 9))))
    table.append((len(table), "\n".join(x + "Z" for x in lines)))
    got = L.line_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == brute(table)


def test_very_long_lines_take_little_time(spark):
    import time

    a = "".join(random.Random(1).choices("abcdefgh ", k=200_000))
    start = time.time()
    got = L.line_dedup(spark.createDataFrame([(1, a), (2, a[:150_000] + "X" + a[150_000:]), (3, a[:-1] + "Y"), (4, a[:1000] + a[1003:])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {1: 0, 2: 1, 3: 1, 4: 0}
    assert time.time() - start < 60


def test_columns_named_like_the_numbers(spark):
    from pyspark.sql import functions as F

    df = docs(spark).withColumns({c: F.lit(c) for c in ("n_lines", "N_DROPPED", "near", "first", "gid")})
    out = L.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines_", "n_dropped_"]
    assert {(r.n_lines, r.N_DROPPED) for r in out.collect()} == {("n_lines", "N_DROPPED")}
    assert out.where("n_dropped_ > 0").count() >= 3


def test_very_many_dropped_lines_of_one_text(spark):
    import time

    lines = [f"a line that comes again and again, number {i % 7}" if i % 2 else f"line {i} alone with {i * 7919 % 100003}" for i in range(40_000)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.perf_counter()
    r = L.line_dedup(df).first()
    assert time.perf_counter() - began < 300
    assert r.n_lines == 40_000 and r.n_dropped >= 19_990 and len(r.text.split("\n")) == r.n_lines - r.n_dropped
