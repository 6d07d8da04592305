import hashlib
import random
import zlib

import numpy as np

from sieveflow.llm import periodic_runs as P

from .helpers import DOCS, docs, empty, rows


def brute(x):
    """All runs: for each period the longest stretches that have it, less those of a shorter one."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            end = i + q
            if end - start >= max(12, 2 * q) and not any(all(x[k] == x[k + r] for k in range(start, end - r)) for r in range(1, q)):
                out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_are_those_of_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        letters, x = rng.choice([1, 2, 2, 3, 5, 50]), []
        while len(x) < rng.randrange(0, 120):
            if rng.random() < 0.5 and x:
                p = rng.randrange(1, min(len(x), 30) + 1)
                x += (x[-p:] * 4)[: rng.randrange(1, p * 4 + 1)]
            else:
                x += [rng.randrange(letters) for _ in range(rng.randrange(1, 10))]
        assert P.find_runs(np.array(x, np.int64)) == brute(x)


def test_hot_words_and_long_texts_stay_fast():
    for x in ([0] * 20_000, [0, 1] * 9_000, ([0, 1] * 50 + [2]) * 60):
        found = P.find_runs(np.array(x))
        assert found[0][0] == 0 and found[0][1] >= 100
    assert len(P.find_runs(np.arange(100_000))) == 0


def query(df):
    got = P.digest(P.periodic_runs(df, P.planted, digests=True))
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in got.collect()), key=repr)


def test_cases(spark):
    table = [(r[0], r[1] and r[1][:8000]) for r in rows()]
    table += [(100 + i, f"w{i} " * i + "end") for i in range(30)]
    table += [(200 + i, " ".join(f"u{k % (i + 2)}" for k in range(60 + i))) for i in range(60)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in table], DOCS).withColumn("runs", P.F.lit(1)).withColumn("start", P.F.lit(2))
    assert query(df) == sorted((expected(i, t) for i, t in table), key=repr)
    assert query(empty(spark)) == []
    assert len(P.periodic_runs(docs(spark)).collect()) == len(rows())


def test_operator_gives_runs_and_texts(spark):
    df = spark.createDataFrame([(1, "x " + "A b c " * 5 + "é"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.periodic_runs(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 15, 3)] and got[1].collapsed == "x A b c é"
    assert got[2].runs == [] and got[2].collapsed == ""
