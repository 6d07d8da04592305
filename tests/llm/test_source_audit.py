import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash

from sieveflow.llm import source_audit as S

from .helpers import DOCS, docs, empty, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(table, least):
    """The report over all kept terms of all groups."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in table:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        n[lang, source].update(terms(text))
        df[lang].update(set(terms(text)))
    out = set()
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= least]
        sources = [s for a, s in groups if a == lang]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        lists = {("pair", s): [] for s in sources} | {("term", s): [(-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]] for s in sources}
        for a, b in permutations(sources, 2):
            lists["pair", a].append((-sum(f(p[a][t], p[b][t]) for t in kept), b.encode()))
        for (part, s), found in lists.items():
            for rank, (value, item) in enumerate(sorted(found)[: None if part == "pair" else 10], 1):
                out.add((lang, s, part, item.decode(), -value, rank))
    return out


def test_slices_are_those_of_the_pattern():
    texts = ["Ab c1D", "", "é", "x", "Übung,日本 z", "END", "end", "\x7f", "a"]
    data, starts, ends, at = S.slices(pa.array(texts)[0:])
    got = [(int(i), data[a:z].tobytes().decode()) for a, z, i in zip(starts, ends, at, strict=True)]
    assert got == [(i, t) for i, x in enumerate(texts) for t in terms(x)]
    data, starts, ends, at = S.slices(pa.array(texts)[4:6])
    assert [data[a:z].tobytes().decode() for a, z in zip(starts, ends, strict=True)] == ["Übung", "日本", "z", "end"]


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    data, starts, ends, _ = S.slices(pa.array(["aa bb aa c ddd c cccc aa"]))
    at, names = S.grouped(data, starts, ends)
    assert [names[i] for i in at.tolist()] == [b"aa", b"bb", b"aa", b"c", b"ddd", b"c", b"cccc", b"aa"]
    assert len(set(names)) == len(names)


def report(df, **options):
    got = [tuple(r) for r in S.source_audit(df, **options).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_cases(spark):
    table = [(r[1], r[2], r[3]) for r in rows()]
    for least in (1, 2, 10):
        assert report(docs(spark, extra=True), least_docs=least) == brute(table, least)
    assert report(empty(spark)) == set()


def test_random_sources(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    table = []
    for i in range(400):
        s = int(rng.zipf(1.6)) % 9
        text = " ".join(rng.choice(words[s * 10 : 200 + s * 10], int(rng.integers(0, 60))))
        table.append((i, text if i % 50 else None, ["en", "de", None][i % 3], None if s == 3 else f"s{s}", 0))
    table.append((401, "nur einmal", "fr", "allein", 0))
    df = spark.createDataFrame(table, DOCS)
    assert report(df) == brute([t[1:4] for t in table], 10)


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(3 * 10**12, 9 * 10**12, 10**6), (0, 1, 1), (0, 5 * 10**14, 10**9)], "n long, total long, kept long")
    got = [r.p for r in df.select(S.share(*map(S.F.col, ("n", "total", "kept"))).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in ((3 * 10**12, 9 * 10**12, 10**6), (0, 1, 1), (0, 5 * 10**14, 10**9))]
