import zlib

import numpy as np

from sieveflow.llm import quality as Q

from .helpers import docs, empty, rows

LABELS = "doc_id long, quality int, toxic int"


def test_trees_walk_as_written():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    t = Q.fit(x, y, trees=20, depth=3)

    def walk(row):
        z = t.base
        for f, thr, leaf in zip(t.feature, t.threshold, t.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > thr[at])
            z += leaf[at - len(f)]
        return 1 / (1 + np.exp(-z))

    s = t.score(x)
    assert np.allclose(s, [walk(r) for r in x])
    assert ((s > 0.5) == (y == 1)).mean() > 0.97


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in Q.classify(d, labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    right = np.mean([got[r.doc_id].predicted == r.quality for r in held])
    assert right >= 0.95 and right > np.mean([r.quality for r in held]) + 0.05


def test_cases(spark):
    df = docs(spark, extra=True)
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (6, 0, 0), (4, None, 0), (None, 1, 0), (500, 0, 0), (7, 0, 1), (8, 1, 0)], LABELS)
    got = Q.classify(df, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    none = Q.classify(df, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.classify(empty(spark), labels).collect() == []
    one = Q.classify(df, spark.createDataFrame([(0, 1, 0), (8, 1, 0)], LABELS)).collect()
    assert all(r.score > 0.5 for r in one)


def test_sample_is_bounded_and_ignores_held_out_rows(spark):
    df = docs(spark).where("doc_id is not null")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(18)], LABELS)
    ids = {r.doc_id for r in Q.labelled_sample(df, labels).collect()}
    assert ids == {i for i in range(18) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert Q.labelled_sample(df, labels, sample=4).count() == 4


def test_accepted_keeps_columns(spark):
    df = docs(spark)
    trees = Q.train(df, spark.createDataFrame([(0, 1, 0), (8, 1, 0)], LABELS))
    out = Q.accepted(df, trees, 0.5)
    assert out.schema == df.schema and out.count() == len(rows())


def plain_statistics(text):
    """A few of the statistics, said in another way."""
    import math
    import re
    import string

    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return {n: 0.0 for n in Q.FEATURES}
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    letters = max(1, len(re.findall(rb"[A-Za-z]", raw)))
    share = lambda k, n: k / n if n else 1.0
    return {
        "n_bytes": len(raw), "n_words": len(words), "word_bytes": sum(map(len, words)) / len(words), "distinct_words": len(set(words)) / len(words),
        "top_word": max(words.count(w) for w in set(words)) / len(words), "same_as_last": sum(a == b for a, b in zip(words, words[1:])) / len(words),
        "upper": len(re.findall(rb"[A-Z]", raw)) / letters, "digits": len(re.findall(rb"[0-9]", raw)) / len(raw),
        "marks": sum(chr(c) in string.punctuation for c in raw) / len(raw), "bangs": raw.count(b"!") / len(raw), "pipes": raw.count(b"|") / len(raw),
        "no_ascii": sum(c > 127 for c in raw) / len(raw), "spaces": len(re.findall(rb"[\x20\x09-\x0D]", raw)) / len(raw), "n_lines": len(lines),
        "repeated_lines": 1 - len(set(lines)) / len(lines), "short_words": sum(len(w) <= 3 for w in words) / len(words),
        "long_words": sum(len(w) >= 12 for w in words) / len(words), "distinct_pairs": share(len(set(zip(words, words[1:]))), len(words) - 1),
        "entropy": -sum(raw.count(c) / len(raw) * math.log2(raw.count(c) / len(raw)) for c in set(raw)),
    }


def test_statistics_against_a_plain_version():
    for _, text, *_ in rows():
        got = dict(zip(Q.FEATURES, Q.statistics(text[:4000] if text else text), strict=True))
        for k, v in plain_statistics(text[:4000] if text else text).items():
            assert np.isclose(got[k], v), k


def test_the_best_split_against_all_splits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 1] + rng.standard_normal(300) > 6.5).astype(float)
    t = Q.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))
    side = lambda m: g[m].sum() ** 2 / (h[m].sum() + Q.PENALTY)
    gains = {(f, v): side(x[:, f] <= v) + side(x[:, f] > v) for f in range(4) for v in np.unique(x[:, f])[:-1]}
    (f, v), _ = max(gains.items(), key=lambda kv: kv[1])
    right = x[:, t.feature[0, 0]] > t.threshold[0, 0]
    assert t.feature[0, 0] == f and (right == (x[:, f] > v)).all()
    assert np.allclose(t.leaf[0], [-Q.RATE * g[m].sum() / (h[m].sum() + Q.PENALTY) for m in (~right, right)])


def test_texts_that_share_an_id_are_learned_from_alike_in_any_order(spark):
    table = [(1, "one text of some words"), (1, "another text! with other words"), (2, "good words"), (3, "bad bad bad")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], LABELS)
    seen = {str(sorted(map(str, Q.labelled_sample(spark.createDataFrame(t, "doc_id long, text string"), labels).collect()))) for t in (table, table[::-1])}
    assert len(seen) == 1
