import math
import zlib
from collections import Counter

from sieveflow.llm import lm_score as L
from sieveflow.llm import pieces

from .helpers import docs, empty, rows

WEIGHTS, BYTE = pieces.log_weights()
ALL = L.with_prefixes(WEIGHTS)


def brute(word):
    """ln of the summed weight of all segmentations."""
    s = pieces.SPACE + word

    def go(i):
        if i == len(s):
            return 1.0
        out = math.exp(BYTE * len(s[i].encode())) * go(i + 1)
        return out + sum(math.exp(WEIGHTS[s[i:j]]) * go(j) for j in range(i + 1, len(s) + 1) if s[i:j] in WEIGHTS)

    return math.log(go(0))


def test_marginal_is_that_of_all_segmentations():
    for word in ("the", "ntion", "éau", "日a", "x"):
        assert math.isclose(L.log_marginal(word, ALL, BYTE), brute(word), rel_tol=1e-12)


def test_long_words_stay_in_range():
    assert math.isfinite(L.log_marginal("日x" * 4000, ALL, BYTE))


def check(spark, df, **options):
    table = [(r[0], r[1]) for r in rows()]
    got = L.lm_score(df, **options).collect()
    assert len(got) == len(table)
    words = lambda t: [*(t or "").encode().lower().split(), L.END]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t in table if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws := words(t)), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for i, t in table)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    # The model of each token, from the counts and the lattice of all segmentations.
    n1, n2 = (sum(k == m for k in c.values()) for m in (1, 2))
    d = n1 / (n1 + 2 * n2)
    marginal: dict = {w: math.exp(L.log_marginal(w.decode(), ALL, BYTE)) for _, t in table for w in words(t) if w != L.END and len(w) < 40}

    def token(w):
        return math.log10(max(c[w] - d, 0) / n * (c[w] > 0) + (0 if w == L.END else d * v / n * marginal[w]))

    by = {(r.doc_id, r.n_tokens): r for r in got}
    for i, t in table:
        if all(len(w) < 40 for w in words(t)):
            r = by[i, len(words(t))]
            assert math.isclose(r.score, sum(map(token, words(t))), rel_tol=1e-9)
            assert math.isclose(r.lattice_score, sum(math.log10(marginal[w]) for w in words(t)[:-1]), rel_tol=1e-9, abs_tol=1e-12)
    return {(r.doc_id, r.n_tokens): r.score for r in got}


def test_scores(spark):
    a = check(spark, docs(spark, extra=True))
    b = check(spark, docs(spark), heavy=3)  # nearly all words are joined instead of broadcast
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
    assert all(math.isfinite(x) and x < 0 for x in a.values())


def test_word_probabilities_sum_to_at_most_one(spark):
    table = L.word_scores(docs(spark).selectExpr("doc_id", "text", "true as train")).collect()
    assert 0.5 < sum(10**r.score for r in table) <= 1 + 1e-9


def test_empty_and_untrained(spark):
    assert L.lm_score(empty(spark)).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = L.lm_score(spark.createDataFrame([(alone, "some words")], "doc_id long, text string")).first()
    assert r.held_out and r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score)
