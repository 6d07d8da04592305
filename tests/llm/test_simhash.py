import random

import xxhash

from sieveflow.llm import simhash as S

from .helpers import components, docs, empty, rows


def plain(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\x1c").split(" ")
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    parts = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_fingerprints_and_components(spark):
    got = S.simhash_components(docs(spark, extra=True)).collect()
    assert len(got) == len(rows())
    fp = {r[0]: plain(r[1]) for r in rows()}
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16 for r in got)
    ids = sorted(i for i in fp if i is not None)
    comp = components(ids, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert all(r.component_id == comp[r.doc_id] for r in got if r.doc_id is not None)
    assert next(r for r in got if r.doc_id is None).component_id == comp[0]
    assert next(r for r in got if r.doc_id == 4).fingerprint == "0" * 16


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("a é b",)], "t string").select(F.xxhash64("t")).first()[0]
    assert r % (1 << 64) == xxhash.xxh64_intdigest("a é b".encode(), 42)


def test_pairs_in_small_and_full_buckets(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:20]:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
    want = components(signed, near)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for full in (64, 2):  # nearly all buckets are full in the second
        links = S.close_pairs(df, full=full).collect()
        assert all(near(r.a, r.b) for r in links)
        pairs = {(r.a, r.b) for r in links}
        assert components(signed, lambda a, b, p=pairs: (a, b) in p or (b, a) in p) == want


def test_long_fingerprints_part_by_similarity():
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]

    def changed(k):
        out = list(base)
        for i in rng.sample(range(400), k):
            out[i] = f"other{i}"
        return out

    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    a = int.from_bytes(S.long_fingerprint(" ".join(base)))
    for k in (1, 4, 6, 60, 120):
        b = changed(k)
        similar = len(sets(base) & sets(b)) / len(sets(base) | sets(b))
        apart = (a ^ int.from_bytes(S.long_fingerprint(" ".join(b)))).bit_count()
        assert (apart <= S.LONG_APART) == (similar >= 0.8), (similar, apart)
    assert S.long_fingerprint("A b  c") == S.long_fingerprint("a b c") and S.long_fingerprint(None) == S.long_fingerprint(" \n") == bytes(64)


def near_copies(seed=5):
    """Groups of near copies, a large one among them, and unrelated texts."""
    rng = random.Random(seed)
    out = []
    for g in range(40):
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(120, 300))]
        for _ in range(60 if g == 0 else rng.randint(1, 3)):
            w = list(base)
            for i in rng.sample(range(len(w)), rng.randint(0, 2)):
                w[i] = f"x{rng.randrange(9000)}"
            out.append((len(out), " ".join(w), g))
    return out


def test_groups_of_near_copies(spark, monkeypatch):
    rows = near_copies()
    want = {i: min(j for j, _, h in rows if h == g) for i, _, g in rows}
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for hot in (S.HOT_BUCKET, 20):  # in the second the large group is dealt over several tasks
        monkeypatch.setattr(S, "HOT_BUCKET", hot)
        assert {r.doc_id: r.component_id for r in S.similar_components(df).collect()} == want


def test_bucket_links_join_what_is_near():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (12, 8), dtype=np.uint64)
    rows = np.concatenate([base[k : k + 1].repeat(n, axis=0) for k, n in enumerate((1, 30, 2, 1, 5, 1, 1, 3, 40, 1, 1, 2))])
    rows[:, 0] ^= rng.integers(0, 256, len(rows), dtype=np.uint64)  # up to eight bits
    near = lambda i, j: int(np.bitwise_count(rows[i] ^ rows[j]).sum()) <= S.LONG_APART
    for bucket in (np.zeros(len(rows), np.int64), np.arange(len(rows)) // 17):
        i, j = S.bucket_links(rows, bucket)
        assert all(near(a, b) and bucket[a] == bucket[b] for a, b in zip(i, j, strict=True))
        pairs = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        nodes = list(range(len(rows)))
        assert components(nodes, lambda a, b, p=pairs: (a, b) in p) == components(nodes, lambda a, b, k=bucket: near(a, b) and k[a] == k[b])


def test_bucket_links_join_what_is_near_a_copy_only():
    import numpy as np

    first = np.zeros(64, np.uint8)
    flipped = lambda fp, a, n: fp ^ np.packbits((np.arange(512) >= a) & (np.arange(512) < a + n))
    copies = [flipped(first, 20 * k, 50) for k in range(12)]
    rows = np.stack([first, *copies, flipped(copies[3], 400, 80), flipped(first, 300, 200)]).view(np.uint64)
    i, j = S.bucket_links(rows, np.zeros(len(rows), np.int64))
    pairs = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    comp = components(list(range(len(rows))), lambda a, b: (a, b) in pairs)
    assert comp == {k: 0 for k in range(14)} | {14: 14}


def chains(seeds):
    """Groups of more than eight copies with texts near to one of the copies at the rim; ``want`` by all pairs."""
    out, want = [], {}
    for seed in seeds:
        rng = random.Random(seed)

        def changed(words, k, rng=rng):
            words = list(words)
            for i in rng.sample(range(len(words)), k):
                words[i] = f"x{rng.randrange(10**6)}"
            return words

        base = [f"w{rng.randrange(9000)}" for _ in range(300)]
        group = [base] + [changed(base, rng.randint(1, 3)) for _ in range(12)]
        group += [changed(rng.choice(group[1:13]), rng.randint(5, 7)) for _ in range(8)]
        rng.shuffle(group)
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in group]
        at = len(out)
        alike = lambda a, b, sets=sets, at=at: len(sets[a - at] & sets[b - at]) >= 0.8 * len(sets[a - at] | sets[b - at])
        out += [(at + k, " ".join(w)) for k, w in enumerate(group)]
        want |= components(list(range(at, len(out))), alike)
    return out, want


def test_chains_met_in_a_later_block(spark):
    rows, want = chains((1, 57, 66, 74, 80, 89, 119))
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_components_are_those_of_all_similar_pairs(spark):
    rows, want = chains(range(30))
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_BUCKET", 3)
    rows, want = chains(range(40, 50))
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_texts_of_one_id_and_of_none(spark):
    words = lambda tag, n=200: [f"{tag}{i}" for i in range(n)]
    ends = lambda w, k: " ".join(w[:-k] + [f"z{i}" for i in range(k)])
    rows = []
    for g in range(12):  # one id with two texts, each with a copy of its own
        a, b = words(f"a{g}_"), words(f"b{g}_")
        rows += [(10 * g, " ".join(a)), (10 * g, " ".join(b)), (10 * g + 1, ends(a, 3)), (10 * g + 2, ends(b, 3))]
    m = words("m")  # a text without an id between two that are not similar
    rows += [(None, " ".join(m)), (501, ends(m, 18)), (502, " ".join(f"y{i}" for i in range(18)) + " " + " ".join(m[18:]))]
    got = {(r.doc_id, r.component_id) for r in S.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(10 * g + k, 10 * g) for g in range(12) for k in range(3)} | {(None, 501), (501, 501), (502, 501)}


def test_one_of_each_group_stays(spark):
    df = docs(spark)
    got = S.one_of_each_group(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(0) == 1 and 1 not in ids and ids.count(3) == 1 and 4 not in ids and None in ids


def test_empty(spark):
    assert S.simhash_components(empty(spark)).collect() == []
    assert S.similar_components(empty(spark)).collect() == []
    assert S.one_of_each_group(empty(spark)).collect() == []
