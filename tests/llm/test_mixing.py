import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sieveflow.llm import mixing as M

from .helpers import docs, empty, rows


def targets(sizes):
    """Water-filling by brute force; sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in stopped)
        open_ = [s for s in order if s not in stopped]
        t = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in stopped}, **t}
        stopped |= over


def brute_rates(sizes, target):
    """least(2, exp(lambda * size)) with the words of the target, by bisection."""
    if not target:
        return [0.0] * len(sizes)
    rate = lambda lam: [math.exp(min(lam * x, math.log(2))) for x in sizes]
    lo, hi = -100.0, 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(r * x for r, x in zip(rate(mid), sizes, strict=True)) < target else (lo, mid)
    return rate(hi)


def check(got, want_rows):
    size, taken, target, of = defaultdict(int), defaultdict(int), {}, defaultdict(list)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        of[r.source].append(r)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size and r.source_size is not None
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
    assert len(got) == want_rows
    want = targets(dict(size))
    for s, docs_ in of.items():
        assert {r.source_size for r in docs_} == {size[s]}
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        rates = brute_rates([r.size for r in docs_], target[s])
        assert all(math.isclose(r.rate, w, rel_tol=1e-4, abs_tol=1e-6) for r, w in zip(docs_, rates, strict=True)), s
        # Each bucket ends within half a document of its share, of one that may still go either way.
        buckets = math.ceil(len(docs_) / M.BUCKET)
        assert abs(taken[s] - target[s]) <= min(buckets * max(r.size for r in docs_) / 2, 0.002 * target[s]) + 1, (s, taken[s], target[s])


def test_small_table(spark):
    df = docs(spark, extra=True)
    got = M.mix(df).collect()
    assert len(got) == len(rows())
    sizes = {(r.doc_id, r.size) for r in got}
    assert all((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) in sizes for i, t, *_ in rows())
    again = M.mix(docs(spark).repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.rate, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    single = M.mix(df.dropDuplicates(["doc_id"])).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in single:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = targets(dict(size))
    longest = {s: max(r.size for r in single if r.source == s) for s in size}
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6) and abs(taken[s] - target[s]) <= longest[s] / 2


def test_targets_are_met_with_a_hot_source(spark, monkeypatch):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"),
    )
    first = M.mix(df).collect()
    check(first, 6000)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)  # the salted join
    key = lambda r: (r.doc_id, r.rate, r.taken)
    assert sorted(map(key, M.mix(df).collect())) == sorted(map(key, first))


def test_sizes_of_all_orders(spark):
    df = spark.range(900).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.floor(F.exp((F.col("id") * 7919 % 900) / 100.0)).cast("int")).alias("text"),
        F.element_at(F.array(*[F.lit(s) for s in ("small", "a", "b", "large")]), F.when(F.col("id") < 40, 1).when(F.col("id") < 300, 2).when(F.col("id") < 500, 3).otherwise(4)).alias("source"),
    )
    check(M.mix(df).collect(), 900)


def test_empty_and_wordless(spark):
    assert M.mix(empty(spark)).collect() == []
    got = M.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x y", "b")], "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r.size, r.target) for r in got} == {1: (0, 0.0), 2: (0, 3.0), 3: (2, 3.0)}


def test_many_sources_stop_one_after_the_other(spark):
    table = [(i, "w " * 2**i, f"s{i:02d}") for i in range(12)] + [(50, "x", None), (51, "y " * 3, "日"), (52, "z " * 9, "é")]
    got = M.mix(spark.createDataFrame(table, "doc_id long, text string, source string")).collect()
    want = targets({s: len(t.split()) for _, t, s in table})
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9) for r in got) and len(got) == len(table)


def test_newton_reaches_the_dual_optimum(spark):
    sizes = [1, 1, 2, 5, 40, 300, 9000]
    counts = [(f"s{k}", x, 1) for k in range(6) for x in sizes]
    ratios = (1e-6, 0.01, 0.5, 1.0, 1.7, 2.0)
    goals = [(f"s{k}", r * sum(sizes)) for k, r in enumerate(ratios)]
    got = M.lambdas(spark.createDataFrame(counts, "source string, size long, n long"), spark.createDataFrame(goals, "source string, target double")).collect()
    for r in got:
        words = sum(math.exp(min(r.lam * x, math.log(2))) * x for x in sizes)
        assert math.isclose(words, dict(goals)[r.source], rel_tol=1e-6), r


def taken_by_source(got):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
    want = targets(dict(size))
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in size)
    return taken, target


def test_heavy_repeats_meet_their_target(spark):
    """A third of a source's rows are one row, with an id and without: as many of them as it takes get one copy more."""
    long, short = "w " * 100, "v " * 10
    table = [(1, long, "b")] * 1000 + [(10 + i, short + f"x{i}", "b") for i in range(100)] + [(2000 + i, "u " * 50, "a") for i in range(900)]
    table += [(None, "t " * 70, "c")] * 700 + [(None, "s " * 9, "c")] * 3 + [(5000 + i % 7, "r " * (i % 7), "c") for i in range(500)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(5)
    got = M.mix(df).collect()
    assert len(got) == len(table)
    taken, target = taken_by_source(got)
    assert all(abs(taken[s] - target[s]) <= 100 for s in taken), (dict(taken), target)
    assert len({r.copies for r in got if r.doc_id == 1}) == 2
    # The rows that come out are those copies.
    out = M.repeated(df).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(M.WORDS))).alias("n")).collect()
    assert {r.source: r.n for r in out} == dict(taken)
    per_row = M.repeated(df.withColumn("own", F.monotonically_increasing_id())).groupBy("doc_id", "own").count().collect()
    assert {r["count"] for r in per_row if r.doc_id == 1} <= {1, 2}


def test_repeated_documents(spark):
    df = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    copies = {r.doc_id: r.copies for r in M.mix(df).collect()}
    out = M.repeated(df)
    assert out.columns == df.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}


def test_rows_without_ids_are_taken_each_by_its_text(spark):
    table = [(None, "w " * k, "a") for k in range(1, 40)] + [(1, "v " * 500, "b")]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    copies = {r.text_hash: r.copies for r in M.mix(df).collect()}
    out = M.repeated(df.withColumn("more", F.lit(0)).withColumn("copies", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("size", F.lit(3)))
    assert out.columns == ["doc_id", "text", "source", "more", "copies", "text_hash", "size"]
    assert out.count() == sum(copies.values()) and len(set(copies.values())) > 1
