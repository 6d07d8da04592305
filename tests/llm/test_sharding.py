import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sieveflow.llm import sharding as H
from sieveflow.llm.common import fresh_path

from .helpers import docs, empty, rows

key = lambda d: sorted(map(repr, d.collect()))


def listed(store, m=None):
    return store.listed(m or store.manifest()).collect()


def test_tiers(spark):
    sizes = [0, 1, 3, 10, 60, 62, 63, 200, 249, 250, 999, 5000]
    got = {r.b: r.t for r in spark.createDataFrame([(b,) for b in sizes], "b long").select("b", H.tier("b", 1000, 4).alias("t")).collect()}
    assert got == {b: None if b >= 250 else math.ceil(math.log(1000 / max(b, 1), 4) - 1e-9) for b in sizes}


def test_append_compact_read_vacuum(spark):
    store = H.ShardStore(spark, fresh_path(spark, "shards"), target=1 << 20)
    df = docs(spark)
    for part in df.repartition(4).randomSplit([1.0, 1.0, 1.0], 1):
        store.append(part, max_rows=3)
    before = store.manifest()
    first = listed(store, before)
    assert len(first) > 4 and sum(s.rows for s in first) == len(rows())
    after = store.compact()
    last = listed(store, after)
    assert len(last) < len(first) and sum(s.rows for s in last) == len(rows())
    assert key(store.read()) == key(df) == key(store.read(before.version))
    assert store.compact() == after  # nothing left to do
    assert store.vacuum() == len({s.path for s in first} - {s.path for s in last})
    assert key(store.read()) == key(df)
    assert store.vacuum() == 0


def test_merged_shards_stay_below_the_target(spark):
    target = 40_000
    store = H.ShardStore(spark, fresh_path(spark, "shards"), target=target)
    df = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    for k in range(5):
        store.append(df.where(F.col("id") % 5 == k).repartition(6), max_rows=40)
    first = listed(store)
    store.compact()
    last = listed(store)
    # Files of a tier are laid together up to the target, so all but a few are within its range.
    assert len(first) > 80 and max(s.bytes for s in last) <= target * 1.1
    assert sum(s.bytes < target / H.RATIO for s in last) <= math.ceil(math.log(target, H.RATIO))
    assert key(store.read()) == key(df)


def test_jobs_are_bounded_and_lists_are_joined(spark, monkeypatch):
    monkeypatch.setattr(H, "FILES_A_JOB", 3)
    monkeypatch.setattr(H, "LISTS", 2)
    store = H.ShardStore(spark, fresh_path(spark, "shards"), target=1 << 20)
    df = docs(spark)
    for part in df.repartition(2).randomSplit([1.0] * 4, 1):
        store.append(part, max_rows=2)
        assert len(store.manifest().lists) <= 3
    store.compact()
    assert key(store.read()) == key(df)


def test_of_two_writers_one_wins(spark):
    root = fresh_path(spark, "shards")
    a, b = H.ShardStore(spark, root), H.ShardStore(spark, root)
    a.append(docs(spark).limit(2))
    seen = b.manifest()
    assert not b._publish(H.Manifest(seen.version, seen.schema, ()))  # that version exists
    assert a.manifest() == seen
    b.append(docs(spark).limit(3))  # starts again from the newest
    assert sum(s.rows for s in listed(a)) == 5
    gone = a._write_list(spark.createDataFrame([("data/x/gone.parquet", 1, 1)], H.SHARD))
    with pytest.raises(H.Conflict):
        a.commit(gone, gone)


def test_columns_may_be_added_but_not_change(spark):
    store = H.ShardStore(spark, fresh_path(spark, "shards"))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 5)], "doc_id long, text string, n int"))
    assert sorted((r.doc_id, r.n) for r in store.read().collect()) == [(1, None), (2, 5)]
    store.compact()
    assert sorted((r.doc_id, r.n) for r in store.read().collect()) == [(1, None), (2, 5)]
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))


def test_documents(spark):
    """Every row with the digest of its text, in a shard that holds as many rows as it says."""
    path = fresh_path(spark, "in")
    docs(spark, extra=True).repartition(5).write.parquet(path)
    root = fresh_path(spark, "shards")
    got = H.shard_documents(spark, path, root).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(r[0]), digest(r[1])) for r in rows())
    store = H.ShardStore(spark, root)
    for s in store.shards().collect():
        own = spark.read.parquet(f"{root}/{s.path}").collect()
        assert sorted((str(r.doc_id), digest(r.text)) for r in own) == sorted((str(r.doc_id), r.text_sha256) for r in got if r.shard == s.shard)
        assert {(r.shard_rows, r.shard_bytes, r.version) for r in got if r.shard == s.shard} == {(len(own), s.shard_bytes, store.manifest().version)}
    none = fresh_path(spark, "in")
    empty(spark).write.parquet(none)
    assert H.shard_documents(spark, none, fresh_path(spark, "shards")).collect() == []


def test_the_query_merges_what_arrives(spark, sf):
    """A table of one file comes in several arrivals, whose shards are merged tier by tier."""
    from sieveflow.llm import queries as Q

    got = Q.op6_sharding(spark, sf).select("doc_id", "shard", "version", "merges", "rows_merged").collect()
    source = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(source.inputFiles()) == 1 and sorted(r.doc_id for r in got) == sorted(r.doc_id for r in source.collect())
    first = got[0]
    assert first.merges > 1 and first.version >= 4 + first.merges and first.rows_merged >= 0.5 * len(got)
    assert len({r.shard for r in got}) < 8


def test_arrivals_deal_each_row_once(spark):
    path = fresh_path(spark, "in")
    spark.range(1000).coalesce(2).write.parquet(path)
    table = spark.read.parquet(path)
    for n in (1, 2, 3, 8):
        parts = [sorted(r.id for r in p.collect()) for p in H.arrivals_of(table, n)]
        assert len(parts) == n and sorted(sum(parts, [])) == list(range(1000))


def test_an_empty_table_keeps_its_types(spark):
    path = fresh_path(spark, "in")
    spark.createDataFrame([], "doc_id string, text string").write.parquet(path)
    got = H.shard_documents(spark, path, fresh_path(spark, "shards"))
    assert got.schema["doc_id"].dataType.simpleString() == "string" and got.collect() == []


def test_sessions_with_small_scans_end(spark, monkeypatch):
    from contextlib import contextmanager

    @contextmanager
    def held(self):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        try:
            yield
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    monkeypatch.setattr(H.ShardStore, "_packed", held)
    store = H.ShardStore(spark, fresh_path(spark, "shards"), target=1 << 20)
    for part in docs(spark).repartition(4).randomSplit([1.0, 1.0], 1):
        store.append(part, max_rows=2)
    store.compact()
    assert store._next_run(store.manifest()) is None and key(store.read()) == key(docs(spark))
