import hashlib

from sieveflow.llm import exact_dedup as X
from sieveflow.llm.common import fresh_path

from .helpers import docs, empty, normalised_groups, rows


def test_groups_are_those_of_normalised_texts(spark):
    path = fresh_path(spark, "in")
    docs(spark, extra=True).repartition(3).write.parquet(path)
    got = X.exact_dedup(spark, path).collect()
    assert len(got) == len(rows())
    groups = normalised_groups([(r[0], r[1]) for r in rows()])
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        assert len(own) == len(ids) and {r.group_size for r in own} == {len(ids)}
        assert {r.keep_id for r in own} == {min(i for i in ids if i is not None)}
        assert sum(r.kept for r in own) == 1 and next(r for r in own if r.kept).doc_id == own[0].keep_id


def test_empty(spark):
    path = fresh_path(spark, "in")
    empty(spark).write.parquet(path)
    assert X.exact_dedup(spark, path).collect() == []


def test_state_goes_on_where_it_was(spark):
    path, state = fresh_path(spark, "in"), fresh_path(spark, "state")
    spark.createDataFrame([(5, "a  b"), (6, "c")], "doc_id long, text string").coalesce(1).write.parquet(path)
    schema = "doc_id long, text string"
    stream = lambda: X.identified(spark.readStream.schema(schema).parquet(path))
    first = {r.keeper.id: r.group_size for r in X.absorb(spark, stream(), state).collect()}
    assert first == {5: 1, 6: 1}
    spark.createDataFrame([(3, "a b"), (9, "a\tb")], schema).coalesce(1).write.mode("append").parquet(path)
    again = {r.keeper.id: r.group_size for r in X.absorb(spark, stream(), state).collect()}
    assert again == {3: 3, 6: 1}


def test_texts_that_collide_are_told_apart_by_their_bytes(spark):
    from pyspark.sql import functions as F

    path = fresh_path(spark, "in")
    texts = ["ab", "cd", "cd", "a b", "ab", "e", None, "cd", "xyz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(path)
    for bound in (0, 1000):
        got = X.exact_dedup(spark, path, bound=bound, digest=lambda t: F.length(t).cast("string")).collect()
        groups = normalised_groups(list(enumerate(texts)))
        want = sorted((i, min(ids), len(ids), i == min(ids)) for ids in groups.values() for i in ids)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_the_bound_changes_nothing(spark):
    path = fresh_path(spark, "in")
    docs(spark).write.parquet(path)
    key = lambda rs: sorted(map(str, rs))
    assert key(X.exact_dedup(spark, path, bound=0).collect()) == key(X.exact_dedup(spark, path).collect())
