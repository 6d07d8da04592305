import numpy as np
from pyspark.sql import functions as F

from sieveflow.llm import embed_dedup as E

from .helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=1, n=240, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(0, n, 6):  # groups of near copies, one of them larger than a window
        x[k + 1 : k + 3] = x[k] + rng.standard_normal((2, dim)) * 0.02
    x[100:180] = x[100] + rng.standard_normal((80, dim)) * 0.01
    x[5] = x[4]
    x[7] = x[4] * 3
    x = x.astype(np.float32)
    return [(i, v.tolist(), [1, 1, 2][i % 3] if not 100 <= i < 180 else 1) for i, v in enumerate(x)]


def brute(rows):
    v = {i: np.array(e, float) / np.linalg.norm(np.array(e, float)) for i, e, _ in rows}
    label = {i: k for i, _, k in rows}
    near = lambda a, b: label[a] == label[b] and float(v[a] @ v[b]) >= 0.98
    ids = [i for i, *_ in rows]
    return components(ids, near), {a: sum(near(a, b) for b in ids if b != a) for a in ids}


def test_links_and_components_are_those_of_all_pairs(spark):
    rows = vectors()
    comp, links = brute(rows)
    got = {r.vec_id: r for r in E.embed_dedup(spark.createDataFrame(rows, SCHEMA), window=8).collect()}
    assert len(got) == len(rows)
    assert all(r.n_links <= links[i] for i, r in got.items())  # never wrong
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values())
    assert sum(got[i].component_id == comp[i] for i in comp) >= 0.99 * len(comp)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors_link_with_nothing(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [1.0, None], 1), (7, [float("inf"), 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(3))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embed_dedup(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 2, 1, True), (9, 2, 1, False), (9, 2, 1, False), *[(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8)], (None, 0, None, True)], key=str
    )


def test_empty(spark):
    assert E.embed_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_grow_along_dense_groups():
    x = np.ones((100, 3)) / np.sqrt(3)
    i, j = E.window_links(x, np.zeros(100, np.int64), window=4)
    assert len(i) == 100 * 99 // 2
    i, j = E.window_links(x, np.arange(100) // 50, window=4)
    assert len(i) == 2 * (50 * 49 // 2)


def test_windows_grow_over_any_number_of_partitions(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 16))
    x[100:400] = x[100] + rng.standard_normal((300, 16)) * 0.01
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        cls = E.classes(spark.createDataFrame(rows, SCHEMA))
        low = {r.cls: r.low for r in cls.collect()}
        found = {tuple(sorted((low[r.a], low[r.b]))) for r in E.pass_links(cls, [0, 1], window=8).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {(i, j) for i in range(100, 400) for j in range(i + 1, 400)}
