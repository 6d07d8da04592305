"""Components against brute force, in tasks and by colours."""

import random

import pytest

from sieveflow.operators import components as C
from sieveflow.operators import graph


def reached(edges, start):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    seen, todo = set(), [start]
    while todo:
        for x in ahead.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def strong(edges):
    nodes = {n for e in edges for n in e}
    far = {n: reached(edges, n) for n in nodes}
    return {n: min(m for m in far[n] if n in far[m]) for n in nodes if n in far[n]}


def weak(edges):
    both = edges + [(b, a) for a, b in edges]
    return {n: min({n, *reached(both, n)}) for e in edges for n in e}


def frame(spark, edges, kind="long"):
    return spark.createDataFrame(edges, f"src {kind}, dst {kind}")


def got(df):
    rows = [(r.node, r.component) for r in df.collect()]
    assert len({n for n, _ in rows}) == len(rows)
    return dict(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([30, 55, 90]))]
    df = frame(spark, edges + edges[:5])
    assert got(graph.strong_components(df)) == strong(edges)
    # By colours alone: no weak component is small enough for a task.
    assert got(C.strong_components(df, local=1)) == strong(edges)
    assert got(C.weak_components(df)) == weak(edges)


def test_local_walk_is_that_of_all_pairs():
    rng = random.Random(9)
    for _ in range(200):
        edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 30))]
        on_cycles = strong(edges)
        assert C.local_components(*map(list, zip(*edges))) == {n: on_cycles.get(n, n) for e in edges for n in e}


def test_a_thousand_cycles_in_a_chain_take_the_jobs_of_ten(spark):
    def chain(n):
        order = list(range(n))
        random.Random(4).shuffle(order)
        names = [f"n{k:05}" for k in order]
        pairs = [e for x in names for e in ((x + "a", x + "b"), (x + "b", x + "a"))]
        return pairs + [(a + "b", b + "a") for a, b in zip(names, names[1:])]

    def jobs(n):
        sc = spark.sparkContext
        sc.setJobGroup(f"chain-{n}", "")
        found = got(graph.strong_components(frame(spark, chain(n), "string")))
        sc.setJobGroup("", "")
        assert found == {f"n{k:05}{x}": f"n{k:05}a" for k in range(n) for x in "ab"}
        return len(sc.statusTracker().getJobIdsForGroup(f"chain-{n}"))

    few, many = jobs(10), jobs(1000)
    assert many <= 3 * few


def test_empty_nulls_and_loops(spark):
    assert got(graph.strong_components(frame(spark, []))) == {}
    assert got(graph.strong_components(frame(spark, [(1, None), (None, 2), (3, 4)]))) == {}
    assert got(graph.strong_components(frame(spark, [(1, 1), (1, 2), (2, 3)]))) == {1: 1}
    assert got(C.weak_components(frame(spark, [(1, 1), (2, 3), (3, 3), (None, 4)]))) == {1: 1, 2: 2, 3: 2}


def test_loops_on_a_way_that_is_drawn_together(spark):
    way = [(k, k + 1) for k in range(1, 14)]
    assert got(C.strong_components(frame(spark, [(1, 1), *way, (14, 14)]), local=1)) == {1: 1, 14: 14}
    assert got(C.strong_components(frame(spark, [(1, 1), *way, (14, 14), (5, 4), (5, 5)]), local=1)) == {1: 1, 4: 4, 5: 4, 14: 14}


def test_many_small_components_in_one_task(spark):
    edges = [(3 * k + i, 3 * k + (i + 1) % 3) for k in range(300) for i in range(3)]
    assert got(C.strong_components(frame(spark, edges).coalesce(1), local=10)) == {n: n - n % 3 for n in range(900)}


def test_jobs_of_a_chain_too_large_for_a_task_do_not_grow_with_its_length(spark):
    def jobs(n):
        edges = [e for k in range(n) for e in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k))] + [(2 * k + 1, 2 * k + 2) for k in range(n)]
        sc = spark.sparkContext
        sc.setJobGroup(f"long-{n}", "")
        assert got(C.strong_components(frame(spark, edges), local=n)) == {k: k - k % 2 for k in range(2 * n)}
        sc.setJobGroup("", "")
        return len(sc.statusTracker().getJobIdsForGroup(f"long-{n}"))

    few, many = jobs(20), jobs(160)
    assert many <= 3 * few


@pytest.mark.parametrize("seed", range(2))
def test_drawing_together_keeps_components(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(36)})
    found = C._by_contraction(frame(spark, edges), 5)
    if found is not None:
        names = {}
        for r in found.collect():
            names.setdefault(r.component, set()).add(r.node)
        want = {}
        for node, c in strong(edges).items():
            want.setdefault(c, set()).add(node)
        assert {frozenset(x) for x in names.values() if len(x) > 1} == {frozenset(x) for x in want.values() if len(x) > 1}
