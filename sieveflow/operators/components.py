"""Weak and strong components of graphs of the whole corpus.

Weak components come from star contractions, whose rounds grow with the logarithm of the longest path. Strong
components are sought within them: a weak component of at most ``LOCAL_EDGES`` edges is walked in one task (many
of them one after another, never more at a time than that), so a chain of any number of cycles takes the rounds of
one cycle. In what is larger, a node that one node alone leads to (or that leads to one alone) is drawn into that
one, so ways of any length are halved in each round, until a task can walk the rest; then the drawn ones come out
again, round by round. What doesn't get smaller by that is split by colours: every node takes the pivot of least hash that leads to it and the
one that it leads to. Two nodes of a strong component have both in common, so all other edges go; and a node whose
two pivots are one is in that pivot's component. All pivots work at once, hashes are new in each round, and
pieces that have become small are again walked in tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut

#: Edges of a weak component that one task walks.
LOCAL_EDGES = 500_000


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes of (src, dst), directions aside."""
    e = edges.where("src is not null and dst is not null")
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    e = cut(e.where("src != dst").select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct(), "stars")
    mark = [F.count("*"), F.expr("bit_xor(xxhash64(high, low))")]
    last = tuple(e.agg(*mark).first())
    while last[0]:
        # All larger neighbours of a node go to the least node around it, then the smaller ones do.
        both = e.select(F.col("high").alias("at"), F.col("low").alias("to")).unionByName(e.select(F.col("low").alias("at"), F.col("high").alias("to")))
        least = both.groupBy("at").agg(F.min("to").alias("m")).select("at", F.least("at", "m").alias("m"))
        up = both.where("to > at").join(least, "at").select(F.col("to").alias("at"), F.col("m").alias("to")).distinct()
        least = up.groupBy("at").agg(F.min("to").alias("m"))
        down = up.join(least, "at").where("to > m").select(F.col("to").alias("high"), F.col("m").alias("low"))
        e = cut(down.unionByName(least.select(F.col("at").alias("high"), F.col("m").alias("low"))).distinct(), "stars")
        now = tuple(e.agg(*mark).first())
        if now == last:
            break
        last = now
    roots = e.select(F.col("low").alias("node"), F.col("low").alias("component"))
    return e.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots).unionByName(loops.join(e, F.col("node") == F.col("high"), "left_anti")).distinct()


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Without edges of nodes that nothing leads to or that lead nowhere, some rounds deep (more only saves time later)."""
    n = edges.count()
    for _ in range(rounds):
        if not n:
            break
        less = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        less = cut(less.select("src", "dst"), "cycles")
        now = less.count()
        edges, done, n = less, now == n, now
        if done:
            break
    return edges


def local_components(src: list, dst: list) -> dict:
    """node: the least node of its strong component, for all nodes of a list of edges (one walk in depth, without recursion)."""
    ahead: dict = {}
    for a, b in zip(src, dst, strict=True):
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    number: dict = {}
    low: dict = {}
    out: dict = {}
    held: list = []
    for root in ahead:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        held.append(root)
        work = [(root, iter(ahead[root]))]
        while work:
            at, rest = work[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    held.append(b)
                    work.append((b, iter(ahead[b])))
                    break
                if b not in out:
                    low[at] = min(low[at], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == number[at]:
                    members = []
                    while not members or members[-1] != at:
                        members.append(held.pop())
                    out.update(dict.fromkeys(members, min(members)))
    return out


def _walked(edges: DataFrame, local: int) -> DataFrame:
    """node, component of (weak, src, dst), whose weak components are walked in tasks: whole ones, as many at a time as ``local`` allows."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def walk(b: pd.DataFrame) -> pd.DataFrame:
            got = local_components(b.src.tolist(), b.dst.tolist())
            return pd.DataFrame({"node": list(got.keys()), "component": list(got.values())})

        held: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n >= local:
                every = pd.concat(held)
                last = every.weak.iloc[-1]  # may go on
                whole = every[every.weak != last]
                if len(whole):
                    yield walk(whole)
                held = [every[every.weak == last]]
                n = len(held[0])
        if held:
            yield walk(pd.concat(held))

    return edges.repartition("weak").sortWithinPartitions("weak").mapInPandas(run, f"node {kind}, component {kind}")


def _spread(edges: DataFrame, seed: int) -> DataFrame:
    """node, pivot: the node of least hash that leads to each node over (src, dst)."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    label = cut(nodes.select("node", F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("pivot")).alias("best")), "labels")
    while True:
        ahead = edges.join(label, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.min("best").alias("more"))
        new = cut(label.join(ahead, F.col("node") == F.col("to"), "left").select("node", F.least("best", "more").alias("best"), (F.col("more") < F.col("best")).alias("moved")), "labels")
        label = new.select("node", "best")
        if new.where("moved").isEmpty():
            return label.select("node", F.col("best.pivot").alias("pivot"))


def _contracted(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Edges in which nodes that one node alone leads to are drawn into it, and (node, up, dst): the drawn nodes' edges.

    Coins tell who is drawn, so that no node is drawn into one that is drawn itself, and a way is halved at any length.
    """
    heads = lambda c: F.xxhash64(c, F.lit(seed)) % 2 == 0
    one = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up")).where("n = 1")
    drawn = cut(one.where(heads("node") & ~heads("up")).select("node", "up"), "drawn")
    less = edges.join(drawn.select(F.col("node").alias("dst")), "dst", "left_anti").join(drawn, F.col("src") == F.col("node"), "left")
    outs = cut(edges.join(drawn, F.col("src") == F.col("node")).select("node", "up", "dst"), "drawn-edges")
    return cut(less.select(F.coalesce("up", "src").alias("src"), "dst").where("src != dst").distinct(), "cycles"), outs


def _drawn_out(found: DataFrame, outs: DataFrame) -> DataFrame:
    """(node, component) with the nodes that were drawn in: one is in the component that it was drawn into if it leads back there."""
    of = lambda name, at: found.select(F.col("node").alias(at), F.col("component").alias(name))
    j = outs.join(of("c_dst", "dst"), "dst", "left").join(of("c_up", "up"), "up", "left")
    back = j.where(F.coalesce("c_dst", "dst") == F.coalesce("c_up", "up")).select("node", "up", F.coalesce("c_up", "up").alias("component"))
    return cut(found.unionByName(back.select("node", "component")).unionByName(back.select(F.col("up").alias("node"), "component")).distinct(), "strong")


def _by_contraction(edges: DataFrame, local: int) -> DataFrame | None:
    """node, component (any node of it) of a graph that gets smaller by drawing nodes together, forwards and backwards; None if it doesn't."""
    turned = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    now, n = cut(edges.where("src != dst").select("src", "dst"), "cycles"), 0
    sizes, drawn = [now.count()], []
    while sizes[-1] > local and (len(sizes) < 3 or sizes[-1] < 0.9 * sizes[-3]):
        now, outs = _contracted(now, n)
        drawn.append(outs)
        now, n = turned(now), n + 1
        sizes.append(now.count())
    if sizes[-1] > 0.9 * sizes[0]:
        return None
    found = strong_components(now, local).select("node", "component")
    for outs in reversed(drawn):
        found = _drawn_out(found, outs)
    return found


def strong_components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """node, component (its least node) of the nodes on cycles: strongly connected components of two nodes or more, or with a loop."""
    every = edges.where("src is not null and dst is not null").select("src", "dst")
    rest = trimmed(cut(every.distinct(), "cycles"))
    parts: list[DataFrame] = []
    for seed in itertools.count():
        if rest.isEmpty():
            break
        weak = weak_components(rest).withColumnRenamed("component", "weak")
        sized = weak.join(rest.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")), "node").groupBy("weak").agg(F.sum("n").alias("n"))
        tagged = cut(rest.join(weak, F.col("src") == F.col("node")).select("weak", "src", "dst").join(sized, "weak"), "weak")
        parts.append(cut(_walked(tagged.where(F.col("n") <= local).select("weak", "src", "dst"), local), "strong"))
        big = cut(tagged.where(F.col("n") > local).select("src", "dst"), "cycles")
        if big.isEmpty():
            break
        short = _by_contraction(big, local)
        if short is not None:
            least = short.groupBy("component").agg(F.min("node").alias("least"))
            parts.append(cut(short.join(least, "component").select("node", F.col("least").alias("component")), "strong"))
            break
        to = _spread(big, seed)
        back = _spread(big.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seed).withColumnRenamed("pivot", "back")
        colours = cut(to.join(back, "node"), "colours")
        own = colours.where("pivot = back")
        least = own.groupBy("pivot").agg(F.min("node").alias("component"))
        parts.append(cut(own.join(least, "pivot").select("node", "component"), "strong"))
        of = lambda end: colours.where("pivot != back").select(F.col("node").alias(end), F.col("pivot").alias(f"p_{end}"), F.col("back").alias(f"b_{end}"))
        inner = big.join(of("src"), "src").join(of("dst"), "dst").where("p_src = p_dst and b_src = b_dst")
        rest = trimmed(cut(inner.select("src", "dst"), "cycles"))
    # A loop is a component wherever its node was looked for: drawing together and colours tell of two nodes or more.
    loops = every.where("src = dst").select(F.col("src").alias("node")).distinct()
    if not parts:
        return loops.select("node", F.col("node").alias("component"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    size = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    many = found.join(size, "component", "left_semi").select("node", "component")
    alone = loops.join(many, "node", "left_anti").select("node", F.col("node").alias("component"))
    return many.unionByName(alone)
