"""Shared pieces of the training-data operators: words, hold-out rules, connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut, fresh_path, shared_dir

__all__ = ["SPACES", "WORDS", "connected_components", "crc_remainder", "cut", "free_name", "fresh_path", "shared_dir", "small_batches", "text_or_empty"]

#: Characters that separate words in every contract of this subpackage.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Rows and bytes of the batches that go to Python workers, where the session doesn't say otherwise.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends texts to Python in small batches: a default batch of 10,000 takes many
    times its bytes on both sides. What the session has set itself stays."""
    conf = df.sparkSession.conf
    own = conf.getAll
    for k, v in BATCHES.items():
        if k not in own:
            conf.set(k, v)
    return df


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores at its end as it takes to be none of ``taken`` (whatever their case)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def crc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: ``node``, ``component`` (its least node).

    Alternating large-star and small-star steps. Each needs one pre-aggregated minimum per node
    and one equi-join, so the neighbours of a node with very many edges are never gathered in a
    task: the minimum combines map-side, and a skewed join side can be split. The number of edges
    never grows. Every round is cut to the shared folder. Nodes without edges don't appear; null
    ends and loops are ignored. No edge gives an empty result.
    """
    u, v = F.least(a, b), F.greatest(a, b)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(v.alias("u"), u.alias("v")).distinct(), "edges")
    mark = [F.count("*"), F.expr("bit_xor(xxhash64(u, v))")]
    last = tuple(e.agg(*mark).first())
    for _ in range(max_rounds):
        if not last[0]:
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(e.agg(*mark).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
