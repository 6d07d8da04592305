"""Mixing sources to target weights by entropy balancing.

Every document is one unit of a base measure with rate 1. Among all rates within [0, 2] that give each
source its target of words, entropy balancing takes those nearest to the base in relative entropy. They
are exponentially tilted, ``rate = least(2, exp(lambda * size))`` with one lambda a source, the
multiplier of its constraint, and lambda is where the derivative of the convex dual,
``sum(rate * size) - target``, is zero. So a source that has to grow does so by its long documents
first, and one that has to shrink gives up its long documents first: that changes the fewest documents.

Newton's method finds lambda, on the log of the sum, which is nearly linear. Each step aggregates
gradient and Hessian of all sources over their documents, map-side first; documents of one source and
size have one rate, so the steps run over the counts of (source, size). A step that leaves the bracket
of its root, which every step narrows, is replaced by the bracket's middle. Sums are of decimals, so
that reruns agree to the last bit whatever the order of adding.

The rates become whole copies by error diffusion in buckets of documents of one source: largest first,
each document takes the floor or the ceiling of its rate, whichever brings the bucket's running total
nearer to its share. Rows repeated with id, source and text are one item of the bucket; as many of them take one
copy more as bring the total nearest. A bucket holds about ``BUCKET`` documents whatever the size of the source, so a
source with a third of all rows is spread over many tasks, and a bucket misses its share by about half
of its shortest document.

Tables with a row for each source are never gathered in a task: they are ranked by range partitions
with the counts of those before, the level of the targets is found by sums over all sources, and they
meet the documents by a broadcast only up to a bound, else by a salted join.

Cases: a null text has size 0; a document of size 0 is taken once, at no cost; a null source is a source of
its own, after all others; a source without words has target 0 and takes nothing; rows repeated with
id, source and text are documents of their own, some of which may get one copy more than the others (which is
told by their number alone); an empty table gives no rows; other columns are ignored by :func:`mix` and kept by :func:`repeated`, whatever their names.
Reruns agree, as nothing is drawn at random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORDS, cut, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Newton's steps at most, those between two cuts, and the relative error at which a source is done.
NEWTON_STEPS, STEPS_A_CUT, TOLERANCE = 96, 6, 1e-8
#: Documents in a rounding bucket, about.
BUCKET = 512
#: Bound of the sources that are broadcast; beyond it documents meet them by a join with this many salts.
BROADCAST_SOURCES, SALTS = 100_000, 32


def words(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with rank, from 0, by code point and null last: each range partition counts on from those before it."""
    order = [F.col("source").isNull(), F.col("source").cast("string").cast("binary")]
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sources.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed, "ranked")
    part = F.shiftright("place", 33)
    # A row for each partition, ``parts`` at most.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    j = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return j.withColumn("rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place", "part", "start")


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``sources`` (source, size, ...) with target: shares by weight, water-filled up to ``most`` x size.

    With theta the level, a source gets least(most * size, theta * weight). Theta rises from where all
    sources are open; at each level those that would be above their most stop and the rest share what is
    left, which is Newton's method on a concave sum and ends after as many levels as matter.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = ranked(sources).withColumn("weight", weight).withColumn("cap", F.col("size") * F.lit(float(most)))
    s = cut(s.drop("rank"), "weighed")
    total = s.agg(F.sum("size")).first()[0]
    level = 0.0
    while total:
        stops = F.col("cap") <= F.lit(level) * F.col("weight")
        exact = lambda c: F.coalesce(F.sum(F.when(c[0], F.col(c[1]).cast("decimal(38,4)"))), F.lit(0)).cast("double")
        stopped, open_ = s.agg(exact((stops, "cap")), exact((~stops, "weight"))).first()  # two sums
        if not open_ or (now := (total * share - stopped) / open_) <= level:
            break
        level = now
    target = F.least("cap", F.lit(level) * F.col("weight"))
    return s.withColumn("target", F.when(F.col("size") > 0, target).otherwise(0.0)).drop("weight", "cap")


def tilted(lam: str | Column, size: str | Column, most: float = MOST) -> Column:
    """The rate of a document under its source's lambda."""
    lam, size = (F.col(c) if isinstance(c, str) else c for c in (lam, size))
    return F.least(F.lit(float(most)), F.exp(lam * size))


def _few(sources: DataFrame) -> bool:
    return sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def _with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``rows`` (source, ...) with the columns of their source's row."""
    s = sources.withColumnRenamed("source", "of")
    on = F.col("source").eqNullSafe(F.col("of"))
    if few:
        return rows.join(F.broadcast(s), on).drop("of")  # at most ``BROADCAST_SOURCES`` rows
    s = s.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("at", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(s, on & (F.col("at") == F.col("salt"))).drop("of", "at", "salt")


def lambdas(counts: DataFrame, targets: DataFrame, most: float = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """source, lam: the root for each source of ``targets`` (source, target), from ``counts`` (source, size, n)."""
    counts = counts.where("size > 0")
    few = _few(targets)
    dec = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")  # noqa: E731  exact, so the order of adding is all one
    x, n = F.col("size").cast("double"), F.col("n")
    base = counts.groupBy("source").agg(F.min(x).alias("low"), dec(x * n).alias("words"), dec(x * x * n).alias("squares"))
    s = targets.where("target > 0").select("source", "target")
    s = _with_source(s, base, few)
    ratio, mean = F.col("target") / F.col("words"), F.col("squares") / F.col("words")
    first = F.log(ratio) / mean
    full = F.lit(math.log(most)) / F.col("low")  # all documents are at their most
    s = s.select(
        "source", "target", F.when(ratio >= most * (1 - 1e-12), full).otherwise(first).alias("lam"),
        F.when(ratio < 1, F.log(ratio) / F.col("low")).otherwise(0.0).alias("lo"), F.when(ratio < 1, first).otherwise(full).alias("hi"),
        (ratio >= most * (1 - 1e-12)).alias("done"),
    )
    state = cut(s, "lambdas")
    kept = ("target", "lam", "lo", "hi", "done")
    for k in range(steps):
        rate = tilted("lam", x, most)
        on = _with_source(counts, state, few)
        grown = on.groupBy("source").agg(
            dec(rate * x * n).alias("g"), dec(F.when(rate < most, rate * x * x * n).otherwise(0.0)).alias("h"), *[F.first(c).alias(c) for c in kept]
        )
        g, t, lam = F.col("g"), F.col("target"), F.col("lam")
        lo, hi = F.when(g < t, lam).otherwise(F.col("lo")), F.when(g < t, F.col("hi")).otherwise(lam)
        # Every eighth step halves the bracket, should kinks hold Newton's up.
        step = lam - (F.log(g) - F.log(t)) * g / F.col("h") if k % 8 != 7 else F.lit(None).cast("double")
        middle = (lo + hi) / 2
        over = F.col("done") | (F.abs(g - t) <= F.lit(TOLERANCE) * t) | (middle <= lo) | (middle >= hi)
        inside = F.when((F.col("h") > 0) & (step > lo) & (step < hi), step).otherwise(middle)
        state = grown.select("source", "target", F.when(over, lam).otherwise(inside).alias("lam"), lo.alias("lo"), hi.alias("hi"), over.alias("done"))
        if k % STEPS_A_CUT == STEPS_A_CUT - 1:
            state = cut(state, "lambdas")
            if state.where("not done").isEmpty():
                break
    return state.select("source", "lam")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, text_hash, size, source_size, target, rate, copies, taken."""
    return _each(mixed_items(docs, id_col, text_col, source_col, weights, share, most))


def mixed_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """A row for each different (doc_id, source, text_hash): its columns in :func:`mix`, times (its rows), copies of each, and more (how many of them get one more)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), words(text_col).alias("size"))
    # Repeated rows are one item that is there several times.
    items = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("times")), "sizes")
    counts = cut(items.groupBy("source", "size").agg(F.sum("times").alias("n")), "counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n_docs"))
    planned = cut(source_targets(totals, weights, share, most), "targets")
    few = _few(planned)
    lam = lambdas(counts, planned, most)
    lam = lam.withColumnRenamed("source", "l")
    planned = planned.join(F.broadcast(lam) if few else lam, F.col("source").eqNullSafe(F.col("l")), "left").drop("l")
    joined = _with_source(items, cut(planned.withColumnRenamed("size", "source_size"), "sources"), few)
    joined = joined.withColumn("rate", F.when(F.col("target") > 0, tilted("lam", "size", most)).otherwise(0.0))

    # Long documents are dealt over the buckets by their hash like all others.
    slots = F.ceil(F.col("n_docs") / F.lit(float(BUCKET))).cast("long")
    joined = joined.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_hash"), slots))
    item = F.struct((-F.col("size")).alias("minus"), "doc_id", "text_hash", "times", "rate")
    of_source = ("source_size", "target")
    first = joined.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(item)).alias("items"), *[F.first(c).alias(c) for c in of_source])
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = first.select("source", *of_source, F.inline(rounded("items", kind, most)))
    return got


def _each(items: DataFrame) -> DataFrame:
    """A row for each of an item's rows: the first ``more`` of them with one copy more."""
    each = items.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    copies = F.col("copies") + (F.col("time") <= F.col("more")).cast("long")
    return each.select("doc_id", "source", "text_hash", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say."""
    items = mixed_items(docs, id_col, text_col, source_col, **options)
    items = cut(items.where("copies > 0 or more > 0").select("doc_id", "source", "text_hash", "copies", "more"), "copies").hint("shuffle_hash")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col(id_col).alias("own_id"), F.col(source_col).alias("own_source"), F.xxhash64(text_col).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_hash") == F.col("text_hash"))
    each = own.join(items, same)
    plain = each.select("row", "copies")
    if not items.where("more > 0").isEmpty():
        plain = each.where("more = 0").select("row", "copies").unionByName(_some_more(each.where("more > 0")))
    out = plain.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _some_more(rows: DataFrame) -> DataFrame:
    """row, copies: of an item's rows as many as ``more`` says get one copy more. They are counted in their partitions, so no task sees all rows of one item."""
    key = ["doc_id", "source", "text_hash"]
    placed = cut(rows.select("row", *key, "copies", "more", F.spark_partition_id().alias("part")), "repeats")
    # One row for each item and partition.
    counts = placed.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in key], F.col("part").alias("c_part"), before.alias("before"))
    on = F.col("part") == F.col("c_part")
    for c in key:
        on &= F.col(c).eqNullSafe(F.col(f"c_{c}"))
    number = F.row_number().over(W.partitionBy(*key, "part").orderBy(F.lit(1)))
    numbered = placed.withColumn("number", number).join(counts, on)
    return numbered.select("row", (F.col("copies") + (F.col("before") + F.col("number") <= F.col("more")).cast("long")).alias("copies"))


def rounded(items: str, id_type: str = "bigint", most: float = MOST) -> Column:
    """Copies of each item (minus, doc_id, text_hash, times, rate) of a bucket, sorted from the largest: error diffusion."""
    start = F.struct(
        F.lit(0.0).alias("want"), F.lit(0.0).alias("have"),
        F.array().cast(f"array<struct<doc_id:{id_type},text_hash:bigint,size:bigint,times:bigint,rate:double,copies:bigint,more:bigint>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        size, times = -x["minus"], x["times"]
        want = acc["want"] + x["rate"] * size * times
        low = F.floor(x["rate"]).cast("bigint")
        # All rows take ``low``; those that take one more bring the total to within half a document of what is wanted.
        lacking = F.when(size > 0, F.ceil((want - acc["have"] - low * size * times) / size - 0.5)).otherwise(0).cast("bigint")
        high = F.when((x["rate"] > low) & (low < int(most)), times).otherwise(0)
        more = F.greatest(F.lit(0), F.least(lacking, high)).cast("bigint")
        whole = more == times
        got = F.struct(
            x["doc_id"].alias("doc_id"), x["text_hash"].alias("text_hash"), size.alias("size"), times.alias("times"), x["rate"].alias("rate"),
            (low + whole.cast("bigint")).alias("copies"), F.when(whole, 0).otherwise(more).cast("bigint").alias("more"),
        )
        have = acc["have"] + (low * times + more) * size
        return F.struct(want.alias("want"), have.cast("double").alias("have"), F.concat(acc["out"], F.array(got)).alias("out"))

    return F.aggregate(F.col(items), start, step, lambda acc: acc["out"])
