"""SimHash near-dedup with pigeonhole blocks.

A 64-bit fingerprint is split into four blocks of 16 bits. Two fingerprints that differ in at most
two bits leave two blocks or more untouched, so they share one of the six pairs of blocks: those
pairs (32 bits each) are the join keys, and the Hamming distance of what meets is then checked.
Documents with the same fingerprint are one node from the start, so copies never make pairs.

A key with more than ``FULL_BUCKET`` different fingerprints is not joined with itself: its members
differ only in the other 32 bits, and two of them are within two bits exactly if they meet among
each other's forms with one or no bit changed. Each member emits these 33 forms, and a form that
several members share links them all to the least one. That is linear in the bucket and exact.

Cases: a null or blank text has the fingerprint zero and links like any other; fewer words than a
shingle make one shingle of the whole sequence; a null doc_id gets its fingerprint and its group's
component, and never names a component unless the group has no other id; repeated rows stay
repeated rows; other columns are ignored; an empty table gives no rows. Long texts are hashed whole,
in slices of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, small_batches

SHINGLE, SEED, BITS = 3, 42, 2
BLOCKS, BLOCK_BITS = 4, 16
FULL_BUCKET = 64
_SLICE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of ``text``, A-Z lower-cased, as an unsigned number."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    if len(ws) < shingle:
        parts, n = iter([b" ".join(ws)]), 1
    else:
        parts, n = map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False)), len(ws) - shingle + 1
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    while some := [h(p, SEED) for p in islice(parts, _SLICE)]:
        raw = np.array(some, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    source = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, fp long")


def close_pairs(fps: DataFrame, bits: int = BITS, full: int = FULL_BUCKET) -> DataFrame:
    """Edges (a, b) of different fingerprints within ``bits``; their components are those of all such pairs.

    ``fps`` has distinct fingerprints in ``fp``. Every edge is within ``bits``; in full buckets a
    chain through the least member of each shared form stands for all pairs.
    """
    if bits != 2:
        raise ValueError("the blocks are laid out for two bits")
    kept = list(combinations(range(BLOCKS), BLOCKS - bits))
    masks = [sum(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * i) for i in pair) for pair in kept]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.way", "k.part")
    sizes = keyed.groupBy("way", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(sizes, ["way", "part"]), "buckets")

    small = met.where(F.col("n") <= full)
    a = small.select("way", "part", F.col("fp").alias("a"))
    b = small.select("way", "part", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    pairs = a.join(b, ["way", "part"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    # 33 forms: as it is, or with one of the bits outside the key's blocks flipped.
    forms = None
    for i, m in enumerate(masks):
        flips = [0] + [1 << k for k in range(64) if not m >> k & 1]
        form = F.array(*[F.col("fp").bitwiseXOR(F.lit(signed(x))) for x in flips])
        form = F.when(F.col("way") == i, form)
        forms = form if forms is None else F.coalesce(forms, form)
    big = met.where(F.col("n") > full).select("way", "fp", F.explode(forms).alias("form"))
    least = big.groupBy("way", "form").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    chained = big.join(least.drop("n"), ["way", "form"]).where("fp != b").select(F.col("fp").alias("a"), "b")
    return cut(pairs.unionByName(chained).distinct(), "links")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_equal (documents with the same fingerprint)."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "fps")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_equal")), "nodes")
    links = close_pairs(nodes.select("fp"))
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "fp")
    in_group = nodes.join(groups, "fp")
    lowest = in_group.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = cut(in_group.join(lowest, "component").select("fp", "component_id"), "linked")
    named = nodes.join(linked, "fp", "left").select("fp", "n_equal", F.coalesce("component_id", "rep").alias("component_id"))
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_equal")


# Similarity of 0.8 and more: long fingerprints

#: Words of a shingle, bits of a fingerprint, bits of a block and bits that may differ. Two texts of
#: which 0.8 of all different shingles are common differ in about 78 of 512 bits.
LONG_SHINGLE, LONG_BITS, LONG_BLOCK, LONG_APART, SIMILAR = 5, 512, 16, 88, 0.8
#: Rows this near to a bucket's first are its copies: where they are many, they are thinned out.
_CLOSE = 60
#: Members of a bucket beyond which it is dealt over several tasks, its least member in each. Pairs that
#: are parted by that and not joined otherwise are left to ``rest_pairs``.
HOT_BUCKET = 20_000
#: Pairs that are compared at a time, to bound memory.
_PAIRS = 1 << 17
#: Shingles of a bucket that are grouped at a time, likewise, and buckets of shingles for each partition of a shuffle,
#: as what a task gets of the packed shingles is held in memory.
_TOKENS, _FINER = 1 << 18, 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_hashes(text: str | None, shingle: int = LONG_SHINGLE) -> np.ndarray:
    """Hashes of the different word shingles, A-Z lower-cased; the whole of a shorter text is one."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    parts = set(map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False))) or {b" ".join(ws)}
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(p, SEED) for p in parts), np.uint64, len(parts))


def long_fingerprint(text: str | None, shingle: int = LONG_SHINGLE) -> bytes:
    """SimHash of the different word shingles in eight words of 64 bits."""
    return _long_fingerprint(shingle_hashes(text, shingle))


def _long_fingerprint(base: np.ndarray) -> bytes:
    if not (n := len(base)):
        return bytes(LONG_BITS // 8)
    counts = np.zeros(LONG_BITS, np.int64)
    for at in range(0, n, 255 * 32):
        x = base[at : at + 255 * 32, None] * _ODD[None, :]  # wraps
        x ^= x >> np.uint64(29)
        x *= _ODD[3]
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1)
        for k in range(0, len(bits), 255):  # 255 rows at most add up within a byte
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n).tobytes()


def bucket_links(fp: np.ndarray, bucket: np.ndarray, apart: int = LONG_APART) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links among rows sorted by ``bucket``; fp as (rows, words) of 64 bits.

    First each row meets its bucket's first row, a few times over with what that leaves, so that a
    large group of near copies is linked to one of them and makes no pairs. What is left is compared
    with these copies, for a link to the nearest of them, and in all pairs of its bucket, by growing
    offsets. So the components are those of all near pairs of a bucket.
    """
    bits = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)
    near = lambda i, j: bits(i, j) <= apart
    left, right, rows = [], [], np.arange(len(fp))
    for _ in range(3):
        b = bucket[rows]
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(rows) else rows
        size = np.diff(np.r_[first, len(rows)])
        lead = np.repeat(rows[first], size)
        away = bits(rows, lead)
        hit = (rows != lead) & (away <= apart)
        copies = hit & (away <= _CLOSE)
        # Only where there are many copies is there a group to thin out.
        thin = np.repeat(np.add.reduceat(copies, first, dtype=np.int64) > 8, size) if len(rows) else hit
        if not thin.any():
            break
        hit &= thin
        left.append(lead[hit]), right.append(rows[hit])
        gone = copies & thin
        # A row that stays can be near a copy only if it is this near to the first.
        rim = thin & ~gone & (rows != lead) & (away <= apart + _CLOSE)
        for k in np.flatnonzero(np.logical_or.reduceat(rim, first)):
            of = slice(first[k], first[k] + size[k])
            c, r = rows[of][gone[of]], rows[of][rim[of]]
            step = max(1, _PAIRS // len(c))
            for some in (r[at : at + step] for at in range(0, len(r), step)):
                d = np.bitwise_count(fp[some][:, None] ^ fp[c][None]).sum(axis=2, dtype=np.int64)
                best = d.argmin(axis=1)
                hit = d[np.arange(len(some)), best] <= apart
                left.append(c[best[hit]]), right.append(some[hit])
        rows = rows[~gone & ~((rows == lead) & thin)]
    d, i = 1, rows
    at = np.arange(len(rows))
    while len(at):
        at = at[at + d < len(rows)]
        at = at[bucket[rows[at]] == bucket[rows[at + d]]]
        i, j = rows[at], rows[at + d]
        hit = near(i, j)
        left.append(i[hit]), right.append(j[hit])
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def similar_pairs(fps: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """The edges (a, b) whose texts have at least ``least`` of all their different shingles in common."""
    met = cut(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), "met")
    sets = cut(fps.select(F.col("row").alias("node"), "hashes").join(_within(met), "node"), "sets")
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    alike = common / F.greatest(F.size("x") + F.size("y") - common, F.lit(1))
    return edges.join(a, "a").join(b, "b").where(alike >= least).select("a", "b")


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, as shingles take many times the memory of their text."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows, sorted by ``key`` (a long), in tables that end where a value of it does."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = int(np.searchsorted(k, k[-1]))
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = []
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def crossing_pairs(token: np.ndarray, comp: np.ndarray, size: np.ndarray, place: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of one token and different components that can reach ``least``; rows sorted by token, comp.

    A pair's first common token is at ``place`` in both, so at most what follows there is common.
    """
    share = least / (1 + least)

    def can(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = np.minimum(size[i] - place[i], size[j] - place[j]) >= share * (size[i] + size[j]) - 1e-6
        return i[hit], j[hit]

    # The rows of one component in a token are a run, compared with all that comes after it in the token.
    new = np.r_[True, (token[1:] != token[:-1]) | (comp[1:] != comp[:-1])]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(token)]
    ends = np.searchsorted(token, token, side="right")
    last = end[np.cumsum(new) - 1]
    many = ends - last
    at = np.flatnonzero(many)
    while len(at):
        upto = max(1, int(np.searchsorted(np.cumsum(many[at]), _PAIRS, side="right")))
        some, at = at[:upto], at[upto:]
        if upto == 1:
            i = int(some[0])
            for lo in range(int(last[i]), int(ends[i]), _PAIRS):
                j = np.arange(lo, min(lo + _PAIRS, int(ends[i])))
                yield can(np.full(len(j), i), j)
            continue
        n = many[some]
        i = np.repeat(some, n)
        yield can(i, np.repeat(last[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(i)))


def rest_pairs(fps: DataFrame, comps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may have ``least`` of their shingles in common: all such pairs.

    A prefix join on shingles. With one order of all shingles, two texts of sizes m and n that have the
    share in common meet among the first m - ceil(least * m) + 1 of one and the same of the other.
    Shingles that only one component has can't be common and come first in the order, then the rarer
    ones, so texts that are mostly their own are through with those; what meets has to be able to
    reach the share by its places.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    finer = parts * _FINER
    sets = fps.select(F.col("row").alias("node"), "hashes").join(_within(comps), "node")

    # Shingles go packed, by bucket and 32 further bits of their hash. Different ones that agree in both
    # count as one here, which only lets more pairs meet: these are verified by the whole hashes.
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            node, comp = b.column("node").to_numpy(), b.column("comp").to_numpy()
            h = b.column("hashes").flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(node)), pc.list_value_length(b.column("hashes")).to_numpy())
            bucket = ((h >> np.uint64(32)) % np.uint64(finer)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, of, h = bucket[order], of[order], h[order].astype(np.uint32)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
            rows = []
            for lo, hi in zip(first, np.r_[first[1:], len(bucket)], strict=True):
                who, times = np.unique(of[lo:hi], return_counts=True)
                ids = np.diff(node[who], prepend=0)  # small numbers but for the first, so they compress
                rows.append((int(bucket[lo]), h[lo:hi].tobytes(), ids.tobytes(), (node[who] - comp[who]).tobytes(), times.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(5)], ["bucket", "tokens", "ids", "comps", "counts"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "bucket"):
            buckets = t["bucket"].to_numpy()
            first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(buckets)], strict=True):
                bucket, got = int(buckets[lo]), t.slice(lo, hi - lo).drop_columns(["bucket"])
                slices = pc.sum(pc.binary_length(got["tokens"])).as_py() // (4 * _TOKENS) + 1  # to bound memory
                for k in range(slices):
                    tokens, nodes, comps = [], [], []
                    for x, ids, less, times in zip(*(c for c in got.columns), strict=True):
                        x, ids, less, times = (np.frombuffer(c.as_buffer(), d) for c, d in ((x, np.uint32), (ids, np.int64), (less, np.int64), (times, np.uint32)))
                        node = np.cumsum(ids)
                        comp, here = node - less, x % slices == k
                        tokens.append(x[here]), nodes.append(np.repeat(node, times)[here]), comps.append(np.repeat(comp, times)[here])
                    token, node, comp = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(comps)
                    if not len(token):
                        continue
                    order = np.argsort(token)
                    token, node, comp = token[order], node[order], comp[order]
                    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                    n = np.diff(np.r_[first, len(token)])
                    keep = np.repeat(np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first), n)
                    if keep.any():
                        named = (bucket << 32) + token[keep].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(named), pa.array(np.repeat(n, n)[keep])], ["node", "token", "times"])

    dealt = sets.select("node", "comp", "hashes").mapInArrow(packed, "bucket long, tokens binary, ids binary, comps binary, counts binary")
    shared = dealt.repartition(finer, "bucket").sortWithinPartitions("bucket").mapInArrow(common, "node long, token long, times long")
    listed = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("l"))
    sized = cut(listed, "shared-shingles").join(sets.select("node", "comp", F.size("hashes").alias("n")), "node")
    needed, own = F.ceil(F.col("n") * F.lit(least) - 1e-6).cast("int"), F.col("n") - F.size("l")
    sized = sized.where(F.size("l") >= needed).withColumn("own", own).withColumn("ahead", F.col("n") - needed + 1 - own)
    places = sized.select("node", "comp", "n", "own", F.posexplode(F.slice("l", F.lit(1), F.col("ahead"))).alias("pos", "s"))
    places = cut(places.select("node", "comp", "n", (F.col("own") + F.col("pos")).alias("place"), F.col("s.token").alias("token")), "prefixes")
    met = places.repartition(parts, "token").sortWithinPartitions("token", "comp")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "token"):
            node = t["node"].to_numpy()
            size, place = t["n"].to_numpy().astype(np.int64), t["place"].to_numpy().astype(np.int64)
            for i, j in crossing_pairs(t["token"].to_numpy(), t["comp"].to_numpy(), size, place, least):
                if len(i):
                    both = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return cut(met.mapInArrow(pairs, "a long, b long").distinct(), "rest-pairs")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = LONG_SHINGLE, apart: int = LONG_APART, least: float = SIMILAR) -> DataFrame:
    """doc_id, component_id of documents 0.8 similar or more in their five-word shingles.

    The fingerprint's 32 blocks are the join keys; two texts at 0.8 share one of them with a chance of
    0.91, at 0.9 of 0.997. Hamming distance is verified in the bucket, and of what is left the share of
    common shingles, so that no text goes for one that is less similar than ``least``.

    The blocks find nearly all groups, at a low cost, but no block need be shared. So a join on shingles
    finds all similar pairs of texts that are in different components by then, and none is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            sets = [shingle_hashes(t.as_py(), shingle) for t in b.column(1)]
            fps = pa.array([_long_fingerprint(s) for s in sets], pa.binary())
            hashes = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), fps, hashes], ["doc_id", "fp", "hashes"])

    source = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    made = source.mapInArrow(run, f"doc_id {kind}, fp binary, hashes array<long>")
    fps = cut(made.withColumn("row", F.monotonically_increasing_id()), "long-fps")
    # A node is the first of the rows with its fingerprint; its shingles are that row's.
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("row").alias("node")), "long-nodes")

    width = LONG_BLOCK // 8
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("fp", i * width + 1, width).alias("k")) for i in range(LONG_BITS // LONG_BLOCK)])
    keyed = nodes.select("node", "fp", F.explode(blocks).alias("b")).select("node", "fp", "b.i", "b.k")
    sizes = keyed.select("i", "k", "node").groupBy("i", "k").agg(F.count("*").alias("n"), F.min("node").alias("least")).where(F.col("n") > HOT_BUCKET)
    sizes = cut(sizes, "hot-buckets")
    keyed = keyed.withColumn("salt", F.lit(0).cast("long"))
    if not sizes.isEmpty():
        # At most 32 / HOT_BUCKET of a row for each node.
        hot = sizes.hint("broadcast" if sizes.count() <= 10_000 else "shuffle_hash")
        deal = F.ceil(F.col("n") / F.lit(float(HOT_BUCKET))).cast("long")
        every = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("node") == F.col("least"), F.sequence(F.lit(0).cast("long"), deal - 1))
        keyed = keyed.drop("salt").join(hot, ["i", "k"], "left").withColumn("salt", F.explode(F.coalesce(every, F.array(F.pmod(F.xxhash64("node"), deal)))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.select("node", "fp", "i", "k", "salt").repartition(parts, "i", "k", "salt").sortWithinPartitions("i", "k", "salt", "node")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(some)
            node = t["node"].to_numpy()
            fp = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(len(node), -1)
            key = np.frombuffer(b"".join(t["k"].to_pylist()), np.uint16).astype(np.int64) + (t["i"].to_numpy().astype(np.int64) << 16) + (t["salt"].to_numpy() << 24)
            a, b = bucket_links(fp, key, apart)
            # A link is told once, in the first block that its texts share. Where that bucket was thinned it may
            # not be found there; then the join on shingles finds it, or a chain of others stands for it.
            block = t["i"].to_numpy()
            parts = fp.view(np.uint16)
            some = [slice(k, k + _PAIRS) for k in range(0, len(a), _PAIRS)]
            first = [(parts[a[k]] == parts[b[k]]).argmax(axis=1) == block[a[k]] for k in some]
            told = np.concatenate([np.zeros(0, bool), *first])
            a, b = a[told], b[told]
            return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])

        # A bucket may go on in the next batch: what is compared ends where a bucket does.
        for b in batches:
            if not b.num_rows:
                continue
            same = lambda x, y: all(x.column(c)[-1].as_py() == y.column(c)[0].as_py() for c in (2, 3, 4))
            if held and not same(held[-1], b):
                yield found(held)
                held = []
            last = [b.column(c)[b.num_rows - 1].as_py() for c in (2, 3, 4)]
            at = b.num_rows
            while at and [b.column(c)[at - 1].as_py() for c in (2, 3, 4)] == last:
                at -= 1
            if at:
                yield found([*held, b.slice(0, at)])
                held = []
            held.append(b.slice(at))
        if held:
            yield found(held)

    edges = cut(dealt.mapInArrow(links, "a long, b long").distinct(), "near")
    edges = cut(similar_pairs(fps, edges, least), "similar")
    groups = connected_components(edges, "a", "b")
    comps = cut(nodes.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "comps")
    rest = cut(similar_pairs(fps, rest_pairs(fps, comps, least), least), "rest")
    if not rest.isEmpty():
        groups = connected_components(edges.unionByName(rest), "a", "b")
    lows = groups.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    named = nodes.join(groups, "node", "left").join(lows, "component", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    return fps.select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id")


#: Bound of the ids that are broadcast to take rows out; beyond it they meet the rows by a shuffle.
BROADCAST_IDS = 500_000


def _within(ids: DataFrame) -> DataFrame:
    return ids.hint("broadcast" if ids.count() <= BROADCAST_IDS else "shuffle_hash")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component of similar documents the one with the least id.

    Rows repeated with an id are one document and one of them stays. Rows without an id can't be told
    from each other and stay. Texts without words are one group. Other columns are kept, whatever their
    names; an empty table gives no rows.
    """
    found = cut(similar_components(docs, id_col, text_col).where(F.col("doc_id").isNotNull()), "components")
    gone = cut(found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    again = cut(found.groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again"), "again")
    # The row in a struct, so that no name in it can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own"))
    stay = rows.join(_within(gone), F.col("own") == F.col("gone"), "left_anti")
    repeated = _within(again)
    once = stay.join(repeated, F.col("own") == F.col("again"), "left_anti")
    one = stay.join(repeated, F.col("own") == F.col("again"), "left_semi").dropDuplicates(["own"])
    return once.unionByName(one).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
