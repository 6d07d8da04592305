"""Embedding near-dedup by sorted projection passes.

In each pass every vector gets a key of concatenated random hashes (signs of projections on random
directions, the same for all vectors, different in each pass). The vectors are sorted by label and
then by key, lexicographically, by range partitioning, so a label with a third of all rows is spread
over many tasks. Within the order each vector is compared with its next ``WINDOW`` neighbours in
double precision; pairs at or above the threshold are links. Where a window's last links reach its
edge, it grows until a window's width of neighbours goes by without a link, so a dense group is not
cut off: the width bounds the search and not the result. Rows whose window reaches over the end of
their partition go on in the next, and in the ones after it, as far as their window grows, so the
links are those of the order as a whole, however many partitions it has. The links of all passes are
united.

Copies (equal vectors of one label) are one class from the start: they are sorted and compared once,
and count by their number. A pair is missed only if all passes keep it apart; see the README for the
recall measured. Links are never wrong, as each is verified.

Cases: a vector that is null, zero, or holds null or non-finite components, and one with a null
label, links with nothing and stays; vectors of different length never link; repeated ids are
vectors of their own that share a component; a null id is given a row and never names a component
unless all its members lack ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import connected_components, cut

THRESHOLD = 0.98
PASSES, HASHES, WINDOW, SEED = 16, 48, 32, 20240731
#: Sorted rows that are compared at a time beyond the window, to bound memory.
_ROWS = 1 << 14
#: Rows of a following partition, and rows that go on into it, that are compared at a time.
_AHEAD, _ONWARD = 512, 2048


def usable(v: Column, label: Column) -> Column:
    """Whether a vector may link: not null, all components finite, not zero, label not null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & finite & some, F.lit(False))


def keys(x: np.ndarray, p: int, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """The pass's key of each row: signs of projections, first hash in the highest bit."""
    directions = np.random.default_rng([seed, p, x.shape[1]]).standard_normal((x.shape[1], hashes))
    bits = (x @ directions > 0).astype(np.int64)
    return bits @ (1 << np.arange(hashes - 1, -1, -1, dtype=np.int64))


def window_links(x: np.ndarray, group: np.ndarray, threshold: float = THRESHOLD, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of links in sorted rows: unit vectors ``x``, comparable within equal ``group``."""
    return _grown_links(x, group, threshold, window)[:2]


def _grown_links(x: np.ndarray, group: np.ndarray, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links, and the offset up to which each row looks."""
    n, left, right = len(x), [], []
    until = np.full(n, window)  # the offset up to which each row still looks
    active = np.arange(n)
    d = 0
    while len(active):
        d += 1
        active = active[(active + d < n) & (until[active] >= d)] if d > 1 else active[active + d < n]
        for at in range(0, len(active), _ROWS):
            i = active[at : at + _ROWS]
            j = i + d
            same = group[i] == group[j]
            i, j = i[same], j[same]
            hit = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[hit], j[hit]
            left.append(i), right.append(j)
            until[i] = np.maximum(until[i], d + window)
        # A row whose group has ended looks no further.
        if d % window == 0 and len(active):
            ahead = np.minimum(active + d, n - 1)
            active = active[group[active] == group[ahead]]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right]), until


def onward_links(x: np.ndarray, reach: np.ndarray, y: np.ndarray, start: int, threshold: float = THRESHOLD, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j) of rows ``x`` with the rows ``y`` that follow at places ``start`` and on.

    Each row looks up to the place ``reach``, and a window's width beyond each link. The third result
    is the reach after that.
    """
    left, right, reach = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], reach.copy()
    for lo in range(0, len(y), _AHEAD):
        active = np.flatnonzero(reach >= start + lo)
        if not len(active):
            break
        for some in (active[k : k + _ONWARD] for k in range(0, len(active), _ONWARD)):
            r, q = np.nonzero(x[some] @ y[lo : lo + _AHEAD].T >= threshold)
            if not len(r):
                continue
            place = q + (start + lo)
            first = np.r_[True, r[1:] != r[:-1]]
            # A link farther than a window from the one before is out of reach, and so is all after it.
            far = place > np.where(first, reach[some[r]], np.r_[0, place[:-1]] + window)
            fars = np.cumsum(far)
            ok = fars == (fars - far)[first][np.cumsum(first) - 1]
            i, at = some[r[ok]], place[ok]
            left.append(i), right.append(at - start)
            np.maximum.at(reach, i, at + window)
    return np.concatenate(left), np.concatenate(right), reach


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """cls (a number), label, dim, vec, n, low (least id): equal usable vectors of a label, as one row."""
    v, label = F.col(vector_col), F.col(label_col)
    good = vectors.where(usable(v, label)).select(label.alias("label"), v.alias("vec"), F.col(id_col).alias("id"))
    one = good.groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    # The class's number is its rank-free place in the written table, fixed once it is written.
    return cut(one.select(F.monotonically_increasing_id().alias("cls"), "label", F.size("vec").alias("dim"), "vec", "n", "low"), "classes")


def pass_links(cls: DataFrame, passes: list[int], threshold: float = THRESHOLD, hashes: int = HASHES, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Distinct links (a, b), a < b, of classes that the given passes find."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                t = b.filter(pa.array(dims == dim))
                x = _matrix(t.column(3))
                for p in passes:
                    k = pa.array(keys(x, p, hashes, seed), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p), pa.int32()), t.column(1), t.column(2), k, t.column(0), t.column(3)], names)

    names = ["pass", "label", "dim", "key", "cls", "vec"]
    label = cls.schema["label"].dataType.simpleString()
    vec = cls.schema["vec"].dataType.simpleString()
    rows = cls.select("cls", "label", "dim", "vec").mapInArrow(keyed, f"pass int, label {label}, dim int, key long, cls long, vec {vec}")
    order = ["pass", "label", "dim", "key", "cls"]
    n = int(cls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    # Rows of ``step``, by kind: links a, b; the first rows of each partition; rows that look on over a
    # partition's end, up to place ``at`` of partition ``part`` and from its place ``size`` on; the
    # places of all rows, without vectors.
    LINK, HEAD, OPEN, PLACE = range(4)
    kept = ["pass", "label", "dim", "cls", "vec"]
    out_names = ["kind", "a", "b", "part", "at", "size", *kept]
    kinds = f"kind int, a long, b long, part int, at long, size long, pass int, label {label}, dim int, cls long, vec {vec}"

    def told(a: np.ndarray, b: np.ndarray, like: pa.Table) -> pa.RecordBatch:
        # Within a task, passes may find a link twice.
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        none = [pa.nulls(len(both), t) for t in (pa.int32(), pa.int64(), pa.int64(), *(like[c].type for c in kept))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(both), LINK), pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), *none], out_names)

    def some_rows(kind: int, t: pa.Table, part: int, at: np.ndarray, size: int, vectors: bool = True) -> Iterator[pa.RecordBatch]:
        full = lambda v, k: pa.array(np.full(t.num_rows, v), k)
        none = pa.nulls(t.num_rows, pa.int64())
        cols = [t[c] if c != "vec" or vectors else pa.nulls(t.num_rows, t[c].type) for c in kept]
        yield from pa.table([full(kind, pa.int32()), none, none, full(part, pa.int32()), pa.array(at, pa.int64()), full(size, pa.int64()), *cols], out_names).to_batches(_ROWS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task holds its range of the order: the input's share, as range partitions are even.
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        part, size = TaskContext.get().partitionId(), table.num_rows
        dims, ids = table["dim"].to_numpy(), table["cls"].to_numpy()
        labels = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        group = (table["pass"].to_numpy().astype(np.int64) << 32) + labels
        for dim in np.unique(dims):
            k = np.flatnonzero(dims == dim)
            x = _unit(_matrix(table["vec"].take(pa.array(k))))
            i, j, until = _grown_links(x, group[k], threshold, window)
            yield told(ids[k[i]], ids[k[j]], table)
            if dim == dims[-1]:
                # The group of the last row may go on in the next partition.
                reach = np.arange(len(k)) + until - len(k)
                on = np.flatnonzero((group[k] == group[-1]) & (reach >= 0))
                yield from some_rows(OPEN, table.take(pa.array(k[on])), part, reach[on], 0)
        yield from some_rows(HEAD, table.slice(0, window), part, np.arange(min(window, size)), size)
        yield from some_rows(PLACE, table, part, np.arange(size), size, vectors=False)

    step = cut(rows.mapInArrow(found, kinds), "pass")
    links = step.where(F.col("kind") == LINK).select("a", "b")
    parts = sorted(r[0] for r in step.where(F.col("kind") == HEAD).select("part").distinct().collect())  # a number for each partition
    after = dict(zip(parts, parts[1:], strict=False))
    if not after:
        return links.distinct()
    spark = cls.sparkSession

    def across(table: pa.Table) -> pa.Table:
        # A group holds rows of one partition, and rows of one group of vectors that go on into it.
        kind = table["kind"].to_numpy()
        c, q = table.filter(pa.array(kind == OPEN)), table.filter(pa.array(kind != OPEN)).sort_by("at")
        got: list[pa.RecordBatch] = []
        if c.num_rows and q.num_rows:
            both = pa.concat_tables([c.select(kept), q.select(kept)])
            codes = both["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            same = (codes == codes[0]) & (both["pass"].to_numpy() == both["pass"][0].as_py()) & (both["dim"].to_numpy() == both["dim"][0].as_py())
            same = same[c.num_rows :]
            part, size, end = q["part"][0].as_py(), q["size"][0].as_py(), q["at"][-1].as_py() + 1
            goes_on, q = bool(same.all()), q.filter(pa.array(same))
            y, at = (_unit(_matrix(q["vec"])), q["at"].to_numpy()) if q.num_rows else (None, None)
            starts = c["size"].to_numpy()
            for start in np.unique(starts) if q.num_rows else []:
                t = c.filter(pa.array(starts == start))
                from_start = at >= start
                i, j, reach = onward_links(_unit(_matrix(t["vec"])), t["at"].to_numpy(), y[from_start], int(start), threshold, window)
                got.append(told(t["cls"].to_numpy()[i], q["cls"].to_numpy()[from_start][j], t))
                if goes_on and end < size:
                    on = np.flatnonzero(reach >= end)
                    got += some_rows(OPEN, t.take(pa.array(on)), part, reach[on], end)
                elif goes_on and part in after:
                    on = np.flatnonzero(reach >= size)
                    got += some_rows(OPEN, t.take(pa.array(on)), after[part], reach[on] - size, 0)
        return pa.Table.from_batches(got, schema) if got else schema.empty_table()

    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), *to_arrow_schema(step.select(*kept).schema)])
    following = spark.createDataFrame(list(after.items()), "part int, following int")
    carried = step.where(F.col("kind") == OPEN).join(F.broadcast(following), "part").withColumn("part", F.col("following")).select(*out_names)
    ahead = step.where(F.col("kind") == HEAD)
    # First the first rows of each partition; beyond them, whole partitions of the few where windows go on.
    for _ in range(len(parts) + 1):
        crossed = cut(carried.unionByName(ahead).groupBy("part").applyInArrow(across, kinds), "crossing")
        links = links.unionByName(crossed.where(F.col("kind") == LINK).select("a", "b"))
        carried = crossed.where(F.col("kind") == OPEN)
        to = [r[0] for r in carried.select("part").distinct().collect()]
        if not to:
            break
        ahead = step.where((F.col("kind") == PLACE) & F.col("part").isin(to)).drop("vec").join(cls.select("cls", "vec"), "cls").select(*out_names)
    return links.distinct()


def embed_dedup(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, hashes: int = HASHES, window: int = WINDOW,
                seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``."""
    cls = classes(vectors, id_col, vector_col, label_col)
    links = cut(pass_links(cls, list(range(passes)), threshold, hashes, window, seed), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(cls.select(F.col("cls").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("more"))
    comp = connected_components(links, "a", "b")
    lows = comp.join(cls.select("cls", "low"), comp.node == F.col("cls")).groupBy("component").agg(F.min("low").alias("component_low"))
    of = comp.join(lows, "component").select(F.col("node").alias("cls"), "component_low")
    told = cls.join(others, cls.cls == F.col("a"), "left").join(of, "cls", "left")
    told = cut(
        told.select(
            F.col("label").alias("l"), F.col("vec").alias("v"),
            (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_low", "low").alias("component_id"),
        ),
        "told",
    )
    v, label = F.col(vector_col), F.col(label_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), v.alias("vec"), usable(v, label).alias("good"))
    # Vectors that link with nothing never meet the classes.
    good = rows.where("good").join(told, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v"))).select("vec_id", "n_links", "component_id")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.unionByName(rest)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
