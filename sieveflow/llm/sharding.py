"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Compaction sorts the shards below a quarter of
the target size into tiers (each ``RATIO`` times the last) and merges the similarly sized ones of a tier
into files of about the target; a row is rewritten about once per tier. Shards from a quarter of the
target up are done, so the target is a range. A tier is merged by one job, whatever the number of its
files: its scan packs files of similar size into partitions of at most the target, and each partition is
written as one file. Nothing is shuffled for that, and a task holds a row group at a time.

A table's state is its newest manifest, a small JSON file that names lists of shards. A list is a Parquet
table with a row for each shard, written and read by Spark, so the driver holds no row for each shard but
the paths of files that it is about to read. A version is committed by one rename that fails where the
version exists, so of two writers one wins and the other starts again from the new version (a merge whose
inputs are gone by then is dropped). Readers hold to the version that they opened; ``vacuum`` deletes only
files that the last versions don't name. A job that dies leaves files that no manifest names, and nothing
else. Row counts in and out are compared before a merge is committed.

Cases: nulls, repeated rows, empty and very long texts are kept as they are; columns may differ
between arrivals by name (what lacks is null) but not in type; an arrival without rows commits
nothing; a shard larger than the target stays as it is.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET = 64 << 20
#: Sizes of adjacent tiers; the fewest shards that are merged; rows of a shard on arrival, at most.
RATIO, FEWEST, ARRIVAL_ROWS = 4, 2, 4096
#: Neighbouring rows of a file that arrive together.
ARRIVAL_BLOCK = 64
#: Files that one job merges, at most (their paths are on the driver); lists of a manifest beyond which they are joined.
FILES_A_JOB, LISTS = 100_000, 16
#: Files of a list.
LIST_FILES = 2
#: A row of a list: the path below the root, bytes and rows of a shard.
SHARD = "path string, bytes long, rows long"


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    lists: tuple[str, ...]

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema)) if self.schema else StructType([])


class Conflict(RuntimeError):
    """Another writer committed first, and what this one would replace is gone."""


def tier(size: str | Column = "bytes", target: int = TARGET, ratio: int = RATIO) -> Column:
    """Number of ratios below the target; null for shards that are near enough to it."""
    b = F.greatest(F.col(size) if isinstance(size, str) else size, F.lit(1))
    return F.when(b < target / ratio, F.ceil(F.log(F.lit(float(target)) / b) / math.log(ratio) - 1e-9).cast("int"))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        #: What this writer's merges did so far.
        self.merges = self.rows_merged = 0

    # Files

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        fs = self._fs()
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names(f"{self.root}/_manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        every = self.versions()
        if not every:
            return Manifest(0, None, ())
        version = every[-1] if version is None else version
        stream = self._fs().open(self._path(f"{self.root}/_manifests/v{version:012d}.json"))
        try:
            d = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(d["version"], d["schema"], tuple(d["lists"]))

    def listed(self, m: Manifest | tuple[str, ...]) -> DataFrame:
        """path, bytes, rows: a row for each shard of a manifest or of some lists."""
        lists = m.lists if isinstance(m, Manifest) else m
        if not lists:
            return self.spark.createDataFrame([], SHARD)
        return self.spark.read.schema(SHARD).parquet(*[f"{self.root}/_lists/{x}" for x in lists])

    def _write_list(self, shards: DataFrame) -> str:
        name = uuid.uuid4().hex
        # A list is small, some 100 bytes for each shard of 64 MB, so it isn't dealt over all partitions.
        shards.select("path", "bytes", "rows").coalesce(LIST_FILES).write.parquet(f"{self.root}/_lists/{name}")
        return name

    def commit(self, add: str, replaces: str | None = None, schema: StructType | None = None, tries: int = 20) -> Manifest:
        """The next version: without the shards of the list ``replaces``, with those of ``add``. One rename decides which writer has it."""
        for _ in range(tries):
            now = self.manifest()
            lists = now.lists
            if replaces:
                # What a job replaces are ``FILES_A_JOB`` rows at most.
                held, gone = self.listed(now), F.broadcast(self.listed((replaces,)).select("path"))
                if held.join(gone, "path", "left_semi").count() < gone.count():
                    raise Conflict("a shard to be replaced is no longer in the table")
                lists = (self._write_list(held.join(gone, "path", "left_anti")),)
            elif len(lists) >= LISTS:
                lists = (self._write_list(self.listed(now)),)
            fields = {f.name: f for f in now.struct}
            for f in schema or ():
                if f.name in fields and fields[f.name].dataType != f.dataType:
                    raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
                fields.setdefault(f.name, f)
            new = Manifest(now.version + 1, StructType(list(fields.values())).json(), (*lists, add))
            if self._publish(new):
                return new
        raise Conflict(f"no version could be committed in {tries} tries")

    def _publish(self, m: Manifest) -> bool:
        fs = self._fs()
        temp = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(asdict(m)).encode()))
        finally:
            out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.valueOf("NONE")
        to = self._path(f"{self.root}/_manifests/v{m.version:012d}.json")
        try:
            hadoop.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self._conf).rename(temp, to, none)
        except Exception:
            fs.delete(temp, False)
            if not fs.exists(to):
                raise
            return False
        return True

    # Rows

    def _written(self, folder: str) -> str:
        """The list of the shards in ``data/folder``: their rows are read from the files' ends, no column is."""
        files = self.spark.read.parquet(f"{self.root}/data/{folder}").select(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("b"))
        counted = files.groupBy("f", "b").agg(F.count("*").alias("rows"))
        return self._write_list(counted.select(F.concat(F.lit(f"data/{folder}/"), "f").alias("path"), F.col("b").alias("bytes"), "rows"))

    def append(self, df: DataFrame, max_rows: int = ARRIVAL_ROWS) -> Manifest:
        folder = uuid.uuid4().hex
        df.write.option("maxRecordsPerFile", max_rows).parquet(f"{self.root}/data/{folder}")
        new = self._written(folder)
        return self.manifest() if self.listed((new,)).isEmpty() else self.commit(new, schema=df.schema)

    @contextmanager
    def _packed(self) -> Iterator[None]:
        """Scans lay whole files of falling size together, up to the target in a partition."""
        conf = self.spark.conf
        wanted = {"maxPartitionBytes": str(self.target), "openCostInBytes": "0", "minPartitionNum": "1"}
        wanted = {f"spark.sql.files.{k}": v for k, v in wanted.items()}
        before = {k: conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                conf.set(k, v) if v is not None else conf.unset(k)

    def _next_run(self, m: Manifest) -> DataFrame | None:
        """The shards of the smallest tier that has enough to merge, ``FILES_A_JOB`` at most."""
        tiered = self.listed(m).withColumn("tier", tier("bytes", self.target)).where("tier is not null")
        # At most a row for each tier.
        ready = [r["tier"] for r in tiered.groupBy("tier").count().where(F.col("count") >= FEWEST).collect()]
        return tiered.where(F.col("tier") == max(ready)).orderBy("bytes", "path").limit(FILES_A_JOB) if ready else None

    def compact(self) -> Manifest:
        """Merge until no tier has a run."""
        while True:
            now = self.manifest()
            run = self._next_run(now)
            if run is None:
                return now
            old = self._write_list(run)
            paths = [f"{self.root}/{r['path']}" for r in self.listed((old,)).select("path").collect()]
            folder = uuid.uuid4().hex
            total = lambda x: tuple(self.listed((x,)).agg(F.sum("rows"), F.count("*"), F.sum("bytes")).first())
            rows, files, size = total(old)
            # Where a session holds its scans to smaller partitions, these are put together, to half the target or more.
            most = max(1, math.ceil(2 * size / self.target))
            with self._packed():
                self.spark.read.schema(now.struct).parquet(*paths).coalesce(most).write.parquet(f"{self.root}/data/{folder}")
            new = self._written(folder)
            rows_after, files_after, _ = total(new)
            if rows_after != rows:
                raise RuntimeError("a merge changed the number of rows")
            if files_after >= files:
                raise RuntimeError(f"a merge of {files} files gave {files_after}")
            try:
                self.commit(new, old)
                self.merges, self.rows_merged = self.merges + 1, self.rows_merged + rows
            except Conflict:
                self._fs().delete(self._path(f"{self.root}/data/{folder}"), True)

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files that none of the last ``keep`` versions names; returns their number."""
        kept = [self.manifest(v) for v in self.versions()[-keep:]]
        fs, gone = self._fs(), 0
        named = self.listed(tuple({x for m in kept for x in m.lists})).select("path").distinct()
        folder = F.element_at(F.split("path", "/"), 2)
        # A row for each folder, as many as there were jobs.
        live = {r[0] for r in named.select(folder).distinct().collect()}
        for name in self._names(f"{self.root}/data"):
            files = [f for f in self._names(f"{self.root}/data/{name}") if f.endswith(".parquet")]
            if name not in live:
                fs.delete(self._path(f"{self.root}/data/{name}"), True)
                gone += len(files)
                continue
            own = {r[0].rpartition("/")[2] for r in named.where(folder == name).collect()}
            for f in set(files) - own:
                gone += fs.delete(self._path(f"{self.root}/data/{name}/{f}"), False)
        for name in set(self._names(f"{self.root}/_lists")) - {x for v in self.versions() for x in self.manifest(v).lists}:
            fs.delete(self._path(f"{self.root}/_lists/{name}"), True)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        paths = [f"{self.root}/{r['path']}" for r in self.listed(m).select("path").collect()]
        return self.spark.read.schema(m.struct).parquet(*paths) if paths else self.spark.createDataFrame([], m.struct)

    def shards(self, version: int | None = None) -> DataFrame:
        """shard (its file's name), path, shard_bytes, shard_rows: a row for each shard."""
        m = self.listed(self.manifest(version))
        return m.select(F.substring_index("path", "/", -1).alias("shard"), "path", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))


def arrivals_of(table: DataFrame, arrivals: int) -> Iterator[DataFrame]:
    """A table's rows as they might arrive: some of its files at a time, or of fewer files some of the rows of each."""
    files = sorted(table.inputFiles())
    if len(files) >= arrivals:
        step = math.ceil(len(files) / arrivals)
        for at in range(0, len(files), step):
            yield table.sparkSession.read.schema(table.schema).parquet(*files[at : at + step])
    else:
        # A row's place in its file, in blocks, so that neighbours arrive together.
        block = F.floor(F.col("_metadata.row_index") / ARRIVAL_BLOCK)
        for k in range(arrivals):
            yield table.where(F.pmod(block, F.lit(arrivals)) == k)


def shard_documents(spark: SparkSession, path: str, root: str, arrivals: int = 8, target: int = TARGET) -> DataFrame:
    """Append the table under ``path`` in some arrivals, compact after each, and tell where each row is:
    doc_id, shard, shard_rows, shard_bytes, version, merges, rows_merged, text_sha256 (of the text read back)."""
    table = spark.read.parquet(path)
    store = ShardStore(spark, root, target)
    for part in arrivals_of(table, arrivals):
        store.append(part)
        store.compact()
        store.vacuum()
    m = store.manifest()
    if not m.lists:
        none = F.lit(None)
        return table.limit(0).select(
            "doc_id", none.cast("string").alias("shard"), *[none.cast("long").alias(c) for c in ("shard_rows", "shard_bytes", "version", "merges", "rows_merged")],
            none.cast("string").alias("text_sha256"),
        )
    rows = store.read(m.version).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("_metadata.file_name").alias("shard"))
    shards = store.shards(m.version)
    few = shards.limit(FILES_A_JOB + 1).count() <= FILES_A_JOB
    found = rows.join(F.broadcast(shards) if few else shards, "shard")
    counted = [F.lit(n).cast("long").alias(c) for n, c in ((m.version, "version"), (store.merges, "merges"), (store.rows_merged, "rows_merged"))]
    return found.select("doc_id", "shard", "shard_rows", "shard_bytes", *counted, "text_sha256")
