"""Exact dedup by a streaming, disk-backed keyed state.

Arrivals are read as a stream. Each row is reduced to the SHA-256 of its normalised text, its
stable identifier and a content locator (file and row in the file), and a keyed state without
expiry keeps, for every digest, the least (identifier, locator) and the number of rows. The state
lives in RocksDB, so it is bounded by disk and not by memory, and its checkpoint is in the shared
folder, so a lost executor reloads its share. The ledger is read back with the state reader.

Rows that hit a digest held by another row are then compared byte by byte with the keeper's text,
which their locators lead to; hits whose bytes differ (a collision) are grouped by their bytes.

Cases: a null text counts as empty, and all empty texts are equal; equal ids (repeated rows) are
told apart by the locator; a null id sorts after all others; other columns are ignored, whatever
their names; an empty table gives no rows. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACES, cut, fresh_path, text_or_empty

#: Bound of the locators that are broadcast to fetch texts; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """digest, id, locator of each row of a file-backed table (a batch or a stream)."""
    return df.select(
        digest(normalised(text_col)).alias("text_sha256"),
        F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def who(prefix: str = "") -> Column:
    """Order of identifiers: nulls last, ties by locator."""
    c = lambda n: F.col(prefix + n)
    return F.struct(c("id").isNull().alias("no_id"), c("id").alias("id"), c("file").alias("file"), c("row").alias("row"))


def arrivals(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the files under ``path``, which may also be one file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def absorb(spark: SparkSession, stream: DataFrame, checkpoint: str, state_partitions: int | None = None) -> DataFrame:
    """Run the stream ``stream`` (rows of :func:`identified`) into the state at ``checkpoint``.

    Returns the ledger: text_sha256, keeper (struct no_id, id, file, row), group_size. A second
    call with the same checkpoint reads only files that the first did not.
    """
    held = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        # Else each of the state's partitions sets aside some megabytes of disk before it holds a key.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.shuffle.partitions": str(state_partitions or spark.conf.get("spark.sql.shuffle.partitions")),
    }
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        state = stream.groupBy("text_sha256").agg(F.min(who()).alias("keeper"), F.count("*").alias("group_size"))
        run = (
            state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    store = spark.read.format("statestore").load(checkpoint)
    buffers = store.schema["value"].dataType.names
    return store.select(
        F.col("key").getField(store.schema["key"].dataType.names[0]).alias("text_sha256"),
        F.col("value").getField(buffers[0]).alias("keeper"),
        F.col("value").getField(buffers[1]).alias("group_size"),
    )


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST_ROWS,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row under ``path``: doc_id, keep_id, group_size, kept, text_sha256."""
    table = spark.read.parquet(path)
    stream = arrivals(spark, path, table.schema)
    ledger = cut(absorb(spark, identified(stream, id_col, text_col, digest), checkpoint or fresh_path(spark, "state")), "ledger")
    rows = cut(identified(table, id_col, text_col, digest), "digests")

    # Groups of two and more, without the keepers themselves: the hits.
    groups = ledger.where("group_size > 1").withColumnRenamed("text_sha256", "digest")
    hits = rows.join(groups, rows.text_sha256 == groups.digest).where(who() != F.col("keeper"))
    hits = cut(hits.select("id", "file", "row", "digest", "keeper"), "hits")
    # The texts of hits and their keepers are fetched in one pass over the table, which is not shuffled
    # for that while they are few.
    keepers = hits.select("digest", "keeper.id", "keeper.file", "keeper.row", F.lit(True).alias("keeps")).distinct()
    wanted = cut(hits.select("digest", "id", "file", "row", F.lit(False).alias("keeps")).unionByName(keepers), "wanted")
    wanted = wanted.hint("broadcast" if wanted.limit(bound + 1).count() <= bound else "shuffle_hash")  # at most ``bound`` rows
    texts = table.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        normalised(text_col).alias("bytes"),
    )
    got = cut(texts.join(wanted, ["file", "row"]), "hit-texts")
    # The keeper's bytes meet those of its hits on the digest: one row of a digest on one side, so
    # the side with the copies can be split however many there are.
    keeper = got.where("keeps").select("digest", F.col("bytes").alias("kept_bytes"))
    differs = got.where("not keeps").join(keeper, "digest").where(F.col("bytes") != F.col("kept_bytes"))
    broken = cut(differs.select("digest", "id", "file", "row", "bytes"), "collisions")
    if not broken.isEmpty():
        # Of no effect but for a collision of digests: what differs from its keeper leaves the group.
        own = broken.groupBy("digest", "bytes").agg(F.min(who()).alias("own_keeper"), F.count("*").alias("own_size"))
        moved = broken.join(own, ["digest", "bytes"]).select("file", "row", "own_keeper", "own_size")
        lost = broken.groupBy(F.col("digest").alias("text_sha256")).agg(F.count("*").alias("lost"))
        ledger = ledger.join(lost, "text_sha256", "left").withColumn("group_size", F.col("group_size") - F.coalesce("lost", F.lit(0))).drop("lost")
        rows = rows.join(moved, ["file", "row"], "left")
    else:
        rows = rows.withColumns({"own_keeper": F.lit(None).cast(ledger.schema["keeper"].dataType), "own_size": F.lit(None).cast("long")})
    joined = rows.join(ledger, "text_sha256", "left")
    keeper = F.coalesce("own_keeper", "keeper")
    return joined.select(
        F.col("id").alias("doc_id"),
        keeper.getField("id").alias("keep_id"),
        F.coalesce("own_size", "group_size").cast("long").alias("group_size"),
        (who() == keeper).alias("kept"),
        "text_sha256",
    )
