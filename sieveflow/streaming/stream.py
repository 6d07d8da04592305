"""Streaming analysis: the batch plan over each micro-batch of arriving files, and keyed state that tells each finding once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveflow import engine
from sieveflow.functions.durable import cut, exists, settings
from sieveflow.operators import graph, post, taint
from sieveflow.rules.model import RuleSet
from sieveflow.schemas import FINDINGS
from sieveflow.sources import corpus

#: State of streams that never forget.
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, comment: str = corpus.SUPPRESS_COMMENT, files_a_batch: int = 1000) -> DataFrame:
    """Files that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    got = (
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_a_batch).load(path)
    )
    clean = F.regexp_replace("path", "^file:/*", "/")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return corpus.files_of(got.select(clean.alias("file_path"), corpus.detect_type(clean).alias("file_type"), text.alias("source"), F.col("length").alias("size")), comment)


class Held:
    """What a stream keeps of rules with named sources and sinks until a chain of calls joins the names.

    Each batch adds its calls, the names it reaches and the findings that wait. The walk goes on from the names reached
    before over the batch's calls. Every table has a folder for each batch, which a repeated batch writes again.
    """

    def __init__(self, spark: SparkSession, rules: RuleSet, path: str):
        self.spark, self.path, self.rules = spark, path, engine.named(rules)
        self.sources, self.sinks = taint.named_ends(self.rules, spark)

    def _before(self, name: str, number: int, schema: str) -> DataFrame:
        if not number or not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}").where(F.col("batch") < number).drop("batch")

    def _store(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/batch={number}")

    def _open(self, reached: DataFrame) -> set[int]:
        """Rules (at most all of them) whose sources reach one of their sinks."""
        return {r[0] for r in reached.join(self.sinks, ["ord", "node"], "left_semi").select("ord").distinct().collect()}

    def released(self, found: DataFrame, batch: DataFrame, number: int) -> DataFrame:
        """A batch's findings, without those that wait, and with those that no longer have to."""
        calls = self._store(graph.undirected(engine.file_calls(batch)).distinct(), "calls", number)
        every = self._before("calls", number, "src string, dst string").unionByName(calls)
        before = self._before("reached", number, "ord int, node string")
        seen = before.unionByName(self.sources).distinct() if number else self.sources.distinct()
        grown = graph.grow(cut(seen, "seen"), every, calls, ("ord",))
        added = self._store(grown.join(before, ["ord", "node"], "left_anti"), "reached", number)
        was = self._open(before)
        now = was | self._open(added)
        names = [i for i, _ in self.rules]
        waiting = self._store(found.where(F.col("ord").isin(names)), "waiting", number)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        late = self._before("waiting", number, schema).where(F.col("ord").isin([*(now - was)] or [-1]))
        return found.where(~F.col("ord").isin(names)).unionByName(waiting.where(F.col("ord").isin([*now] or [-1]))).unionByName(late)


class Analysis:
    """A running analysis: one query finds, another tells each finding once."""

    def __init__(self, finds: StreamingQuery, tells: Callable[[], StreamingQuery], available_now: bool):
        self.finds, self._tells = finds, tells
        self.tells = None if available_now else tells()

    def awaitTermination(self) -> None:  # noqa: N802  as of Spark's queries
        self.finds.awaitTermination()
        if self.tells is None:  # what there was is found: now it is told
            self.tells = self._tells()
        self.tells.awaitTermination()

    def stop(self) -> None:
        for q in (self.finds, self.tells):
            if q is not None:
                q.stop()


def analyze_stream(files: DataFrame, rules: RuleSet, output: str, checkpoint: str, *, baseline: DataFrame | None = None, suppress: bool = True,
                   available_now: bool = True, time_limit: float | None = None) -> Analysis:
    """Findings of a stream of files, each once, appended to ``output``.

    A first query analyses each batch of files and writes what it finds to a folder of the batch below ``checkpoint``,
    so a batch that is run again after a failure writes its own folder again. A second one reads these as they
    come and appends to ``output`` what its state, keyed by finding id and kept on disk without expiry, doesn't know: an
    output folder never has a finding twice, whatever arrives again, whenever either query is started anew.
    The baseline is looked at when a batch is analysed, before anything is told.
    """
    spark = files.sparkSession
    held = Held(spark, rules, f"{checkpoint}/held") if engine.named(rules) else None
    raw = f"{checkpoint}/found"

    def one(batch: DataFrame, number: int) -> None:
        batch = cut(batch, "arrived")  # read several times
        found = engine.raw_findings(batch, rules, time_limit=time_limit, gate=False)
        found = found if baseline is None else post.without_baseline(found, baseline)
        found = post.without_suppressed(found, batch) if suppress else found
        if held:
            found = held.released(cut(found, "found"), batch, number)
        post.dedup(found).write.mode("overwrite").parquet(f"{raw}/batch={number}")

    def start(writer) -> StreamingQuery:
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def tells() -> StreamingQuery:
        # Made at once, so that there is something to read before the first batch is done.
        spark.createDataFrame([], FINDINGS + ", ord int").write.mode("ignore").parquet(f"{raw}/batch=-1")
        told = spark.readStream.schema(FINDINGS + ", ord int").parquet(f"{raw}/batch=*").dropDuplicates(["id"])
        with settings(spark, spark__sql__streaming__stateStore__providerClass=ON_DISK):  # taken over by the query when it starts
            return start(told.writeStream.format("parquet").option("path", output).option("checkpointLocation", f"{checkpoint}/told"))

    return Analysis(start(files.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/files")), tells, available_now)


def findings(spark: SparkSession, output: str) -> DataFrame:
    """What a stream has told so far."""
    return spark.read.schema(FINDINGS + ", ord int").parquet(output)


def line_hits_stream(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Stateless line matches of a stream, for sinks of one's own: no micro-batch code at all."""
    from sieveflow.operators.text import line_hits
    from sieveflow.rules.model import TextRegex

    return line_hits(files, rules.of(TextRegex))


def dedup_within(hits: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """A stream's rows once per key, with state only for as long as the watermark's delay."""
    return hits.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Tumbling-window counts and sums of an event stream or table."""
    return (
        events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
    )
