"""Structured Streaming forms of the roll-ups and of incremental indexing.

Each gives on a finished stream what its batch operator gives on the same rows.
Batches are applied by ``foreachBatch`` with files named by the batch's number, so a
batch that runs again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.activity import usable
from ..operators.store import changes, latest_hash, swap

EVENTS = "event_id long, ts long, repo string, kind string, session_id string, detail string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, fmt: str = "parquet", per_batch: int | None = None) -> DataFrame:
    """Events from files that arrive in a folder; a path of one file is that file of its folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if "*" not in folder and fs.exists(path) and fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).load(path.getParent().toString())
    return reader.load(folder)


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, n) over tumbling hours of event time; on a stream, state older than ``late`` behind the newest event is let go."""
    e = usable(events).withColumn("at_ts", F.timestamp_seconds("at"))
    e = e.withWatermark("at_ts", late) if e.isStreaming else e
    g = e.groupBy(F.window("at_ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd'T'HH").alias("hour"), "n")


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(stream, started, ended, n) by session windows, for streams; bounded histories use ``operators.sessions``."""
    stream = F.when(F.coalesce("session_id", F.lit("")) != "", F.col("session_id")).otherwise(F.concat(F.lit("legacy/"), F.coalesce("repo", F.lit(""))))
    e = usable(events).select(stream.alias("stream"), F.timestamp_seconds("at").alias("at_ts"))
    e = e.withWatermark("at_ts", late) if e.isStreaming else e
    g = e.groupBy("stream", F.session_window("at_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("at_ts").alias("ended"))
    return g.select("stream", F.col("w.start").alias("started"), "ended", "n")


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """A query over what is there now, into a table in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _state(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return read_log(spark, folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def latest_scans(log: DataFrame) -> DataFrame:
    """(repo, path, hash) after all batches of a change log (batch, repo, path, hash)."""
    return log.groupBy("repo", "path").agg(F.max_by("hash", "batch").alias("hash"))


def index_changes(scans: DataFrame, folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Follow scans (repo, path, hash[, indexed_at, file_id]) and keep under ``folder`` a log of files that were added or changed, skipping equal ones.

    Within a batch the latest scan of a file stands for it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = _state(spark, folder)
        now = latest_hash(batch)
        if log is not None:
            known = latest_scans(log.where(F.col("batch") < number)).select(F.col("repo").alias("r"), F.col("path").alias("p"), F.col("hash").alias("h"))
            now = now.join(known, F.col("repo").eqNullSafe(F.col("r")) & (F.col("path") == F.col("p")) & (F.col("hash") == F.col("h")), "left_anti")
        now.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/part-{number:09d}.batch")

    writer = scans.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(folder)


def scan_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a full rescan changed; deletions show only here, as a stream of scans cannot tell them."""
    return changes(old, new)


def notify(changes: DataFrame, folder: str, checkpoint: str, title: str = "knowledge changed") -> StreamingQuery:
    """Follow changed entries and keep one notification row (title, n, batch) under ``folder``, replaced by each batch that has rows."""

    def apply(batch: DataFrame, number: int) -> None:
        n = batch.count()
        if n:
            swap(batch.sparkSession.range(1).select(F.lit(title).alias("title"), F.lit(n).cast("long").alias("n"), F.lit(number).cast("long").alias("batch")), folder)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_texts(texts: DataFrame, folder: str, checkpoint: str, interval: str | None = "300 seconds") -> StreamingQuery:
    """Follow texts (doc_id, text) and keep a log (batch, hash, doc_id) of those whose hash is new, each hash once, looking every ``interval``."""

    def apply(batch: DataFrame, number: int) -> None:
        log = _state(batch.sparkSession, folder)
        now = batch.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"))
        if log is not None:
            now = now.join(log.where(F.col("batch") < number).select("hash"), "hash", "left_anti")
        now.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/part-{number:09d}.batch")

    writer = texts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class Health(StreamingQueryListener):
    """Counts the rows and batches that running streams report, and the streams that ended with an error."""

    def __init__(self) -> None:
        self.rows, self.batches, self.failed = 0, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed += event.exception is not None


def progress(query: StreamingQuery) -> tuple[int, int]:
    """Batches and rows that a stream reports to have taken in."""
    seen = query.recentProgress
    return len(seen), sum(p["numInputRows"] for p in seen)
