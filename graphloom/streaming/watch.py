"""Structured Streaming: watched folders, coalesced changes, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.scan import ignored

#: Where a drained stream keeps its state: on the executors' disks, with bounded memory beside the heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def watch(spark: SparkSession, root: str, extra_ignore: list[str] = ()) -> DataFrame:
    """A stream of changed files: ``path, modified, size, content``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    return raw.where(~ignored(F.col("path"), extra_ignore)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def coalesce_changes(stream: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Each changed path once within the watermark (the debounce of a watcher)."""
    return stream.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["path"])


def on_batch(stream: DataFrame, handle, checkpoint: str, every: str | None = None):
    """Runs ``handle(batch, id)`` for each micro-batch: one at a time, only what changed."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def timed(events: DataFrame) -> DataFrame:
    """Events with ``ts`` as a timestamp with time zone, as watermarks need it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; works on streams and on tables."""
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    out = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    out = e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: bursts of events with pauses shorter than the gap (Spark's own windows also join over a pause as long as it)."""
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    out = e.groupBy("user_id", F.session_window("ts", f"{gap} -1 microseconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    end = F.col("w.end") + F.expr("interval 1 microsecond")
    return out.select("user_id", F.col("w.start").alias("start"), end.alias("end"), "n", "total")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows as a table.

    The executors write the rows into a folder of the checkpoint, a folder a
    batch (one for all in complete mode); none of them pass the driver.  Unless
    the session names another store, the state lies on disk as ``STATE`` says.
    """
    spark, rows = stream.sparkSession, f"{checkpoint}/rows"
    folder = spark._jvm.org.apache.hadoop.fs.Path(rows)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(rows if mode == "complete" else f"{rows}/{i}")

    writer = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    ours = {} if spark.conf.get(next(iter(STATE)), None) else {k: v for k, v in STATE.items() if spark.conf.get(k, None) is None}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        query = writer.trigger(availableNow=True).start()  # takes the settings as they are now
    finally:
        for k in ours:
            spark.conf.unset(k)
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(rows)
