"""Structured Streaming: windowed request counts, content dedupe and file ingestion.

Each flow is a stream that reads what is there, stops, and gives its table. With a folder for its table and state, a run
reads only what came since the last one there; without, each run starts in a new folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.sources.scratch import scratch
from heronlake.streaming.dedupe import Seen


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream over a table that is a folder of files or a single file."""
    path = f"{folder}/{table}.parquet"
    there = spark.read.parquet(path)
    stream = spark.readStream.schema(there.schema)
    if [f.rsplit("/", 1)[-1] for f in there.inputFiles()] == [f"{table}.parquet"]:
        return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return stream.parquet(path)


def places(spark: SparkSession, name: str, folder: str | None) -> tuple[str, str]:
    """The folders of a flow's table and state."""
    base = folder or scratch(spark, name)
    return f"{base}/rows", f"{base}/state"


def drained(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Append the stream's rows to a Parquet table until its input is used up; the table."""
    spark = stream.sparkSession
    out, state = places(spark, name, folder)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def window_counts(spark: SparkSession, folder: str, table: str = "events", kept: str | None = None) -> DataFrame:
    """(event_type, ts_hour, n): counts by hour. Each trigger writes the windows that it changed, and the last write counts.

    Rows that come an hour after the watermark are dropped, so the state holds few hours.
    """
    rows = source(spark, folder, table).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    counted = rows.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    out, state = places(spark, "counts", kept)

    def write(batch: DataFrame, number: int) -> None:
        batch.select("event_type", F.col("w.start").alias("h"), "n", F.lit(number).alias("number")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out).groupBy("event_type", "h").agg(F.max_by("n", "number").alias("n"))
    return found.select("event_type", F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("ts_hour"), "n")


def content_hashes(spark: SparkSession, folder: str, table: str = "documents", kept: str | None = None, digits: int = 1) -> DataFrame:
    """Each content's hash once, however often it comes; see :class:`heronlake.streaming.dedupe.Seen`."""
    hashed = source(spark, folder, table).select(F.sha2("text", 256).alias("content_hash"))
    out, state = places(spark, "hashes", kept)
    seen = Seen(spark, out, digits)
    hashed.writeStream.foreachBatch(seen.add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return seen.hashes()


def ingest(spark: SparkSession, folder: str, table: str = "documents", kept: str | None = None) -> DataFrame:
    return drained(source(spark, folder, table).select("doc_id", F.length("text").alias("n")), "ingest", kept)
