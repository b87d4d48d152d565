"""Streaming forms of the counting jobs; each gives what its batch form gives when all input has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(df: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there and give the result table. Executors write it to the shared folder, where the state lies, too;
    no rows pass through the driver. For tests and reports; jobs write to a sink of their own."""
    spark, out, done = df.sparkSession, scratch(df.sparkSession, "stream"), {}

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{number}")
        done[number] = f"{out}/{number}"

    writer = df.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or scratch(spark, "state")).start().awaitTermination()
    paths = [done[max(done)]] if done and mode == "complete" else list(done.values())  # a complete table replaces the one before
    return spark.read.schema(df.schema).parquet(*paths) if paths else spark.createDataFrame([], df.schema)


def timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time with a zone; times without one are taken in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts by window of event time; with late, windows close when the watermark has passed."""
    rows = timed(events, ts).withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, user: str, late: str) -> DataFrame:
    out = timed(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark."""
    return timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
