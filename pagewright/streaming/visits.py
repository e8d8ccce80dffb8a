"""Visit logs as streams: windows with watermarks, sessions, upserts and exactly-once items.

The queries read a finished table to its end (``availableNow``) and return what the stream left; a deployment starts
the same transformations with a trigger of its own and a lasting checkpoint.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.plans.stages import stage_path

#: Late rows are waited for so long; beyond it they are dropped and their state is released.
LATE_EVENTS = "2 days"
LATE_ITEMS = "60 days"
GAP = "6 hours"


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream. A stream reads folders: a table of one file is its folder's file of that name."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def _finished(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """The result of a stream over what is there now, written to the shared folder."""
    spark = stream.sparkSession
    base = stage_path(spark, f"stream-{name}")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def sessions(events: DataFrame, hours: int = 6) -> DataFrame:
    """(user_id, first, last, visits): runs of visits less than ``hours`` apart."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) >= F.expr(f"INTERVAL '{hours}' HOUR"), F.lit(True))
    e = events.select("user_id", "event_id", "ts").withColumn("new", new.cast("int"))
    e = e.withColumn("s", F.sum("new").over(w))
    return e.groupBy("user_id", "s").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("visits")).drop("s")


def session_windows(events: DataFrame) -> DataFrame:
    """The same as a stream's aggregate; ``events`` may be a stream. Sessions come out once the watermark has passed
    their end, and their state is released."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE_EVENTS)
    s = e.groupBy("user_id", F.session_window("at", GAP).alias("w")).agg(F.count("*").alias("visits"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first"), (F.col("w.end") - F.expr(f"INTERVAL {GAP}")).cast("timestamp_ntz").alias("last"), "visits")


def session_stream(spark: SparkSession, path: str) -> DataFrame:
    """The sessions that are over for sure: those that the watermark has passed."""
    return _finished(session_windows(_source(spark, path)), "append", "sessions")


def daily(events: DataFrame) -> DataFrame:
    windowed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE_EVENTS).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("visits"))
    return windowed.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "visits")


def daily_stream(spark: SparkSession, path: str) -> DataFrame:
    # each batch writes the windows that it changed; those behind the watermark are released
    out = _finished(daily(_source(spark, path)), "update", "daily")
    return out.groupBy("day", "event_type").agg(F.max_by("visits", "batch").alias("visits"))


def history(events: DataFrame) -> DataFrame:
    """(user_id, kind, target, last, visits), keyed state of a visit log."""
    e = events.withColumn("target", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("user_id", F.col("event_type").alias("kind"), "target").agg(F.max("ts").alias("last"), F.count("*").alias("visits"))


def history_stream(spark: SparkSession, path: str) -> DataFrame:
    """A history has no end, so a state for each of its keys would grow for ever: each batch is aggregated by itself and
    written under its number (a repeated batch replaces itself), and the batches of a key meet when they are read."""
    base = stage_path(spark, "stream-history")

    def append(batch: DataFrame, batch_id: int) -> None:
        history(batch).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = _source(spark, path).writeStream.foreachBatch(append).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.parquet(f"{base}/out")
    return parts.groupBy("user_id", "kind", "target").agg(F.max("last").alias("last"), F.sum("visits").alias("visits"))


def unique_items(items: DataFrame) -> DataFrame:
    """Items once, however often and late they are delivered within the watermark."""
    return items.withWatermark("synced_at", LATE_ITEMS).dropDuplicatesWithinWatermark(["item_id"])


def unique_stream(spark: SparkSession, path: str) -> DataFrame:
    return _finished(unique_items(_source(spark, path)).select("item_id", "profile_id", "kind", "target"), "append", "items")
