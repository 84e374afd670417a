"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mask_token
from ..session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, as a table of Parquet files.

    State and progress are kept in the shared folder, each micro-batch is
    written to a folder of its own, so one that runs again replaces itself.
    In complete mode the last batch is the table.
    """
    spark, at = stream.sparkSession, shared_folder(stream.sparkSession, name)
    batches: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/{batch}")
        batches.append(batch)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    wanted = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{at}/out/{b}" for b in wanted])


def token_store(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """(database, token, created, expires, uses): lives of tokens. A use within
    ``ttl`` of the last one extends the entry, one after that finds it expired
    and starts another. Uses are put together by their own time, so the
    result doesn't depend on how they come in batches; complete mode."""
    used = events.withWatermark("ts", ttl).select(F.col("user_id").alias("database"), mask_token(F.col("event_type"), F.col("user_id").cast("string")).alias("token"), "ts")
    lives = used.groupBy(F.session_window("ts", ttl).alias("w"), "database", "token").agg(F.count("*").alias("uses"))
    return lives.select("database", "token", F.col("w.start").alias("created"), F.col("w.end").alias("expires"), "uses")


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type in windows of ``width`` (an addition of ours)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_calls(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Calls answered once: replays of a call within ``ttl`` are dropped."""
    calls = events.withWatermark("ts", ttl).select((F.col("event_id") % 500).alias("call_id"), "ts")
    return calls.dropDuplicatesWithinWatermark(["call_id"]).select("call_id")
