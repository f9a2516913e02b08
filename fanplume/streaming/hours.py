"""Cells of the event cube kept up to date by a stream of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanplume.sources.shared import new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int | None = None) -> DataFrame:
    """New event files: those of this name in a folder, or the part files of a folder of this name.

    What is there at the start is one trigger, whatever the order of its files, so none of it is late; with
    `per_trigger` it comes so many files at a time, by their age.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    status = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path)
    at, files = (f"{folder}/{name}", "*.parquet") if status.isDirectory() else (folder, name)
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", files)
    return (stream.option("maxFilesPerTrigger", per_trigger) if per_trigger else stream).parquet(at)


def hourly_cells(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Mean, greatest and number of values by model, member and hour. Events later than `late` are dropped; an hour
    is final, and its state goes, once the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    hours = timed.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 10).alias("member"), F.window("at", "1 hour"))
    cells = hours.agg(F.avg("value").alias("v"), F.max("value").alias("vmax"), F.count(F.lit(1)).alias("n"))
    return cells.select("model", "member", F.col("window.start").cast("timestamp_ntz").alias("time"), "v", "vmax", "n")


def run_available(cells: DataFrame, spark: SparkSession) -> DataFrame:
    """Process what is there now: final hours go to a Parquet table, with the stream's checkpoint beside it."""
    out, state = new_path(spark, "cells"), new_path(spark, "stream")
    query = cells.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(cells.schema).parquet(out)


def latest_cells(versions: DataFrame) -> DataFrame:
    """Of cells that several runs deliver, those of the newest run (column run)."""
    best = F.max_by(F.struct("v", "vmax", "n"), "run").alias("own")
    return versions.groupBy("model", "member", "time").agg(best, F.max("run").alias("run")).select("model", "member", "time", "own.*", "run")
