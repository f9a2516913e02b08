"""A store of fields that streams keep up to date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanplume.sources import fields
from fanplume.sources.shared import new_path, stored
from fanplume.streaming.hours import latest_cells

#: Hours of one chunk of a pass.
CHUNK_HOURS = 12
KEYS = [*fields.PARTS, "step"]


@dataclass(frozen=True)
class Chunk:
    """What a pass did for one chunk: how many fields it lacked, and what went wrong, if anything."""

    number: int
    fields: int
    problem: str | None = None


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def refresh(wanted: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame], now: int, hours: int = CHUNK_HOURS) -> list[Chunk]:
    """One pass over the store at `path`: the fields (source, run, variable, step) that are `wanted` from hour `now` on and
    aren't stored are fetched and added, in chunks of `hours`, soonest first over all sources.

    `fetch` makes the rows (member, cell, value) of the fields that it is given. A chunk that fails is told and passed
    over, so the next pass tries it again; chunks are added as a whole or not at all, so a pass that was cut off leaves
    nothing by halves, and a second pass finds nothing to do. Only the numbers of chunks come to the driver.
    """
    spark = wanted.sparkSession
    lacking = wanted.select(*KEYS).distinct().filter(F.col("step") >= now)
    if _there(spark, path):
        lacking = fields.missing_fields(lacking, fields.read_fields(spark, path))
    lacking = stored(lacking.withColumn("chunk", F.floor((F.col("step") - now) / hours)))
    told = []
    for r in lacking.groupBy("chunk").count().orderBy("chunk").collect():
        try:
            rows = fetch(lacking.filter(F.col("chunk") == r["chunk"]).select(*KEYS))
            rows.write.mode("append").partitionBy(*fields.PARTS).parquet(path)
            told.append(Chunk(r["chunk"], r["count"]))
        except (PySparkException, OSError, ValueError, RuntimeError) as e:
            told.append(Chunk(r["chunk"], r["count"], f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"))
    return told


def cells_as_fields(cells: DataFrame, values: tuple[str, ...] = ("v", "vmax"), run: str = "live") -> DataFrame:
    """Hourly cells as fields: the model is the source, each value a variable, the hour since 1970 the step."""
    step = F.floor(F.unix_timestamp(F.col("time").cast("timestamp")) / 3600).cast("long")
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values)))
    rows = cells.select(F.col("model").alias("source"), F.lit(run).alias("run"), step.alias("step"), F.col("member"), F.lit(0).alias("cell"), each.alias("e"))
    return rows.select("source", "run", "e.variable", "step", "member", "cell", "e.value")


def keep_up(cells: DataFrame, path: str, now: int, checkpoint: str | None = None, told: Callable[[int, list[Chunk]], None] | None = None, hours: int = CHUNK_HOURS) -> None:
    """Run what a stream of hourly cells has now into the store: each trigger is a pass over the fields that it brings. A
    trigger that is run again after a restart finds them stored."""

    def one(batch: DataFrame, number: int) -> None:
        own = stored(cells_as_fields(batch))
        done = refresh(own, path, lambda lacking: own.join(lacking, KEYS, "left_semi"), now, hours)
        if told:
            told(number, done)

    query = cells.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint or new_path(cells.sparkSession, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def newest_cells(versions: DataFrame, late: str = "2 days") -> DataFrame:
    """Of a stream of versions of cells (model, member, time, run, v, vmax, n) the newest run's, whatever the order in which
    runs and their hours arrive. The state is one row a cell, and goes once the watermark has passed its hour."""
    timed = versions.withColumn("at", F.col("time").cast("timestamp")).withWatermark("at", late)
    best = timed.groupBy("model", "member", "at").agg(F.max_by(F.struct("v", "vmax", "n"), "run").alias("own"), F.max("run").alias("run"))
    return best.select("model", "member", F.col("at").cast("timestamp_ntz").alias("time"), "own.*", "run")


def upsert(batch: DataFrame, path: str) -> None:
    """Cells into a table by day: in the days that the batch touches, each cell becomes the newest run's of both. A batch
    that comes again changes nothing."""
    spark, own = batch.sparkSession, stored(batch.withColumn("day", F.date_format("time", "yyyy-MM-dd")))
    merged = own
    if _there(spark, path):
        days = [r["day"] for r in own.select("day").distinct().collect()]  # days of one trigger
        merged = own.unionByName(spark.read.schema(own.schema).parquet(path).filter(F.col("day").isin(days)))
    rows = stored(latest_cells(merged).withColumn("day", F.date_format("time", "yyyy-MM-dd")))  # read before it is replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def keep_newest(versions: DataFrame, path: str, checkpoint: str | None = None, late: str = "2 days") -> DataFrame:
    """Run what a stream of versions has now into the table at `path`, and read that."""
    spark = versions.sparkSession
    query = newest_cells(versions, late).writeStream.outputMode("update").foreachBatch(lambda batch, _: upsert(batch, path))
    query.option("checkpointLocation", checkpoint or new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("day")
