"""The store of fields: Parquet by source, run and variable, with its reports and its upkeep."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = ["source", "run", "variable"]
#: Seconds for which a run that failed isn't tried again, and runs that are tried for one answer.
REST, TRIES = 300, 3


def write_fields(fields: DataFrame, path: str) -> None:
    """Fields (source, run, variable, step, member, cell, value) as Parquet partitions; those written again replace the old ones."""
    fields.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """Filters on source, run and variable choose folders; those on step and cell reach the files."""
    return spark.read.parquet(path)


def kept_runs(fields: DataFrame, newest: int = 2) -> DataFrame:
    """The newest runs of each source: what eviction leaves."""
    runs = fields.select("source", "run").distinct()
    return runs.withColumn("__n", F.dense_rank().over(Window.partitionBy("source").orderBy(F.desc("run")))).filter(F.col("__n") <= newest).drop("__n")


def missing_fields(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """The fields (source, run, variable, step) that are wanted and not stored."""
    return wanted.join(stored.select(*PARTS, "step").distinct(), [*PARTS, "step"], "left_anti")


def cached_until(stored: DataFrame, by: list[str], every: int, start: int = 0) -> DataFrame:
    """The last step of each group that is stored without a gap from `start` on; missing if `start` isn't there."""
    w = Window.partitionBy(*by).orderBy("step")
    steps = stored.select(*by, "step").distinct().filter(F.col("step") >= start)
    whole = steps.withColumn("__k", F.row_number().over(w) - 1).withColumn("__ok", F.col("step") == start + F.col("__k") * every)
    return whole.groupBy(*by).agg(F.max(F.when(F.col("__ok"), F.col("step"))).alias("until"))


def evict(spark: SparkSession, path: str, newest: int = 2, writing: list[tuple] = ()) -> list[str]:
    """Delete the folders of all runs but the newest ones of each source, and but those (source, run) being written.

    Runs are compared as the text that their folders are named by, and nothing else is looked at. Returns what was deleted.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [x.getPath() for x in fs.globStatus(hadoop(path, "source=*/run=*"))]
    if not folders:
        return []
    named = [(unquote(f.getParent().getName().split("=", 1)[1]), unquote(f.getName().split("=", 1)[1]), f.toString()) for f in folders]
    kept = {(str(a), str(b)) for a, b in writing}
    for own in {source for source, _, _ in named}:
        kept |= {(own, run) for run in sorted({r for s, r, _ in named if s == own}, reverse=True)[:newest]}
    gone = [f for source, run, f in named if (source, run) not in kept]
    for f in gone:
        fs.delete(hadoop(f), True)
    return gone


def runs_to_try(runs: DataFrame, failures: DataFrame, now: float, rest: float = REST, tries: int = TRIES) -> DataFrame:
    """The newest runs (source, run) of each source in the order they are to be tried (`turn` from 1), without those that
    `failures` (source, run, at in seconds) says failed less than `rest` seconds ago."""
    resting = failures.filter((now - F.col("at") >= 0) & (now - F.col("at") < rest)).select("source", "run").distinct()
    ready = runs.select("source", "run").distinct().join(resting, ["source", "run"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("run")))
    return ready.withColumn("turn", turn).filter(F.col("turn") <= tries)


def first_usable(turns: DataFrame, stored: DataFrame) -> DataFrame:
    """Of each source the first run in turn that has any fields, and how many newer ones were passed over; sources
    without one have a missing run."""
    there = turns.join(stored.select("source", "run").distinct(), ["source", "run"], "left_semi")
    best = there.groupBy("source").agg(F.min_by("run", "turn").alias("run"), (F.min("turn") - 1).alias("passed_over"))
    return turns.select("source").distinct().join(best, "source", "left")


def available_variables(stored: DataFrame, needs: dict[str, list[str]], steps: list[int]) -> DataFrame:
    """For each run (source, run) and each derived variable (name) whether every parameter that it is made of is stored at
    every wanted step, and which are `lost`, joined by commas.

    A parameter that is missing at a step makes only the variables that need it unavailable.
    """
    had = F.collect_set(F.when(F.col("whole"), F.col("variable")))
    steps = sorted(set(steps))
    of_run = stored.groupBy(*PARTS).agg((F.count_distinct(F.when(F.col("step").isin(steps), F.col("step"))) == len(steps)).alias("whole"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, sorted(set(own)))).alias("made_of")) for name, own in needs.items()))
    rows = of_run.groupBy("source", "run").agg(had.alias("had")).select("source", "run", "had", F.explode(wanted).alias("w"))
    lost = F.array_except("w.made_of", "had")
    return rows.select("source", "run", "w.name", (F.size(lost) == 0).alias("available"), F.array_join(lost, ",").alias("lost"))


def levels(derivations: dict[str, list[list[str]]]) -> int:
    """Rounds after which nothing more can be derived, whatever is there at first: every round adds a name or is the last."""
    found, rounds = {n for own in derivations.values() for needs in own for n in needs} - set(derivations), 0
    while new := {n for n, own in derivations.items() if n not in found and any(set(needs) <= found for needs in own)}:
        found, rounds = found | new, rounds + 1
    return max(rounds, len(derivations) if set(derivations) - found else 0)


def derivable(stored: DataFrame, derivations: dict[str, list[list[str]]], by: list[str] = PARTS[:2]) -> DataFrame:
    """Everything that each run (columns `by`) has or can make: name and `level`, 0 for what is stored, else the round of
    derivations in which it can be made first.

    `derivations` names what can be made and the sets of names that each of its ways needs, stored or made in turn; a
    few dozen. A run's stored names are gathered once, and the closure is a fold over that row, of as many rounds
    as the graph of derivations has levels, so there is no join and no loop of jobs.
    """
    kind = "array<struct<name: string, level: int>>"
    had = stored.groupBy(*by).agg(F.collect_set(F.col("variable").cast("string")).alias("names"))
    ways = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, sorted(set(needs)))).alias("needs")) for name, own in derivations.items() for needs in own))

    def more(found: Column, level: Column) -> Column:
        names = F.transform(found, lambda f: f["name"])
        fits = lambda w: ~F.array_contains(names, w["name"]) & (F.size(F.array_except(w["needs"], names)) == 0)
        new = F.array_distinct(F.transform(F.filter(ways, fits), lambda w: F.struct(w["name"].alias("name"), level.alias("level"))))
        return F.concat(found, new).cast(kind)

    start = F.transform("names", lambda n: F.struct(n.alias("name"), F.lit(0).alias("level"))).cast(kind)
    rounds = levels(derivations)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, more) if rounds else start
    return had.select(*by, F.explode(found).alias("f")).select(*by, "f.name", "f.level")


def gather(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """The rows of all sources that can be read, with their name as `source`, and what is wrong with the others.

    A source fails when its frame can't be made or its plan can't be resolved, such as a folder that isn't there; that
    is reported and not fatal, unless no source is left. Errors inside later jobs are Spark's, which tries tasks again.
    """
    read, problems = [], {}
    for name, make in sources.items():
        try:
            df = make()
            df.schema  # noqa: B018  (resolves the plan)
            read.append(df.withColumn("source", F.lit(name)))
        except (PySparkException, ValueError, OSError) as e:
            problems[name] = f"failed ({type(e).__name__})"
    if not read:
        raise ValueError("no source could be read: " + "; ".join(f"{k}: {v}" for k, v in problems.items()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read), problems
