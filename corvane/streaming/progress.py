"""Resumable incremental runs (STM-*): micro-batches, dead letters, early stop, progress keyed by id, event windows.

A run reads a source as a stream, applies a function to each micro-batch, writes successes and failures to two sinks and
keeps its place in a checkpoint folder. Progress is derived from the sinks by id, so it can't drift from them; a batch
that is replayed after a crash replaces its own output (one folder per batch), so both sinks stay free of repeats.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.ranking import ranked


class StreakStop(Exception):
    """Raised inside a batch to end a run after too many failures."""


METRICS = "batch_id long, n_rows long, n_ok long, n_failed long, seconds double, rows_per_second double"


def throughput(rows: int, seconds: float) -> float:
    """Rows a second; 0 where no time passed (MTH-07)."""
    return round(rows / seconds, 4) if seconds > 0 else 0.0


def longest_streak(done: DataFrame, order: str, before: int = 0) -> tuple[int, int]:
    """(longest, last): the longest run of rows with an error in the order of a unique column, with ``before`` failures
    ahead of the first row, and the run at the end.

    A failure's number among all rows less its number among failures tells its run; both numbers come from sorted
    partitions, so no task holds the batch."""
    rows = ranked(done.select(F.col(order).alias("o"), F.col("error").isNotNull().alias("bad")), ["o"], None, "k")
    n = rows.count()
    bad = ranked(rows.where("bad").select("o", "k"), ["o"], None, "j")
    runs = bad.groupBy((F.col("k") - F.col("j")).alias("run")).agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))
    whole = F.col("n") + F.when(F.col("first") == 1, F.lit(before)).otherwise(0)
    r = runs.agg(F.max(whole).alias("longest"), F.max(F.when(F.col("last") == n, whole)).alias("last")).first()
    return r["longest"] or 0, (r["last"] or 0) if n else before


def counted_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with batch: ``size`` consecutive rows by order each, the last batch may be smaller (STM-02)."""
    r = ranked(rows, [order], None, "_rn")
    return r.withColumn("batch", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def run_metrics(spark: SparkSession, out: str) -> DataFrame:
    """One row over the batches of a run: batches, rows, failures, seconds and rows a second (STM-09)."""
    m = spark.read.parquet(f"{out}/metrics")
    return m.agg(F.count("*").alias("n_batches"), F.sum("n_rows").alias("n_rows"), F.sum("n_failed").alias("n_failed"), F.round(F.sum("seconds"), 4).alias("seconds"), F.round(F.coalesce(F.sum("n_rows") / F.nullif(F.sum("seconds"), F.lit(0.0)), F.lit(0.0)), 4).alias("rows_per_second"))


def run_batches(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, stop_rate: float | None = None, stop_streak: int | None = None, order: str | None = None) -> bool:
    """Process all that is new in source and return whether it ran to the end.

    work gives each row an ``error`` column; rows without one go to out/ok, the others to out/failed, then ``after``
    may enrich the batch: its failure is recorded in out/notes and undoes nothing. stop_rate ends the run after a batch
    in which that share of rows failed, stop_streak after one in which so many rows failed in a row by ``order``, runs
    from the batch before included; the batch itself is kept whole. out/metrics has one row for each batch."""
    streak = 0  # failures at the end of what was processed so far

    def step(batch: DataFrame, n: int) -> None:
        nonlocal streak
        began, done = time.time(), work(batch).persist()
        try:
            done.where("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/ok/batch={n}")
            done.where("error is not null").write.mode("overwrite").parquet(f"{out}/failed/batch={n}")
            if after:
                try:
                    after(done, n)
                except Exception as e:  # noqa: BLE001 - enrichment must not undo the batch
                    batch.sparkSession.createDataFrame([(n, str(e))], "batch long, note string").write.mode("overwrite").parquet(f"{out}/notes/batch={n}")
            r = done.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
            took = time.time() - began
            batch.sparkSession.createDataFrame([(n, r["n"], r["n"] - r["bad"], r["bad"], took, throughput(r["n"], took))], METRICS).write.mode("overwrite").parquet(f"{out}/metrics/batch={n}")
            if stop_rate is not None and r["n"] and r["bad"] / r["n"] >= stop_rate:
                raise StreakStop(f"batch {n}: {r['bad']} of {r['n']} failed")
            if stop_streak is not None:
                longest, streak = longest_streak(done, order, streak)
                if longest >= stop_streak:
                    raise StreakStop(f"batch {n}: {longest} failures in a row")
        finally:
            done.unpersist()

    q = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception as e:  # noqa: BLE001
        if "StreakStop" not in str(e):
            raise
        return False
    return True


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder, or one file of a folder, as a stream."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    folder, glob = (path, "*.parquet") if whole else (p.getParent().toString(), p.getName())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def progress(spark: SparkSession, todo: DataFrame, out: str, key: str) -> DataFrame:
    """One row: done, failed and pending rows of todo by key."""

    def sink(name: str) -> DataFrame:
        try:
            return spark.read.parquet(f"{out}/{name}").select(key).distinct()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return todo.select(key).limit(0)  # nothing was written yet

    j = todo.select(key).distinct().join(sink("ok").withColumn("o", F.lit(1)), key, "left").join(sink("failed").withColumn("f", F.lit(1)), key, "left")
    return j.agg(F.count("o").alias("done"), F.count_if(F.col("o").isNull() & F.col("f").isNotNull()).alias("failed"), F.count_if(F.col("o").isNull() & F.col("f").isNull()).alias("pending"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; with ``late`` on a stream, rows later than that are left out."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w, by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, user: str = "user_id", time: str = "ts") -> DataFrame:
    """(user, start, n) of the sessions of each user: events less than gap apart."""
    return events.groupBy(user, F.session_window(time, gap)).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), "n")


def without_repeats(events: DataFrame, keys: list[str], late: str, time: str = "ts") -> DataFrame:
    """A stream without repeated keys within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
