"""Micro-batch runs: resume, dead letters, enrichment that fails, early stop."""

from pyspark.sql import functions as F

from corvane.streaming import progress as S


def write(spark, path, name, values):
    spark.createDataFrame([(v,) for v in values], "id long").coalesce(1).write.mode("append").parquet(path)


def work(b):
    return b.withColumn("error", F.when(F.col("id") % 5 == 0, "five: no"))


def test_resume_and_dead_letters(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    write(spark, src, "a", range(10))
    assert S.run_batches(S.stream_table(spark, src), work, out, state)
    assert tuple(S.progress(spark, spark.read.parquet(src), out, "id").first()) == (8, 2, 0)
    write(spark, src, "b", range(10, 15))
    assert tuple(S.progress(spark, spark.read.parquet(src), out, "id").first()) == (8, 2, 5)

    def after(batch, n):
        raise RuntimeError("enrichment is down")

    assert S.run_batches(S.stream_table(spark, src), work, out, state, after)
    assert tuple(S.progress(spark, spark.read.parquet(src), out, "id").first()) == (12, 3, 0)
    assert spark.read.parquet(f"{out}/notes").count() == 1
    assert spark.read.parquet(f"{out}/ok").count() == 12


def test_early_stop_keeps_its_batch(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    write(spark, src, "a", [5, 10, 1])
    assert not S.run_batches(S.stream_table(spark, src), work, out, state, stop_rate=0.5)
    assert spark.read.parquet(f"{out}/failed").count() == 2 and spark.read.parquet(f"{out}/ok").count() == 1


def test_nothing_done_yet(spark, tmp_path):
    todo = spark.createDataFrame([(1,)], "id long")
    assert tuple(S.progress(spark, todo, str(tmp_path / "none"), "id").first()) == (0, 0, 1)


def test_streaks(spark):
    def streak(flags, before=0):
        df = spark.createDataFrame([(i, "e" if f else None) for i, f in enumerate(flags)], "id long, error string")
        return S.longest_streak(df, "id", before)

    assert streak([1, 1, 0, 1]) == (2, 1)
    assert streak([1, 1, 0, 1], before=3) == (5, 1)
    assert streak([0, 1, 1, 1], before=3) == (3, 3)
    assert streak([1, 1], before=4) == (6, 6)
    assert streak([0, 0]) == (0, 0)
    assert streak([], before=2) == (0, 2)


def test_streak_stops_and_metrics_add_up(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    write(spark, src, "a", [1, 2, 3, 5])
    write(spark, src, "b", [10, 15, 16, 17])
    q = S.stream_table(spark, src, files_per_batch=2)
    bad = lambda b: b.withColumn("error", F.when(F.col("id").isin(5, 10, 15), "no"))
    assert not S.run_batches(q, bad, out, state, stop_streak=3, order="id")
    m = S.run_metrics(spark, out).first()
    assert (m["n_rows"], m["n_failed"]) == (8, 3) and m["rows_per_second"] > 0
    assert S.throughput(10, 0) == 0.0 and S.throughput(10, 4) == 2.5


def test_counted_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "id long")
    got = S.counted_batches(df, "id", 10).groupBy("batch").count().orderBy("batch").collect()
    assert [(r["batch"], r["count"]) for r in got] == [(0, 10), (1, 10), (2, 5)]
