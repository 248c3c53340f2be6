"""Queries over events: JSON properties, windows, micro-batches; and orders with their lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import reports
from corvane.plans.common import Query, on
from corvane.session import shared_dir
from corvane.streaming import progress as S


def _props(e: DataFrame) -> DataFrame:
    """(key, n, n_values) of the members of the JSON properties."""
    m = F.try_variant_get(F.try_parse_json("props"), "$", "map<string, string>")
    return e.select(F.explode(m).alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """A resumable run over the events: negative or missing values are failures; a second start finds nothing to do."""
    path, out = f"{d}/events.parquet", f"{shared_dir(spark)}/corvane-run-{uuid.uuid4().hex}"
    work = lambda b: b.withColumn("error", F.when(F.coalesce(F.col("value"), F.lit(-1.0)) < 0, "value: missing or negative"))
    for _ in range(2):
        S.run_batches(S.stream_table(spark, path), work, f"{out}/data", f"{out}/state")
    return S.progress(spark, spark.read.parquet(path), f"{out}/data", "event_id")


def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows computed incrementally, as a file stream with a watermark and the complete result of all windows."""
    name, out = f"w{uuid.uuid4().hex}", f"{shared_dir(spark)}/corvane-run-{uuid.uuid4().hex}"
    agg = S.windowed(S.stream_table(spark, f"{d}/events.parquet"), "1 hour", late="2 hours")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{name}")

    q = agg.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/{name}").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _lines(o: DataFrame, li: DataFrame) -> DataFrame:
    """Orders by number of lines: counts per order are combined before they meet the orders."""
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    j = o.select("o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return reports.histogram(j, F.coalesce("n_lines", F.lit(0)))


def queries() -> dict[str, Query]:
    ev = on("events")
    return {
        "json_props_profile": ev(_props),
        "event_windows": ev(lambda e: S.windowed(e, "1 hour")),
        "event_sliding_windows": ev(lambda e: S.windowed(e, "1 hour", "30 minutes")),
        "event_sessions": ev(lambda e: S.sessions(e, "30 minutes").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))),
        "event_windows_stream": _stream_windows,
        "microbatch_progress": _batches,
        "lines_per_order": on("orders", "lineitem")(_lines),
    }


def oracle_sql() -> dict[str, str]:
    hourly = "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"
    return {
        "json_props_profile": "SELECT key, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value) GROUP BY key",
        "event_windows": hourly,
        "event_windows_stream": hourly,
        "event_sliding_windows": """SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '30 minutes' AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k) WHERE ts IS NOT NULL) GROUP BY 1, 2""",
        "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
        "microbatch_progress": "SELECT count(DISTINCT event_id) FILTER (WHERE value >= 0) AS done, count(DISTINCT event_id) FILTER (WHERE value IS NULL OR value < 0) AS failed, CAST(0 AS BIGINT) AS pending FROM events",
        "lines_per_order": "SELECT coalesce(n, 0) AS bucket, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1",
    }
