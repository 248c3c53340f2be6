"""Queries over a whole build."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans import build
from corvane.plans.common import Query
from corvane.session import shared_dir, table
from corvane.sources import sinks


def _revision(spark: SparkSession, d: str) -> build.Revision:
    return build.plan(spark, table(spark, d, "records"), table(spark, d, "tool_pool"))


def _split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _revision(spark, d).rows.groupBy("language", "source", "has_tool_call", "split").agg(F.count("*").alias("n"))


def _stages(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs each stage leaves out, and why."""
    return _revision(spark, d).rejected.groupBy("stage", F.substring_index("reason", ";", 1).alias("reason")).agg(F.count("*").alias("n"))


def _published(spark: SparkSession, d: str) -> DataFrame:
    """Write a revision, verify it by its manifest, and give one row for each of its tables."""
    path = f"{shared_dir(spark)}/corvane/revision-{uuid.uuid4().hex}"
    build.write(spark, _revision(spark, d), path)
    broken = build.verify(spark, path).count()
    m = spark.read.parquet(f"{path}/manifest")
    return m.groupBy(F.regexp_extract("path", "^([^/]+)", 1).alias("part")).agg((F.sum("bytes") > 0).alias("written"), F.lit(broken).cast("long").alias("n_broken"))


def queries() -> dict[str, Query]:
    return {
        "build_revision": lambda s, d: _revision(s, d).rows.select("rid", "id", "language", "split"),
        "build_split_sizes": _split_sizes,
        "build_rejections": _stages,
        "build_checks": lambda s, d: _revision(s, d).checks,
        "build_published": _published,
        "build_tool_pool": lambda s, d: _revision(s, d).pool.select("name", "category", "n"),
        "file_manifest": lambda s, d: sinks.manifest(s, f"{d}/feature_groups.parquet").select("bytes", "sha256"),
    }


def oracle_sql() -> dict[str, str]:
    return {}
