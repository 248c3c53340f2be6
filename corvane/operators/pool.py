"""Tool catalogues (AGG-04, AGG-08, AGG-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.records import name_key


def merge_pool(tools: DataFrame, order: str, filled: Column) -> DataFrame:
    """One row for each name: the first name as it is written, the first non-empty description, the first parameters
    that hold something (else the first). One aggregate, no window."""
    t = tools.withColumn("key", name_key(F.col("name"))).where("key <> ''").withColumn("full", F.coalesce(filled, F.lit(False)))
    blank = F.coalesce(F.trim("description"), F.lit("")) == ""
    return t.groupBy("key").agg(
        F.min_by("name", order).alias("name"),
        F.coalesce(F.min_by(F.when(~blank, F.col("description")), F.when(~blank, F.col(order))), F.lit("")).alias("description"),
        F.coalesce(F.min_by(F.when(F.col("full"), F.col("parameters")), F.when(F.col("full"), F.col(order))), F.min_by("parameters", order)).alias("parameters"),
        F.count("*").alias("n"),
    )


def category_counts(pool: DataFrame, category: str, default: str = "Khác") -> DataFrame:
    c = F.coalesce(category, F.lit(default))
    return pool.groupBy(c.alias("category")).agg(F.count("*").alias("n_rows"), F.count_distinct(name_key(F.col("name"))).alias("n_names"))


def coverage(used: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: names with a cached category and names that fall back to the default (AGG-08)."""
    u = used.select("name").distinct().join(cache.select("name", "category").distinct(), "name", "left")
    return u.agg(F.count_if(F.col("category").isNotNull()).alias("n_cached"), F.count_if(F.col("category").isNull()).alias("n_fallback"))
