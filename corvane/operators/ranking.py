"""Row numbers over whole tables or hot groups without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.session import cut


def ranked(df: DataFrame, order: list[str], part: str | None = None, name: str = "rank") -> DataFrame:
    """df with name: 1, 2, 3, ... by the columns of order, within part if given.

    The rows are range-partitioned by (part, order) and sorted within their partitions; a row's number is its place
    there plus the number of rows of its part in earlier partitions, which is a table of one row for each part and
    partition. A part that holds most rows spreads over many tasks. order has to be unique within a part."""
    keys = [*([part] if part else []), *order]
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    s = cut(s.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    by = ["_part", "_pid"]
    s = s.withColumn("_part", F.col(part).cast("string") if part else F.lit(None).cast("string"))
    n = s.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_part").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.select(F.col("_part").alias("_p"), F.col("_pid").alias("_q"), (before - F.col("_first") + 1).alias("_shift"))
    j = s.join(F.broadcast(n), F.col("_part").eqNullSafe(F.col("_p")) & (F.col("_pid") == F.col("_q")))
    return j.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def group_sizes(df: DataFrame, part: str | None, name: str = "n") -> DataFrame:
    """df with the number of rows of its part, by an aggregate joined back."""
    if part is None:
        return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    n = df.groupBy(F.col(part).alias("_g")).agg(F.count("*").alias(name))
    return df.join(n, F.col(part).eqNullSafe(F.col("_g"))).drop("_g")
