"""Small helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.session import table

Query = Callable[[SparkSession, str], DataFrame]


def on(*names: str):
    """Turn a function of tables into a query over the tables of these names."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, d: f(*(table(spark, d, n) for n in names))

    return wrap
