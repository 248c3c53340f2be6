"""Row numbers like those of a window, also where one part holds nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.operators.ranking import group_sizes, ranked
from tests.fixtures import rows


@pytest.mark.parametrize("part", [None, "p"])
def test_like_a_window(spark, part):
    rnd = random.Random(1)
    k = rnd.sample(range(10_000), 900)
    df = spark.createDataFrame([(i, rnd.choice(["a"] * 9 + ["b", None]), x) for i, x in enumerate(k)], "i int, p string, k int").repartition(7)
    want = df.withColumn("rank", F.row_number().over(W.partitionBy(*([part] if part else [F.lit(0)])).orderBy("k")))
    assert rows(ranked(df, ["k"], part).select("i", "rank")) == rows(want.select("i", "rank"))
    n = rows(group_sizes(df, part).select("n").distinct())
    assert n == ([(900,)] if part is None else rows(df.groupBy("p").count().select("count").distinct()))


def test_empty(spark):
    assert ranked(spark.createDataFrame([], "i int, p string"), ["i"], "p").count() == 0
