"""Pairs of parallel rows, lookups and positional joins (JOI-*, SET-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.operators.ranking import ranked
from corvane.operators.records import identifier_integrity, names, tool_shape

BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; otherwise the join is left to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def main_language(c: Column) -> Column:
    """'en', 'vi' or null of a label in any case, of two or three letters, with or without region."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^(en|eng)([-_]|$)"), "en").when(low.rlike("^(vi|vie)([-_]|$)"), "vi")


def one_per_id(records: DataFrame, lang: str) -> DataFrame:
    """The row of the least rid of each id in one language."""
    by = W.partitionBy("id").orderBy("rid")
    r = records.where((main_language(F.col("language")) == lang) & F.col("id").isNotNull())
    return r.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def pair_completeness(en: DataFrame, vi: DataFrame) -> DataFrame:
    """One row: ids on both sides, only in English, only in Vietnamese (one full outer join)."""
    j = en.select("id", F.lit(1).alias("e")).join(vi.select("id", F.lit(1).alias("v")), "id", "full_outer")
    return j.agg(F.count_if(F.expr("e = 1 and v = 1")).alias("n_pairs"), F.count_if(F.col("v").isNull()).alias("missing_vi"), F.count_if(F.col("e").isNull()).alias("missing_en"))


def pairs(en: DataFrame, vi: DataFrame) -> DataFrame:
    """(id, en, vi): the records of both languages as structs."""
    wrap = lambda df, n: df.select("id", F.struct(*df.columns).alias(n))
    return wrap(en, "en").join(wrap(vi, "vi"), "id")


def pair_checks(p: DataFrame) -> DataFrame:
    """(id, same_source, same_polarity, same_calls, same_tools) of each pair; calls and tools by their names alone."""
    calls = names(F.col("en.function_calls")).eqNullSafe(names(F.col("vi.function_calls")))
    return _checks(p, calls, F.array_sort(names(F.col("en.tools"))).eqNullSafe(F.array_sort(names(F.col("vi.tools")))))


def pair_shapes(p: DataFrame) -> DataFrame:
    """pair_checks by shape (JOI-01): calls by name and argument keys in call order, tools by name and schema shape."""
    return _checks(p, identifier_integrity(F.col("en.function_calls"), F.col("vi.function_calls")), tool_shape(F.col("en.tools")).eqNullSafe(tool_shape(F.col("vi.tools"))))


def _checks(p: DataFrame, same_calls: Column, same_tools: Column) -> DataFrame:
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return p.select(
        "id",
        F.col("en.source").eqNullSafe(F.col("vi.source")).alias("same_source"),
        (some(F.col("en.function_calls")) == some(F.col("vi.function_calls"))).alias("same_polarity"),
        same_calls.alias("same_calls"),
        same_tools.alias("same_tools"),
    )


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of the keys that occur more than once (JOI-02)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def positional(left: DataFrame, right: DataFrame, lorder: str, rorder: str, part: str | None = None) -> DataFrame:
    """The k-th row of either side joined; it stops at the shorter one. Within part, if given. Orders are unique."""
    keys = [part] if part else []
    return ranked(left, [lorder], part, "k").join(ranked(right, [rorder], part, "k"), [*keys, "k"])


def without_failed(source: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose index is not among the failed ones (SRC-05); null indices fail nothing."""
    return source.join(failed.select(*keys).dropna().distinct(), keys, "left_anti")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet (JOI-08)."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def with_category(tools: DataFrame, cache: DataFrame, default: str = "Khác") -> DataFrame:
    """tools with the category of their name, the default where there is none (JOI-05, MAP-02)."""
    return tools.join(small(cache), "name", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def conformance(rows: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """One row: keys that only the files or only the manifest have, keys whose split differs (JOI-10)."""
    a, b = rows.select(key, F.col("split").alias("got")).distinct(), manifest.select(key, F.col("split").alias("want"))
    j = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), key, "full_outer")
    return j.agg(F.count_if(F.col("b").isNull()).alias("not_in_manifest"), F.count_if(F.col("a").isNull()).alias("not_in_files"), F.count_if(F.expr("a = 1 and b = 1 and not (got <=> want)")).alias("other_split"))


def with_gold_schema(candidates: DataFrame, own: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates with the schema of the sample's own tool, else that of the pool (JOI-11)."""
    return candidates.join(own.withColumnRenamed("parameters", "own"), ["rid", "name"], "left").join(pool.withColumnRenamed("parameters", "pooled"), "name", "left").withColumn("parameters", F.coalesce("own", "pooled")).drop("own", "pooled")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many distinct keys only a has, only b has (SET-01)."""
    a, b = a.distinct(), b.distinct()
    return a.join(b, a.columns, "left_anti").agg(F.count("*").alias("only_a")).crossJoin(b.join(a, a.columns, "left_anti").agg(F.count("*").alias("only_b")))
