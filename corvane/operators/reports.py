"""Counts, distributions and report tables (AGG-01..18, SNK-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_counts(records: DataFrame) -> DataFrame:
    """(dimension, value, n): total, by source, by polarity and by number of calls, in one pass of grouping sets."""
    r = records.select(F.coalesce("source", F.lit("none")).alias("source"), F.when(F.coalesce(F.size("function_calls"), F.lit(0)) > 0, "positive").otherwise("negative").alias("polarity"), F.greatest(F.coalesce(F.size("function_calls"), F.lit(0)), F.lit(0)).cast("string").alias("n_calls"))
    g = r.groupingSets([[], ["source"], ["polarity"], ["n_calls"]], "source", "polarity", "n_calls").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    dim = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "source").when(F.col("gid") == 5, "polarity").otherwise("n_calls")
    return g.select(dim.alias("dimension"), F.coalesce("source", "polarity", "n_calls", F.lit("all")).alias("value"), "n")


def normalize_stats(records: DataFrame) -> DataFrame:
    """Per source: rows, positives, negatives, and least, most and mean number of calls of the positives."""
    n = F.greatest(F.coalesce(F.size("function_calls"), F.lit(0)), F.lit(0))
    pos = F.when(n > 0, n)
    return records.groupBy("source").agg(F.count("*").alias("total"), F.count(pos).alias("positive"), F.count_if(n == 0).alias("negative"), F.coalesce(F.min(pos), F.lit(0)).alias("calls_min"), F.coalesce(F.max(pos), F.lit(0)).alias("calls_max"), F.round(F.coalesce(F.sum(pos), F.lit(0)) / F.greatest(F.count(pos), F.lit(1)), 2).alias("calls_mean"))


def error_breakdown(rows: DataFrame, errors: Column) -> DataFrame:
    """(prefix, n): errors by the text before the first colon."""
    return rows.select(F.explode(errors).alias("e")).groupBy(F.trim(F.substring_index("e", ":", 1)).alias("prefix")).agg(F.count("*").alias("n"))


def pass_rate(rows: DataFrame, ok: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.round(F.count_if(ok) / F.greatest(F.count("*"), F.lit(1)), 4).alias("pass_rate"))


def length_stats(rows: DataFrame, text: Column, *by: str) -> DataFrame:
    n = F.length(text)
    return rows.groupBy(*by).agg(F.count(n).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.median(n).alias("median"))


def name_frequency(calls: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent names, ties by name (a top-k report)."""
    return calls.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def histogram(rows: DataFrame, size: Column) -> DataFrame:
    return rows.groupBy(size.alias("bucket")).agg(F.count("*").alias("n"))


def id_digest(rows: DataFrame, ident: str, *by: str) -> DataFrame:
    """Digest of the set of ids that does not depend on their order (AGG-18, HSH-03).

    Sums of the SHA-256 words of each distinct id, modulo 2^61 each: combined map-side, so no set of ids is gathered."""
    d = rows.select(*by, ident).where(F.col(ident).isNotNull()).distinct()
    h = F.sha2(F.col(ident).cast("string"), 256)
    word = lambda i: F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *[word(i).cast("string") for i in range(4)], F.count("*").cast("string")), 256).alias("digest"))


def pivot_report(rows: DataFrame, row: str, column: str, values: list[str], cell: Column) -> DataFrame:
    """row x column table of texts, '-' where there is none (SNK-09)."""
    p = rows.groupBy(row).pivot(column, values).agg(F.max(cell))
    return p.select(row, *[F.coalesce(F.col(v), F.lit("-")).alias(v) for v in values])


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a Markdown table; a table of more than ``limit`` rows is no report and raises."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda xs: "| " + " | ".join("-" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)])


def rescaled(c: Column) -> Column:
    """Shares up to 1 as percentages with two places; larger values as they are (PRJ-11)."""
    return F.when(c <= 1.0, F.round(c * 100, 2)).otherwise(c)
