"""Readers (SRC-*): strict and lenient JSON Lines, JSON arrays, archives, parts, configuration.

A line keeps its physical index, also where lines around it are blank or unreadable. The index comes from the text of
each file as a whole, cut at line breaks, for files that fit a row; ``lenient_jsonl`` takes ``offsets=True`` for larger
ones: then lines are counted per input split first and numbered from the sums, without a global sort.
"""

from __future__ import annotations

import fnmatch
import io
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.dedup import last_wins


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines that must all be objects of the schema; blank lines are skipped, anything else ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_jsonl(spark: SparkSession, path: str, start: int = 0, end: int | None = None, offsets: bool = False) -> DataFrame:
    """(file, line, json): readable objects with their physical line index, in [start, end). Bad and blank lines are
    left out but count."""
    if offsets:
        r = spark.read.text(path).select(F.input_file_name().alias("file"), "value").withColumn("id", F.monotonically_increasing_id())
        r = r.withColumn("part", F.shiftright("id", 33)).withColumn("nth", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
        per = r.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
        from pyspark.sql import Window as W

        before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        lines = r.join(per.withColumn("before", before), ["file", "part"]).select("file", (F.col("before") + F.col("nth") - F.col("first")).alias("line"), "value")
    else:
        lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    v = F.try_parse_json("value")
    ok = lines.where((F.trim("value") != "") & v.isNotNull() & F.ltrim("value").startswith("{"))
    ok = ok.where(F.col("line") >= start)
    return (ok.where(F.col("line") < end) if end is not None else ok).select("file", F.col("line").cast("long").alias("line"), F.col("value").alias("json"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, blank lines, unreadable lines."""
    lines = spark.read.text(path)
    blank = F.trim("value") == ""
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(blank).alias("n_blank"), F.count_if(~blank & (F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{"))).alias("n_bad"))


def failed_indices(spark: SparkSession, path: str) -> DataFrame:
    """(source_index) of a file of failures; whole numbers only, empty if the file is missing."""
    schema = "source_index long"
    try:
        r = spark.read.schema("source_index string").json(path)
        return r.select(F.expr("try_cast(source_index as bigint)").alias("source_index")).dropna().distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The objects of a file that is one JSON array."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def first_existing(paths: list[str], default: str, spark: SparkSession | None = None) -> str:
    """The first path that exists, else the default (SRC-06); with a session, on any store that Spark knows."""
    if spark is None:
        return next((p for p in paths if os.path.exists(p)), default)
    from corvane.sources.sinks import exists

    return next((p for p in paths if exists(spark, p)), default)


def zip_members(spark: SparkSession, path: str, keep: tuple[str, ...] = ("eval_metrics_*", "eval_predictions_*"), skip: tuple[str, ...] = ("*_part_*", "*.py", "*.json__*", "*__huggingface*")) -> DataFrame:
    """(archive, member, content) of the members that a pattern of keep takes and none of skip."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, blob in zip(pdf["path"], pdf["content"]):
                out = []
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for m in z.namelist():
                        base = m.rsplit("/", 1)[-1]
                        if any(fnmatch.fnmatch(base, k) for k in keep) and not any(fnmatch.fnmatch(m, s) for s in skip):
                            out.append((name, m, z.read(m)))
                yield pd.DataFrame(out, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "archive string, member string, content binary")


def merged_parts(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Part files of one run as one table, the last row of each key (SRC-11)."""
    return last_wins(parts, keys, order)


def split_rows(spark: SparkSession, revision: str, language: str, split: str) -> DataFrame:
    """Rows of one language and split of a revision; the folder layout prunes the rest (SRC-09)."""
    return spark.read.parquet(f"{revision}/records").where((F.col("language") == language) & (F.col("split") == split))


def resolve_env(value, env: dict[str, str] | None = None):
    """${NAME} in texts of a configuration from the environment; ${A_B} falls back to A__B; unset is '' (SRC-12)."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: resolve_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve_env(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1]) or env.get(m[1].replace("_", "__", 1), ""), value)
    return value


def configured(cls, given: dict, overrides: dict | None = None, renamed: dict[str, str] | None = None):
    """A dataclass from a mapping: unknown keys are ignored, old names are renamed, overrides that are not None win
    (SRC-13)."""
    names = set(cls.__dataclass_fields__)
    got = {(renamed or {}).get(k, k): v for k, v in given.items()}
    got |= {k: v for k, v in (overrides or {}).items() if v is not None}
    return cls(**{k: v for k, v in got.items() if k in names})
