"""Deduplication, decontamination and leakage checks (DED-*, UNI-*, SET-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.functions.jsonx import canonical_texts_udf
from corvane.operators.records import names, tool_shape

PRIORITY = {"test": 0, "val": 1, "train": 2}


def scenario_key(query_key: Column, source: Column, calls: Column, tools: Column) -> Column:
    """Fixed-size digest of what makes a scenario, so that no long text is shuffled; JSON counts as it is written."""
    flat = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(F.lower(F.trim(x["name"])), F.lit("")), F.lit("\x1f"), F.coalesce(x["arguments" if c is calls else "parameters"], F.lit("")))), "\x1e"), F.lit(""))
    return F.sha2(F.concat_ws("\x1d", F.coalesce(source, F.lit("")), F.coalesce(query_key, F.lit("")), flat(calls), flat(tools)), 256)


def canonical_scenario_key(query_key: Column, source: Column, calls: Column, tools: Column) -> Column:
    """scenario_key from canonical arguments and the sorted tool shape (DED-01): key order, white space, double encoding,
    order of tools and their descriptions make no difference. Null is like empty."""
    args = canonical_texts_udf(F.transform(calls, lambda c: c["arguments"]))
    flat = F.zip_with(names(calls), args, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))
    some = lambda c: F.nullif(F.to_json(c), F.lit("[]"))
    return F.sha2(F.to_json(F.struct(F.nullif(source, F.lit("")).alias("source"), F.nullif(query_key, F.lit("")).alias("query"), some(flat).alias("calls"), some(tool_shape(tools)).alias("tools"))), 256)


def first_wins(rows: DataFrame, ident: list[str], scenario: str, order: str) -> DataFrame:
    """rows with reason: 'duplicate_id' for all but the first of an id, 'duplicate_scenario' for all but the first of a
    scenario among those left, null for kept rows. A row that fell out by its id claims no scenario.

    order is unique. Firsts are minima that are combined map-side and joined back, so a hot id or scenario is never
    sorted in one task; null keys are keys like others."""
    ids = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(ident)]).agg(F.min(order).alias("_id"))
    same = F.lit(True)
    for i, c in enumerate(ident):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    r = rows.join(ids, same).drop(*[f"_k{i}" for i in range(len(ident))])
    sc = r.where(F.col(order) == F.col("_id")).groupBy(F.col(scenario).alias("_s")).agg(F.min(order).alias("_sc"))
    r = r.join(sc, F.col(scenario).eqNullSafe(F.col("_s")), "left")
    reason = F.when(F.col(order) > F.col("_id"), "duplicate_id").when(F.col(order) > F.col("_sc"), "duplicate_scenario")
    return r.withColumn("reason", reason).drop("_id", "_s", "_sc")


def keep_highest_split(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Rows of the split of highest priority (test, val, train) in which their key occurs (DED-06).

    The best priority of each key is an aggregate joined back, so a hot key is combined map-side."""
    p = F.coalesce(*[F.when(F.col(split) == s, F.lit(i)) for s, i in PRIORITY.items()])
    r = rows.withColumn("prio", p)
    best = r.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("prio").alias("best"))
    return r.join(best, key, "left").where("best is null or prio = best").drop("prio", "best")


def hash_split(key: Column, train: int = 80, val: int = 10) -> Column:
    """Split by SHA-256 of the key in hundredths (DED-07)."""
    n = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(n < train, "train").when(n < train + val, "val").otherwise("test")


def leakage(rows: DataFrame, kinds: dict[str, Column], split: str = "split") -> DataFrame:
    """(kind, n_leaking, n_keys): keys that occur in more than one split, for all kinds in one pass."""
    long = rows.where(F.col(split).isNotNull()).select(F.col(split).alias("s"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()])).alias("x")).select("s", "x.kind", "x.key").where("key is not null")
    per = long.groupBy("kind", "key").agg(F.count_distinct("s").alias("n"))
    return per.groupBy("kind").agg(F.count_if(F.col("n") > 1).alias("n_leaking"), F.count("*").alias("n_keys"))


def priority_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union in which the last part wins for each key; within a part the last by order (UNI-02)."""
    u = None
    for i, p in enumerate(parts):
        p = p.withColumn("prio", F.lit(i))
        u = p if u is None else u.unionByName(p)
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.desc("prio"), F.desc(order)))
    return u.withColumn("rn", rn).where("rn = 1").drop("rn", "prio")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by order of each key, as an aggregate (SRC-11)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
