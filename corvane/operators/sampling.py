"""Deterministic samples, quotas and nested candidate sets (TOP-01..06, WIN-08..10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.operators.ranking import ranked
from corvane.operators.split import shuffle_key


def stratified_sample(rows: DataFrame, key: str, positive: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows, half of them positive; a stratum that is too small is topped up from the other.

    Each stratum is cut to n by a top-n before anything is ranked, so the ranks are over 2n rows."""
    r = rows.withColumn("pos", F.coalesce(positive, F.lit(False))).withColumn("o", shuffle_key(seed, F.col(key)))
    top = lambda p: r.where(F.col("pos") == p).orderBy("o", key).limit(n)
    u = top(True).union(top(False))
    rank = F.row_number().over(W.partitionBy("pos").orderBy("o", key))
    u = u.withColumn("rn", rank).withColumn("want", F.when(F.col("pos"), n // 2).otherwise(n - n // 2)).withColumn("extra", F.col("rn") > F.col("want"))
    return u.orderBy("extra", "o", key).limit(n).drop("pos", "o", "rn", "want", "extra")


def quota_sample(rows: DataFrame, key: str, source: str, positive: Column, quotas: dict[str, int], negatives: int, seed: int = 42) -> DataFrame:
    """rows with pick: 'negative', 'quota' or 'refill'. Negatives up to their number, positives per source up to its
    quota; what quotas lack is refilled from the other positives in shuffled order."""
    total = sum(quotas.values()) + negatives
    r = rows.withColumn("pos", F.coalesce(positive, F.lit(False))).withColumn("o", shuffle_key(seed, F.col(key)))
    neg = r.where("not pos").orderBy("o", key).limit(negatives).withColumn("pick", F.lit("negative"))
    parts = [r.where(F.col("pos") & (F.col(source) == s)).orderBy("o", key).limit(q).withColumn("pick", F.lit("quota")) for s, q in sorted(quotas.items())]
    got = neg
    for p in parts:
        got = got.union(p)
    rest = r.where("pos").join(got.select(key), key, "left_anti").select(*r.columns).orderBy("o", key).limit(total).withColumn("pick", F.lit("refill"))
    rank = F.when(F.col("pick") == "refill", 1).otherwise(0)
    return got.union(rest).orderBy(rank, "o", key).limit(total).drop("pos", "o")


def judge_sample(rows: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """max(1, floor(n * rate)) rows in shuffled order (TOP-03)."""
    n = max(1, int(rows.count() * rate))
    return rows.orderBy(shuffle_key(seed, F.col(key)), key).limit(n)


def nested_candidates(anchors: DataFrame, pool: DataFrame, sizes: list[int], seed: int = 42, chunk: int = 20_000) -> DataFrame:
    """(rid, n, nth, name, is_gold): for each anchor (rid, gold array) and each size the gold names first, then the
    prefix of one shuffled order of the other names, so the set of a smaller size lies in that of a larger one.

    The pool is a catalogue: it goes along as arrays of about ``chunk`` names, broadcast while there are few. Each anchor
    takes the first names of its own order out of an array, so no row is made for a pair that falls out; with several
    arrays their firsts are merged for each anchor, at most max(sizes) from each."""
    most = max(sizes)
    names = pool.select("name").where("name is not null").distinct()
    chunks = max(1, -(-names.count() // chunk))
    arrays = names.groupBy(F.pmod(F.xxhash64("name"), F.lit(chunks)).alias("_c")).agg(F.collect_list("name").alias("_names"))
    a = anchors.select("rid", F.slice(F.array_distinct("gold"), 1, most).alias("gold"))
    order = lambda x: F.sha2(F.concat(F.lit(f"{seed}:"), F.col("rid").cast("string"), F.lit(":"), x), 256)
    firsts = F.slice(F.array_sort(F.transform(F.array_except("_names", "gold"), lambda x: F.struct(order(x).alias("o"), x.alias("name")))), 1, most)
    cand = a.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>"))).join(F.broadcast(arrays) if chunks <= 5 else arrays, "_c").select("rid", "gold", firsts.alias("own"))
    if chunks > 1:
        cand = cand.groupBy("rid").agg(F.first("gold").alias("gold"), F.slice(F.array_sort(F.flatten(F.collect_list("own"))), 1, most).alias("own"))
    size = F.explode(F.array(*map(F.lit, sizes)))
    d = cand.select("rid", F.size("gold").alias("g"), "own", size.alias("n")).select("rid", "g", "n", F.posexplode(F.slice("own", F.lit(1), F.greatest(F.col("n") - F.col("g"), F.lit(0)))).alias("p", "x"))
    d = d.select("rid", "n", (F.col("p") + 1 + F.col("g")).alias("nth"), F.col("x.name").alias("name"), F.lit(False).alias("is_gold"))
    g = a.select("rid", size.alias("n"), "gold").select("rid", "n", F.posexplode(F.slice("gold", F.lit(1), F.col("n"))).alias("p", "name"))
    return d.union(g.select("rid", "n", (F.col("p") + 1).alias("nth"), "name", F.lit(True).alias("is_gold")))


def shard(rows: DataFrame, ordinal: str, n: int, k: int) -> DataFrame:
    """Every n-th row by ordinal (WIN-09)."""
    return rows.where(F.pmod(F.col(ordinal), F.lit(n)) == k)


def length_batches(rows: DataFrame, length: Column, key: str, part: str, size: int) -> DataFrame:
    """rows with batch: consecutive rows by length within part, ``size`` each (WIN-10)."""
    r = ranked(rows.withColumn("_len", length), ["_len", key], part, "_rn")
    return r.withColumn("batch", F.floor((F.col("_rn") - 1) / size)).drop("_len", "_rn")
