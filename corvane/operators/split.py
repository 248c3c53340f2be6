"""Split assignment (TOP-04, TOP-05, WIN-07, WIN-08)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranking import group_sizes, ranked

RATIOS = (0.8, 0.1, 0.1)
NAMES = ("train", "val", "test")


def shuffle_key(seed: int, key: Column) -> Column:
    """A deterministic order that looks random: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def ratio_split(rows: DataFrame, key: str, seed: int = 42, part: str | None = None, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """rows with split by rank in the shuffled order of their part: floor(n * ratio) rows each, the rest is test."""
    check_ratios(ratios)
    r = ranked(rows.withColumn("_o", shuffle_key(seed, F.col(key))), ["_o", key], part, "_rn")
    r = group_sizes(r, part, "_n")
    a, b = F.floor(F.col("_n") * ratios[0]), F.floor(F.col("_n") * ratios[1])
    to = F.when(F.col("_rn") <= a, NAMES[0]).when(F.col("_rn") <= a + b, NAMES[1]).otherwise(NAMES[2])
    return r.withColumn("split", to).drop("_o", "_rn", "_n")


def greedy_group_split(groups: DataFrame, stratum: str = "stratum", ident: str = "grp", size: str = "size", seed: int = 42, block: int = 50_000, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(grp, split): each group goes to the split with the largest deficit, group by group in shuffled order, within
    each stratum. A stratum of more than ``block`` groups is folded in blocks by hash, each with its own targets, so no
    task holds more than a block; the ratios hold in every block, so they hold in the stratum."""
    check_ratios(ratios)
    n = groups.groupBy(F.col(stratum).alias("_s")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias("n_blocks"))
    g = groups.join(n, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s").withColumn("blk", F.pmod(F.xxhash64(ident), F.col("n_blocks")))
    g = g.select(F.col(stratum).cast("string").alias("stratum"), "blk", shuffle_key(seed, F.col(ident)).alias("o"), F.col(ident).cast("string").alias("grp"), F.col(size).cast("double").alias("w"))
    return g.groupBy("stratum", "blk").applyInPandas(lambda block: _folded(block, check_ratios(ratios)), "grp string, split string")


def check_ratios(ratios: tuple[float, ...], tolerance: float = 1e-9) -> tuple[float, ...]:
    """ratios, if there is one for each split and they add up to 1 (MTH-03)."""
    if len(ratios) != len(NAMES) or any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > tolerance:
        raise ValueError(f"ratios {ratios} are not {len(NAMES)} shares of 1")
    return tuple(ratios)


def _folded(block: pd.DataFrame, ratios: tuple[float, ...]) -> pd.DataFrame:
    """Each group in shuffled order to the split with the largest deficit; ties go to the earlier split."""
    block = block.sort_values(["o", "grp"])
    left = [block["w"].sum() * r for r in ratios]
    to = []
    for w in block["w"].tolist():
        k = left.index(max(left))
        left[k] -= w
        to.append(NAMES[k])
    return pd.DataFrame({"grp": block["grp"], "split": to})
