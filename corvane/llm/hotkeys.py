"""Joins on keys that many rows may share, in blocks of at most SIDE x SIDE pairs.

Rows are counted for each key (combined map-side); a key with more than SIDE rows on a side is cut into a grid of blocks
by hash, each row goes to the blocks of its grid line, and the join is on key and block. Every pair is met in exactly
one block, no row is left out, and the rows copied are about pairs / SIDE * 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 2000


def _blocks(rows: DataFrame, grid: DataFrame, key: str, ident: str, own: str, other: str) -> DataFrame:
    """rows with _own and _other, the place of a block in the grid of their key; rows without a partner end here."""
    r = rows.join(grid.select(key, F.col(own).alias("_g"), F.col(other).alias("_h")), key)
    r = r.withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_g")).cast("int"))
    return r.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_h") - 1).cast("int")))).drop("_g", "_h")


def between(rows: DataFrame, left: str, right: str, key: str, ident: str, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs of a row with the condition left and one with the condition right that have the same key, as aliases a
    and b."""
    blocks = lambda cond: F.ceil(F.count_if(F.expr(cond)) / SIDE)
    grid = rows.groupBy(key).agg(blocks(left).alias("_l"), blocks(right).alias("_r")).where("_l > 0 and _r > 0")
    x, y = _blocks(rows.where(left), grid, key, ident, "_l", "_r"), _blocks(rows.where(right), grid, key, ident, "_r", "_l")
    return x.alias(a).join(y.alias(b), F.expr(f"{a}.{key} = {b}.{key} and {a}._own = {b}._other and {a}._other = {b}._own"))


#: Condition for rows a and b of ``blocked`` with the same _at: two blocks meet in many cells, but in one only as a pair.
MEET = "(a._u <> b._u or a._one)"


def blocked(rows: DataFrame, key: str, size: str, ident: str) -> DataFrame:
    """rows with _at, a digest of the key and a cell of its grid, _u, the block of the row, and _one, whether the cell
    pairs a block with itself. size is a column that no count of the key exceeds. Both sides of the join are this table,
    so it is shuffled once."""
    g = F.ceil(F.col(size) / SIDE).cast("int")
    r = rows.withColumn("_u", F.pmod(F.xxhash64(ident), g).cast("int")).withColumn("_v", F.explode(F.sequence(F.lit(0), g - 1)))
    at = F.xxhash64(key, F.least("_u", "_v"), F.greatest("_u", "_v"))
    return r.select(at.alias("_at"), "_u", (F.col("_u") == F.col("_v")).alias("_one"), *[c for c in rows.columns if c not in (key, size)])


def within(rows: DataFrame, key: str, ident: str, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs of two rows with the same key, the lesser ident as alias a, the other one as b."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    r = rows.join(n, key)
    x = blocked(r.withColumn("_k", F.col(key)), "_k", "_n", ident)
    meet = MEET.replace("a.", f"{a}.").replace("b.", f"{b}.")
    return x.alias(a).join(x.alias(b), F.expr(f"{a}._at = {b}._at and {a}.{key} <=> {b}.{key} and {meet} and {a}.{ident} < {b}.{ident}"))
