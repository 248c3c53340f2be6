"""Connected components on an edge table (GRF-01) and the dominant stratum of a component (GRF-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.session import cut, drop_cut


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component of node; the nodes are those that edges name.

    Alternates large-star and small-star steps, each one aggregation by node and one distinct, until no edge changes.
    The number of rounds grows with the logarithm of the longest path. A large-star step keys on the node and only
    needs the minimum of its neighbours, so a hub is aggregated map-side and never gathered in one task.
    Null ends are dropped; self edges keep a node that has no other edge; an empty table gives an empty result."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct()
    e = cut(e)
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    cur = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = cut(cur)
    sign = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        nxt = cut(small)
        drop_cut(cur)
        cur = nxt
        now = tuple(cur.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def dominant_stratum(members: DataFrame, group: str, *strata: str | Column) -> DataFrame:
    """The most frequent stratum of each group; ties go to the smallest stratum."""
    names = [f"s{i}" for i in range(len(strata))]
    n = members.select(group, *(F.col(s).alias(k) if isinstance(s, str) else s.alias(k) for s, k in zip(strata, names))).groupBy(group, *names).count()
    best = F.row_number().over(W.partitionBy(group).orderBy(F.desc("count"), *names))
    return n.withColumn("rn", best).where("rn = 1").drop("rn", "count")
