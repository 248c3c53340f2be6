"""Splits that keep related records together (problem 7).

Records of one source that list a common tool, directly or through others, form a group (connected components over
tools, not over records, so the graph stays as small as the tool catalogue). Groups go to many equal bins by largest
differencing: items are tuples of bin loads, and the two tuples with the widest spread are added with one reversed,
until one is left. While there are more than BLOCK items that runs in blocks; the bins of a block are the items of the
next round, so no task or driver ever holds all groups. The last block is differenced into each number of bins of BINS,
and whole bins go to the split that is furthest below its share; the number that comes nearest to the shares stays.

Cases: names are compared in lower case without surrounding white space; null or blank names and records without a
named tool give no row; a null source is a source of its own; repeated rows stay rows; ties go to the smaller name.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.llm.bounded import few
from corvane.operators.graph import components
from corvane.session import cut

BLOCK, BINS = 4096, (10, 20, 50, 100, 200)
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def clean_name(c: Column) -> Column:
    """Lower case, without white space of any kind at the ends; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def tool_names(tools: Column) -> Column:
    """Sorted distinct clean names of an array of tools; [] for null."""
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.transform(tools, lambda t: clean_name(t["name"]))))), F.array().cast("array<string>"))


def groups(records: DataFrame) -> DataFrame:
    """(rid, source, group_tool) of each record that lists a named tool."""
    r = records.select("rid", "source", tool_names(F.col("tools")).alias("names")).where(F.size("names") > 0)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    node = lambda name: F.concat(key, F.lit("\x1f"), name)
    r = r.select("rid", "source", node(F.col("names")[0]).alias("node"), F.transform("names", lambda n: node(n)).alias("all"))
    # a hot source or tool shrinks to one row for each distinct set of tools before anything is shuffled by node
    sets = r.select("all").distinct()
    roots = components(sets.select(F.col("all")[0].alias("a"), F.explode("all").alias("b")))
    roots = cut(roots.select("node", F.element_at(F.split("root", "\x1f"), -1).alias("group_tool")))
    return r.join(few(roots), "node").select("rid", "source", "group_tool")


def differencing(weights: np.ndarray, bins: int) -> list[list[int]]:
    """Item numbers of each of ``bins`` bins, by largest differencing of tuples."""
    order = np.argsort(-weights, kind="stable")
    heap: list = []
    for k, i in enumerate(order.tolist()):
        load = np.zeros(bins)
        load[0] = weights[i]
        heap.append((-float(weights[i]), k, load, [[i]] + [[] for _ in range(bins - 1)]))
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        _, _, la, ma = heapq.heappop(heap)
        _, _, lb, mb = heapq.heappop(heap)
        load = la + lb[::-1]  # both are sorted, heaviest first
        members = [x + y for x, y in zip(ma, reversed(mb))]
        o = np.argsort(-load, kind="stable")
        load = load[o]
        heapq.heappush(heap, (-(load[0] - load[-1]), k, load, [members[i] for i in o.tolist()]))
        k += 1
    return heap[0][3] if heap else [[] for _ in range(bins)]


def _block_bins(bins: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        at = np.empty(len(pdf), np.int64)
        for b, members in enumerate(differencing(pdf["weight"].to_numpy(np.float64), bins)):
            at[members] = b
        return pd.DataFrame({"item": pdf["item"], "weight": pdf["weight"], "bin": pdf["block"].astype(str) + "." + pd.Series(at).astype(str)})

    return f


def allocate(loads: np.ndarray) -> list[str]:
    """The split of each bin: heaviest first, each to the split that is furthest below its share."""
    left = {k: v * loads.sum() for k, v in SHARES.items()}
    to = [""] * len(loads)
    for b in np.argsort(-loads, kind="stable").tolist():
        to[b] = max(left, key=lambda k: left[k])
        left[to[b]] -= loads[b]
    return to


def nearest_split(weights: np.ndarray, counts: tuple[int, ...] = BINS) -> tuple[list[str], int]:
    """The split of each item and the number of bins that comes nearest to the shares; ties go to the first number."""
    best: tuple[float, list[str], int] | None = None
    for n in counts:
        bins = differencing(weights, n)
        to = allocate(np.array([weights[b].sum() for b in bins], np.float64))
        got = dict.fromkeys(SHARES, 0.0)
        part = [""] * len(weights)
        for b, s in zip(bins, to):
            got[s] += float(weights[b].sum())
            for i in b:
                part[i] = s
        off = sum(abs(got[k] - v * weights.sum()) for k, v in SHARES.items())
        if best is None or off < best[0] - 1e-9:
            best = (off, part, n)
    return best[1], best[2]


def _shares(counts: tuple[int, ...]):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True]).reset_index(drop=True)
        return pd.DataFrame({"item": pdf["item"], "part": nearest_split(pdf["weight"].to_numpy(np.float64), counts)[0]})

    return f


def balanced_splits(records: DataFrame, bins: int | tuple[int, ...] = BINS, block: int = BLOCK) -> DataFrame:
    """(rid, source, group_tool, part): whole groups in train, validation and test at 80/10/10 of the rows.

    block has to be a few times the largest number of bins, so that each round leaves fewer items than it got."""
    bins = (bins,) if isinstance(bins, int) else tuple(bins)
    if block < 4 * max(bins):
        raise ValueError("block is too small for so many bins")
    g = cut(groups(records))
    whole = g.groupBy("source", "group_tool").agg(F.count("*").alias("weight"))
    ident = F.concat(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), F.lit("\x1f"), F.col("group_tool"))
    whole = cut(whole.withColumn("item", ident))
    items, place, n = whole.select("item", "weight"), whole.select("item", F.col("item").alias("now")), whole.count()
    while n > block:
        blocks = -(-n // block)
        put = cut(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))).groupBy("block").applyInPandas(_block_bins(max(bins)), "item string, weight long, bin string"))
        place = place.join(put.select(F.col("item").alias("now"), F.col("bin").alias("next")), "now").select("item", F.col("next").alias("now"))
        items = cut(put.groupBy(F.col("bin").alias("item")).agg(F.sum("weight").alias("weight")))
        n = items.count()
    part = items.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_shares(bins), "item string, part string")  # at most ``block`` items
    place = cut(place.join(part.select(F.col("item").alias("now"), "part"), "now").join(whole.drop("weight"), "item").select("source", "group_tool", "part"))
    same = F.expr("g.source <=> p.source and g.group_tool = p.group_tool")
    return g.alias("g").join(few(place).alias("p"), same).select("g.rid", "g.source", "g.group_tool", "p.part")


def split_shares(records: DataFrame) -> DataFrame:
    """(part, n_rows, share, n_groups) of the splits: how near they come to 80/10/10."""
    s = balanced_splits(records)
    n = s.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct("source", "group_tool")).alias("n_groups"))
    total = F.sum("n_rows").over(W.partitionBy(F.lit(0)))  # three rows
    return n.select("part", "n_rows", F.round(F.col("n_rows") / total, 4).alias("share"), "n_groups")
