"""Same or near-same records across splits (problem 3).

Winnowing fingerprints over the words of a query. Every distinct word has a rolling polynomial hash of its characters;
the canonical sequence of a query is its words in the order (rarity in the whole corpus, hash), so that moved words
change nothing. Each window of ceil(0.75 n) words of that sequence selects its least word: n - ceil(0.75 n) + 1
fingerprints. Two queries with a similarity of at least 0.75 have at least ceil(0.75 n) words in common, so the least of
those is selected in both and no pair is missed, whatever was moved, inserted or replaced (windows over the order of
the text can't promise that, because the similarity knows no order). Rarity comes from a fixed-size count sketch.

Fingerprints are joined between train and the other splits, together with the names of the calls. In canonical
sequences common seeds are always in line; the first one bounds what can follow it, and the alignment of the sequences
after it gives the similarity, which decides. The coverage that ``report`` and ``coverage`` give is in the order of the
text: the shared fingerprints are chained in line and every seed is extended word by word.

Keys that many classes share are cut into blocks of both sides (``hotkeys``), so no task gets all of their pairs.

Cases: null split, null or wordless query (similarity 0): only an equal id can pair them, and null ids equal nothing;
blank call names are left out, null calls equal no calls; copies of a query within a side are one class until the end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.hotkeys import between
from corvane.llm.splits import clean_name
from corvane.llm.textform import may_reach, word_line_udf
from corvane.session import cut

SIMILARITY, SKETCH = 0.75, 1 << 18
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_SLICE = 2000  # lines that are looked at together


def rolling(word: str) -> int:
    """Polynomial rolling hash of the characters of a word."""
    h = 0
    for c in word:
        h = (h * _BASE + ord(c)) % _MOD
    return h


def call_names(calls: Column) -> Column:
    """The clean function names in call order as one string; '' for no calls."""
    return F.coalesce(F.array_join(F.array_compact(F.transform(calls, lambda c: clean_name(c["name"]))), "\x1f"), F.lit(""))


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def _distinct_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words of all lines, owner, word): the distinct words of each line, by owner."""
    parts = pc.split_pattern(lines, " ")
    d = parts.flatten().dictionary_encode()
    hashes = np.array([rolling(w) for w in d.dictionary.to_pylist()], np.int64)
    size = parts.value_lengths().to_numpy(zero_copy_only=False)
    pairs = np.unique(np.repeat(np.arange(len(lines), dtype=np.int64), size) * max(len(hashes), 1) + d.indices.to_numpy(zero_copy_only=False))
    return hashes, pairs // max(len(hashes), 1), pairs % max(len(hashes), 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for b in batches:
        for i in range(0, b.num_rows, _SLICE):
            hashes, _, word = _distinct_words(b.column("line").slice(i, _SLICE))
            total += np.bincount(_bucket(hashes)[word], minlength=SKETCH)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def count_sketch(lines: DataFrame) -> np.ndarray:
    """How many lines hold a word of each of SKETCH buckets: 2^18 numbers, whatever the size of the corpus."""
    rows = lines.select("line").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def select_seeds(lines: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the selected fingerprints of each line in canonical order, all lines after one another."""
    hashes, owner, word = _distinct_words(lines)
    h = hashes[word]
    order = np.lexsort((h, count[_bucket(h)], owner))
    n = np.bincount(owner, minlength=len(lines))
    begin = np.r_[0, np.cumsum(n)]
    keep = n - -(-n * 3 // 4) + 1  # one for each window of ceil(0.75 n) words
    at = np.arange(len(order)) - np.repeat(begin[:-1], n)
    return np.r_[0, np.cumsum(np.minimum(keep, n))], h[order][at < np.repeat(keep, n)]


def seeds(lines: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(the columns of lines but line, pos, seed): one row for each selected fingerprint of each line."""
    share = lines.sparkSession.sparkContext.broadcast(np.minimum(sketch, (1 << 31) - 1).astype(np.int32))
    keep = [c for c in lines.columns if c != "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = share.value
        for big in batches:
            for i in range(0, big.num_rows, _SLICE):
                b = big.slice(i, _SLICE)
                offsets, h = select_seeds(b.column("line"), count)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h))], names=[*keep, "seeds"])

    schema = T.StructType([lines.schema[c] for c in keep] + [T.StructField("seeds", T.ArrayType(T.LongType()))])
    return lines.mapInArrow(run, schema).select(*keep, F.posexplode("seeds").alias("pos", "seed"))


def chain_cover(a: list[str], b: list[str], shared: set[int] | None = None) -> tuple[float, float, int]:
    """Shares of a and b that the best chain of seeds covers once extended, and the number of its seeds.

    Seeds are the shared fingerprints (all common words if none are given) at the places where their words stand; of a word that stands more than once the
    k-th places go together. A chain is a longest run of them in the same order (longest increasing subsequence); each
    seed grows in both directions while the words agree."""
    hits = sorted(_places(a, b, shared))
    tails: list[int] = []
    back: list[tuple[int, int]] = []
    for k, (_, j) in enumerate(hits):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        back.append((at, k))
    chain, want = [], len(tails) - 1
    limit = len(b)
    for at, k in reversed(back):
        if at == want and hits[k][1] < limit:
            chain.append(hits[k])
            limit, want = hits[k][1], want - 1
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i, j in chain:
        if in_a[i]:
            continue
        x, y = i, j
        while x >= 0 and y >= 0 and a[x] == b[y]:
            in_a[x] = in_b[y] = True
            x, y = x - 1, y - 1
        x, y = i + 1, j + 1
        while x < len(a) and y < len(b) and a[x] == b[y]:
            in_a[x] = in_b[y] = True
            x, y = x + 1, y + 1
    return float(in_a.mean()), float(in_b.mean()), len(chain)


def _places(a: list[str], b: list[str], shared: set[int] | None) -> Iterator[tuple[int, int]]:
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    used: dict[str, int] = {}
    for i, w in enumerate(a):
        if w in at and (shared is None or rolling(w) in shared) and (k := used.get(w, 0)) < len(at[w]):
            used[w] = k + 1
            yield i, at[w][k]


@F.pandas_udf(T.StructType([T.StructField("cover_a", T.DoubleType()), T.StructField("cover_b", T.DoubleType()), T.StructField("n_seeds", T.IntegerType())]))
def _cover(a: pd.Series, b: pd.Series, shared: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([chain_cover(x.split(" "), y.split(" "), set(s)) for x, y, s in zip(a, b, shared)], columns=["cover_a", "cover_b", "n_seeds"])


def _sided(records: DataFrame) -> DataFrame:
    side = F.when(F.col("split") == "train", "t").when(F.col("split").isin("val", "test"), "e")
    r = records.where("rid is not null").select("rid", "id", "source", "split", side.alias("side"), word_line_udf("query").alias("w"), call_names(F.col("function_calls")).alias("calls"))
    return cut(r.select("rid", "id", "source", "split", "side", "calls", F.col("w.words").alias("line"), "w.n", "w.b0", "w.b1"))


@dataclass
class Overlaps:
    """members: rid, side, cid; classes: cid, side, calls, line, n, b0, b1; pairs: cid_t, cid_e, similarity, seeds."""

    members: DataFrame
    classes: DataFrame
    pairs: DataFrame


def overlaps(base: DataFrame, with_seeds: bool = False) -> Overlaps:
    """The classes of equal queries and calls on either side, and the pairs of classes above the similarity; the shared
    fingerprints of a pair only if they are asked for."""
    lines = base.where("line <> ''")
    c = cut(lines.where("side is not null").groupBy("side", "line", "calls").agg(F.min("rid").alias("cid"), F.first("n").alias("n"), F.first("b0").alias("b0"), F.first("b1").alias("b1")))
    members = lines.join(c, ["side", "line", "calls"]).select("rid", "side", "cid")
    s = seeds(c.select("cid", "side", "calls", "n", "line"), count_sketch(lines))
    s = cut(s.select("side", "cid", "n", "pos", *(["seed"] if with_seeds else []), F.xxhash64("seed", "calls").alias("key")))
    n, m = F.col("t.n"), F.col("e.n")
    # the least common word of a pair has behind it all others that the two can share
    follows = F.least(n - F.col("t.pos"), m - F.col("e.pos"))
    p = between(s, "side = 't'", "side = 'e'", "key", "cid", "t", "e").where(follows * (1 + SIMILARITY) >= SIMILARITY * (n + m) - 1e-6)
    ends = F.col("t.cid").alias("cid_t"), F.col("e.cid").alias("cid_e")
    p = p.groupBy(*ends).agg(F.collect_set("t.seed").alias("seeds")) if with_seeds else p.select(*ends).distinct()  # a set holds at most the fingerprints of one query
    bits = lambda x: c.where(f"side = '{x}'").select(F.col("cid").alias(f"cid_{x}"), F.col("n").alias(f"n{x}"), F.col("b0").alias(f"u{x}"), F.col("b1").alias(f"v{x}"))
    col = lambda x: (F.col(f"{x}t"), F.col(f"{x}e"))
    keep = ["cid_t", "cid_e", *(["seeds"] if with_seeds else [])]
    p = p.join(bits("t"), "cid_t").join(bits("e"), "cid_e").where(may_reach(SIMILARITY, col("n"), col("u"), col("v"))).select(*keep)
    ct = c.where("side = 't'").select(F.col("cid").alias("cid_t"), F.col("line").alias("lt"), F.col("calls").alias("kt"))
    ce = c.where("side = 'e'").select(F.col("cid").alias("cid_e"), F.col("line").alias("le"), F.col("calls").alias("ke"))
    wt, we = F.array_distinct(F.split("lt", " ")), F.array_distinct(F.split("le", " "))
    p = p.join(ct, "cid_t").join(ce, "cid_e").where("kt = ke").withColumn("both", F.size(F.array_intersect(wt, we)))
    p = p.withColumn("similarity", F.col("both") / (F.size(wt) + F.size(we) - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    return Overlaps(members, c, cut(p.select(*keep, "similarity")))


def covered(o: Overlaps) -> DataFrame:
    """(cid_t, cid_e, similarity, cover_t, cover_e, n_seeds): how much of each text the extended chain covers."""
    text = lambda x: o.classes.where(f"side = '{x}'").select(F.col("cid").alias(f"cid_{x}"), F.col("line").alias(f"l{x}"))
    p = o.pairs.join(text("t"), "cid_t").join(text("e"), "cid_e").withColumn("x", _cover("lt", "le", "seeds"))
    return p.select("cid_t", "cid_e", "similarity", F.col("x.cover_a").alias("cover_t"), F.col("x.cover_b").alias("cover_e"), F.col("x.n_seeds").alias("n_seeds"))


def _same_id(base: DataFrame) -> DataFrame:
    """(x, y): the pairs of equal id; ids of many rows are joined in blocks."""
    p = between(base.where("side is not null and id is not null").select("id", "side", "rid"), "side = 't'", "side = 'e'", "id", "rid", "t", "e")
    return p.select(F.col("t.rid").alias("x"), F.col("e.rid").alias("y"))


def pairs(records: DataFrame) -> DataFrame:
    """(rid_a, rid_b): the pairs of a train record and a val or test record that are the same or nearly so."""
    base = _sided(records)
    o = overlaps(base)
    members = cut(o.members)
    mt, me = members.where("side = 't'").select(F.col("cid").alias("cid_t"), F.col("rid").alias("x")), members.where("side = 'e'").select(F.col("cid").alias("cid_e"), F.col("rid").alias("y"))
    near = o.pairs.select("cid_t", "cid_e").join(mt, "cid_t").join(me, "cid_e").select("x", "y")
    both = near.union(_same_id(base))
    return both.select(F.least("x", "y").alias("rid_a"), F.greatest("x", "y").alias("rid_b")).distinct()


def coverage(records: DataFrame) -> DataFrame:
    """(rid, split, source, n_partners, cover): one row for each val or test record with a near-same train record: how
    many those are, and the largest share of its words, in the order of the text, that the chain of one covers."""
    base = _sided(records)
    o = overlaps(base, with_seeds=True)
    members = cut(o.members)
    size = members.where("side = 't'").groupBy(F.col("cid").alias("cid_t")).agg(F.count("*").alias("k"))
    best = covered(o).join(size, "cid_t").groupBy(F.col("cid_e").alias("cid")).agg(F.sum("k").alias("n_partners"), F.round(F.max("cover_e"), 4).alias("cover"))
    e = base.where("side = 'e'").select("rid", "split", "source")
    return e.join(members.where("side = 'e'").select("rid", "cid").join(best, "cid"), "rid").select("rid", "split", "source", "n_partners", "cover")


def report(records: DataFrame) -> DataFrame:
    """(split, source, n_records, n_same_id, n_near, mean_cover) of the val and test records: how many have a train
    record of the same id, how many a near-same one, and the mean share of those that its best chain covers."""
    base = _sided(records)
    o = overlaps(base, with_seeds=True)
    best = covered(o).groupBy(F.col("cid_e").alias("cid")).agg(F.max("cover_e").alias("cover"))
    near = o.members.where("side = 'e'").join(best, "cid").select("rid", "cover")
    same = base.where("side = 't' and id is not null").select("id").distinct().withColumn("same", F.lit(1))
    e = base.where("side = 'e'").select("rid", "id", "split", "source").join(near, "rid", "left").join(same, "id", "left")
    return e.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("same").alias("n_same_id"), F.count("cover").alias("n_near"), F.round(F.avg("cover"), 4).alias("mean_cover"))


def pair_counts(records: DataFrame) -> DataFrame:
    """(split, source, source_train, n_records, n_pairs, n_same_id): for each split and pair of sources how many val or
    test records have a near-same train record, how many such pairs there are, and how many pairs have the same id.

    Pairs are counted by products of the sizes of classes and ids, and are never made."""
    base = _sided(records)
    o = overlaps(base)
    members = cut(o.members.join(base.select("rid", "split", "source"), "rid"))
    size = lambda side: members.where(f"side = '{side}'").groupBy(F.col("cid").alias(f"cid_{side}"), *(["split"] if side == "e" else []), F.col("source").alias(f"source_{side}")).agg(F.count("*").alias(f"k{side}"))
    p = o.pairs.select("cid_t", "cid_e").join(size("t"), "cid_t").join(size("e"), "cid_e")
    near = p.groupBy("cid_e", "split", "source_e", "source_t").agg(F.first("ke").alias("r"), F.sum(F.col("kt") * F.col("ke")).alias("pairs"))
    near = near.groupBy("split", F.col("source_e").alias("source"), F.col("source_t").alias("source_train")).agg(F.sum("r").alias("n_records"), F.sum("pairs").alias("n_pairs"))
    ids = lambda side: base.where(f"side = '{side}' and id is not null").groupBy("id", *(["split"] if side == "e" else []), F.col("source").alias(f"source_{side}")).agg(F.count("*").alias(f"k{side}"))
    same = ids("t").join(ids("e"), "id").groupBy("split", F.col("source_e").alias("source"), F.col("source_t").alias("source_train")).agg(F.sum(F.col("kt") * F.col("ke")).alias("n_same_id"))
    on = F.expr("n.split = s.split and n.source <=> s.source and n.source_train <=> s.source_train")
    out = near.alias("n").join(same.alias("s"), on, "full")
    pick = [F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in ("split", "source", "source_train")]
    return out.select(*pick, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_pairs", "n_same_id")])
