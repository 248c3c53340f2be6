"""Near-duplicate records with small edits (problem 5).

Circulant MinHash: one permutation scatters the words over a circle of 2^20 places, a second one is shifted around it;
coordinate k of the signature is the least shifted value over the words of a text, so two permutations yield all
coordinates. BANDS bands of ROWS coordinates that are met more than once, each joined to a tool name of the record, give
the candidates; keys that many classes share are joined in blocks (``hotkeys``), and every candidate is verified by the exact similarity of its words and the exact overlap of its tools.

A pair at similarity 0.75 shares a band with probability 1 - (1 - 0.75^5)^36 = 0.99994. Records with the same words and
the same tools are one class before anything is hashed, so a group of copies costs one signature; a pair with tool
overlap of at least 0.5 shares one of the first n - ceil(n / 2) + 1 tools in any fixed order, so only those make keys.

Cases: null, blank or wordless queries and records without a named tool are in no pair (similarity or overlap 0); very
long texts are hashed whole; repeated rows are pairs of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.hotkeys import MEET, blocked, within
from corvane.llm.splits import tool_names
from corvane.llm.textform import may_reach, word_set_udf
from corvane.operators.graph import components
from corvane.session import cut, drop_cut

BANDS, ROWS, CIRCLE = 36, 5, 1 << 20
SIMILARITY, OVERLAP = 0.75, 0.5
_SLICE = 1 << 16  # words that are hashed at a time


def _second_permutation() -> np.ndarray:
    p = np.random.default_rng(20300101).permutation(CIRCLE).astype(np.int32)
    return np.concatenate([p, p])


def signatures(texts: list[str], circle: np.ndarray) -> np.ndarray:
    """texts: distinct words joined by spaces, none empty. One row of BANDS * ROWS coordinates for each text."""
    k = BANDS * ROWS
    sig = np.empty((len(texts), k), np.int32)
    seen: dict[str, int] = {}
    at, place, starts = [], [], []
    shift = CIRCLE - np.arange(k)

    def flush() -> None:
        if at:
            lines = circle[np.array(place)[:, None] + shift[None, :]]
            sig[at] = np.minimum.reduceat(lines, np.array(starts), axis=0)
            at.clear(), place.clear(), starts.clear()

    for i, t in enumerate(texts):
        own = []
        for w in t.split(" "):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w, 77) % CIRCLE
            own.append(h)
        if len(own) > _SLICE:  # a very long text by itself, piece by piece
            sig[i] = np.min([circle[np.array(own[j : j + _SLICE])[:, None] + shift].min(axis=0) for j in range(0, len(own), _SLICE)], axis=0)
            continue
        starts.append(len(place))
        at.append(i)
        place += own
        if len(place) > 4096:
            flush()
    flush()
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    m = np.random.default_rng(7).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.int64).astype(np.uint64) * 2 + 1
    x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))  # equal coordinates of two bands are no common band
    for r in range(ROWS):
        h = (h ^ (x[:, :, r] * m[None, :, r])) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    circle = _second_permutation()
    for b in batches:
        for i in range(0, b.num_rows, 4000):
            s = b.slice(i, 4000)
            keys = band_keys(signatures(s.column("words").to_pylist(), circle))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([s.column("cid"), flat], names=["cid", "bands"])


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, cid) and (cid, words, names, n, b0), both written: records with the same distinct words and tools share a
    class. Texts are moved once, by the digest that tells a class."""
    r = records.where("rid is not null").select("rid", word_set_udf("query").alias("w"), tool_names(F.col("tools")).alias("names"))
    r = r.where("w.n > 0 and size(names) > 0").select("rid", "w.words", "w.n", "w.b0", "names")
    r = cut(r.withColumn("digest", F.unhex(F.md5(F.concat_ws("\x1f", "words", F.to_json("names"))))))
    c = r.groupBy("digest").agg(F.min("rid").alias("cid"), *[F.first(x).alias(x) for x in ("words", "names", "n", "b0")])
    c = cut(c)
    members = cut(r.select("rid", "digest").join(c.select("digest", "cid"), "digest").select("rid", "cid"))
    drop_cut(r)
    return members, c.drop("digest")


def class_pairs(c: DataFrame) -> DataFrame:
    """(cid_a, cid_b, similarity, overlap) of the classes above both thresholds, cid_a < cid_b."""
    head = F.expr("slice(names, 1, size(names) - cast(ceil(size(names) * 0.5) as int) + 1)")
    sig = cut(c.mapInArrow(_bands, "cid long, bands array<long>"))
    k = sig.select("cid", F.explode("bands").alias("band"))
    # bands are counted map-side, whatever their size; nearly all are met once and end here, before tools multiply them
    k = cut(k.join(k.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "band"))
    drop_cut(sig)
    k = k.join(c.select("cid", head.alias("tools"), "n", "b0"), "cid").select("cid", "n", "b0", "m", "band", F.explode("tools").alias("tool"))
    # a band has at least as many rows as each of its tools, so its count says how many blocks are needed
    k = blocked(k.select("cid", "n", "b0", F.xxhash64("band", "tool").alias("key"), "m"), "key", "m", "cid")
    # the bitmaps leave out nearly all that is not similar where the pair is met, and nothing that is
    may = may_reach(SIMILARITY, (F.col("a.n"), F.col("b.n")), (F.col("a.b0"), F.col("b.b0")))
    p = k.alias("a").join(k.alias("b"), F.expr(f"a._at = b._at and a.cid < b.cid and {MEET}")).where(may)
    p = cut(p.select(F.col("a.cid").alias("cid_a"), F.col("b.cid").alias("cid_b")).distinct())
    texts = lambda x: c.select(F.col("cid").alias(f"cid_{x}"), F.col("words").alias(f"w{x}"), F.col("names").alias(f"t{x}"))
    p = (
        p.join(texts("a"), "cid_a")
        .join(texts("b"), "cid_b")
        .withColumn("wa", F.split("wa", " "))
        .withColumn("wb", F.split("wb", " "))
        .withColumn("wi", F.size(F.array_intersect("wa", "wb")))
        .withColumn("ti", F.size(F.array_intersect("ta", "tb")))
        .withColumn("similarity", F.col("wi") / (F.size("wa") + F.size("wb") - F.col("wi")))
        .withColumn("overlap", F.col("ti") / (F.size("ta") + F.size("tb") - F.col("ti")))
    )
    return p.where((F.col("similarity") >= SIMILARITY) & (F.col("overlap") >= OVERLAP)).select("cid_a", "cid_b", "similarity", "overlap")


def pairs(records: DataFrame) -> DataFrame:
    """(rid_a, rid_b): all pairs of records above both thresholds."""
    members, c = classes(records)
    p = class_pairs(c).select("cid_a", "cid_b")
    ma, mb = members.select(F.col("cid").alias("cid_a"), F.col("rid").alias("x")), members.select(F.col("cid").alias("cid_b"), F.col("rid").alias("y"))
    between = p.join(ma, "cid_a").join(mb, "cid_b").select("x", "y")
    copies = within(members, "cid", "rid").select(F.col("a.rid").alias("x"), F.col("b.rid").alias("y"))
    return between.union(copies).select(F.least("x", "y").alias("rid_a"), F.greatest("x", "y").alias("rid_b"))


def near_groups(records: DataFrame) -> DataFrame:
    """(rid, cid, grp, n_links): for each record its class of copies, its group of near-copies, the links of its class."""
    members, c = classes(records)
    p = cut(class_pairs(c))
    ends = p.select(F.col("cid_a").alias("cid")).union(p.select(F.col("cid_b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("n_links"))
    root = components(p, "cid_a", "cid_b").select(F.col("node").alias("cid"), F.col("root").alias("grp"))
    return members.join(root, "cid", "left").join(ends, "cid", "left").select("rid", "cid", F.coalesce("grp", "cid").alias("grp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
