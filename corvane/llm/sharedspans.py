"""Long exact spans shared between records (problem 10).

Texts are cut where a gear rolling hash of the last GEAR code points is the least within a window of WINDOW positions
(the right one of equals), so cuts depend on nearby text only, resist insertions, and lie at most WINDOW apart. Two texts
that share a stretch of at least SPAN >= GEAR - 1 + 2 * WINDOW code points therefore share a whole chunk of it. Chunks
are deduplicated by digest; only windows of SPAN code points whose chunks all occur in a second text are looked at closely.
The stretch from one cut to SPAN after the next is compared as a whole by two independent 64-bit hashes, a tree hash and
a polynomial one (at 10^12 windows two different texts agree in both with a probability of 10^-15); where it is shared, so are
all windows that begin in it. The windows that this leaves, those near the ends of a shared run, are hashed one by one,
together with the settled windows that have the same first chunk as one of them. The union of what is found in two
texts is the result. Texts that are equal as a whole are one class before any of that.

Cases: null texts and texts shorter than SPAN share nothing; a stretch that recurs only within its own text is not
shared; repeated rows with one doc_id count as one document; very long texts are handled whole; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.llm.bounded import few
from corvane.session import cut

SPAN, GEAR, WINDOW = 400, 32, 160
_POINTS = 1 << 20  # code points that are hashed at a time
_B = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _least(code: np.ndarray) -> np.ndarray:
    """For each window of WINDOW positions the place of its least gear hash; places are of the last code point hashed."""
    g = code * np.uint32(0x85EBCA6B)
    g = (g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    g ^= g >> np.uint32(16)
    k = 1
    while k < GEAR:  # the gear hash of 2k code points from those of k
        h = g.copy()
        h[k:] += g[:-k] << np.uint32(k)
        g = h
        k *= 2
    n = len(g)
    key = (g.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    k = 1
    while 2 * k <= WINDOW:
        key = np.minimum(key[: n - 2 * k + 1], key[k : n - k + 1])
        k *= 2
    if k < WINDOW:
        key = np.minimum(key[: n - WINDOW + 1], key[WINDOW - k : n - k + 1])
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that are at least SPAN long: owner, start, end and digest of each chunk, the places of the least hash
    of each window, and the first code point of each text."""
    return _chunked(texts)[:6]


def _chunked(texts: list[str]) -> tuple:
    """Of texts that are at least SPAN long: owner, start, end and digest of each chunk, the places of the least hash
    of each window, the first code point of each text, and a function that gives the digest of any spans."""
    code, begin = _codes(texts)
    least = _least(code)
    x = np.arange(len(least))
    own = np.searchsorted(begin, x, side="right") - 1
    ok = (x >= begin[own] + GEAR - 1) & (x + WINDOW <= begin[own + 1])
    cuts = np.unique(least[ok])
    who = np.searchsorted(begin, cuts, side="right") - 1
    same = who[1:] == who[:-1]
    start, end, owner = cuts[:-1][same], cuts[1:][same], who[:-1][same]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(code) - 1, _B, np.uint64)])
        back = pow(_B, -1, 1 << 64)
        total = np.r_[np.uint64(0), np.cumsum(_mix(code.astype(np.uint64) + np.uint64(1)) * power)]
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(code) - 1, back, np.uint64)])

    def digests(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Polynomial hash of each span, from prefix sums."""
        with np.errstate(over="ignore"):
            return _mix((total[z] - total[a]) * inverse[a] + (z - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    return owner, start, end, digests(start, end), least, begin, digests


def window_hashes(code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of SPAN code points, built as a tree of halves."""
    with np.errstate(over="ignore"):
        h = _mix(code.astype(np.uint64) * np.uint64(_B) + np.uint64(1))
        levels, k = {1: h}, 1
        while 2 * k <= SPAN:
            h = _mix(h[: len(h) - k] * np.uint64(0xA0761D6478BD642F) + h[k:] * np.uint64(0xE7037ED1A0B428DB))
            k *= 2
            levels[k] = h
        n = len(code) - SPAN + 1
        out, at = np.zeros(n, np.uint64), 0
        for k in sorted(levels, reverse=True):
            if SPAN & k:
                out = _mix(out * np.uint64(0xA0761D6478BD642F) + levels[k][at : at + n])
                at += k
    return out.view(np.int64)


def _batches(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts of at most _POINTS code points, or one longer text."""
    rows, texts, n = [], [], 0
    for i, t in enumerate(b.column("text").to_pylist()):
        if rows and n + len(t) > _POINTS:
            yield rows, texts
            rows, texts, n = [], [], 0
        rows.append(i)
        texts.append(t)
        n += len(t)
    if rows:
        yield rows, texts


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for rows, texts in _batches(b):
            owner, _, _, digest, *_ = _chunked(texts)
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(rows)][owner]), pa.array(nth.astype(np.int32)), pa.array(digest)], names=["doc_id", "nth", "digest"])


def _texts(batches: Iterator[pa.RecordBatch], *sets: str) -> Iterator[tuple]:
    """For each text: its id, its code points, its cuts, the first fixed chunk of each window and whether the window is
    a candidate (all chunks that it fixes occur in a second text), its digests, the given sets of numbers, and the digest
    of any spans of it."""
    for b in batches:
        ids, held = b.column("doc_id").to_numpy(zero_copy_only=False), [b.column(c).to_pylist() for c in sets]
        for rows, texts in _batches(b):
            owner, start, end, digest, least, begin, digests = _chunked(texts)
            at = np.searchsorted(owner, np.arange(len(texts) + 1))
            code, _ = _codes(texts)
            for k, i in enumerate(rows):
                if at[k + 1] == at[k]:
                    continue
                own = [np.array(h[i] if h[i] is not None else [], np.int64) for h in held]
                s = start[at[k] : at[k + 1]]
                lone = np.ones(len(s), np.int64)
                lone[own[0]] = 0
                before = np.r_[0, np.cumsum(lone)]
                p = np.arange(begin[k], begin[k + 1] - SPAN + 1)
                # the first and the last cut that the window fixes
                a, z = np.searchsorted(s, least[p + GEAR - 1]), np.searchsorted(s, least[p + SPAN - WINDOW])
                cuts = np.r_[s, end[at[k + 1] - 1]] - begin[k]
                yield int(ids[i]), code[begin[k] : begin[k + 1]], cuts, a, before[z] == before[a], digest[at[k] : at[k + 1]], own[1:], lambda x, y, o=int(begin[k]), f=digests: f(x + o, y + o)


def _rows(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of about 100,000 rows from column arrays."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x[0])
        if n > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches from one cut to SPAN after the next one, and a row with nth -1 for each text with a candidate."""

    def parts():
        for doc, code, cuts, _, ok, _, _, spans in _texts(batches, "nths"):
            if not ok.any():
                continue
            n = len(ok)
            lo, hi = cuts[:-1], cuts[1:]
            j = np.flatnonzero((hi < n) & ok[np.minimum(lo, n - 1)] & ok[np.minimum(hi, n - 1)])
            h = window_hashes(code).view(np.uint64) if len(j) else np.zeros(0, np.uint64)
            with np.errstate(over="ignore"):
                s = _mix(h[lo[j]] * np.uint64(_B) + _mix(h[hi[j]] + (hi - lo)[j].astype(np.uint64))) if len(j) else h
            yield np.full(len(j) + 1, doc), np.r_[-1, j].astype(np.int32), np.r_[np.int64(0), s.view(np.int64)], np.r_[np.int64(0), spans(lo[j], hi[j] + SPAN)], np.r_[0, lo[j]].astype(np.int32), np.r_[0, hi[j] + SPAN].astype(np.int32)

    return _rows(parts(), ["doc_id", "nth", "s", "t", "start_at", "end_at"])


def _loose(cuts: np.ndarray, ok: np.ndarray, segs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate windows outside shared stretches, and those that begin inside one."""
    p = np.flatnonzero(ok)
    known = np.zeros(len(cuts) + 1, bool)
    known[segs + 1] = True
    inside = known[np.searchsorted(cuts, p, side="right")]
    return p[~inside], p[inside]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of the first fixed chunks of the windows that are not settled by a shared stretch."""

    def parts():
        for _, _, cuts, first, ok, digest, (segs,), _ in _texts(batches, "nths", "segs"):
            loose, _ = _loose(cuts, ok, segs)
            if len(loose):
                yield (np.unique(digest[np.unique(first[loose])]),)

    return _rows(parts(), ["digest"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that are not settled, and of the settled ones those that may be their counterparts."""

    def parts():
        for doc, code, cuts, first, ok, _, (segs, keys), spans in _texts(batches, "nths", "segs", "keys"):
            loose, settled = _loose(cuts, ok, segs)
            wanted = np.zeros(len(cuts), bool)
            wanted[keys] = True
            settled = settled[wanted[first[settled]]]
            p = np.r_[loose, settled]
            if len(p):
                yield np.full(len(p), doc), p.astype(np.int32), window_hashes(code)[p], spans(p, p + SPAN), np.r_[np.ones(len(loose), bool), np.zeros(len(settled), bool)]

    return _rows(parts(), ["doc_id", "pos", "h", "g", "loose"])


def _in_two(rows: DataFrame, *key: str) -> DataFrame:
    """The values of key that occur in two documents: combined map-side, so hot values are no hot rows."""
    return cut(rows.groupBy(*key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(*key))


def shared_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, start_at, end_at): the maximal runs of shared code points of each document."""
    d = documents.select("doc_id", "text").where((F.length("text") >= SPAN) & F.col("doc_id").isNotNull())
    digest = F.unhex(F.sha2("text", 256))
    e = cut(d.select("doc_id", digest.alias("k"), F.length("text").cast("int").alias("n")).distinct())
    same = cut(e.groupBy("k").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    same = few(same)
    copies = cut(e.join(same, "k").select("doc_id", F.lit(0).alias("start_at"), F.col("n").alias("end_at"), "first"))
    # one text for each class of equal texts goes on
    rest = few(cut(copies.where("doc_id <> first").select("doc_id").distinct()))
    d = d.join(rest, "doc_id", "left_anti")
    rows = cut(d.mapInArrow(_chunk_rows, "doc_id long, nth int, digest long"))
    hits = rows.join(few(_in_two(rows, "digest")), "digest", "left_semi")
    hits = cut(hits.groupBy("doc_id").agg(F.collect_set("nth").alias("nths")))  # at most the chunks of one text
    d = d.select("doc_id", "text")
    segs = cut(d.join(few(hits), "doc_id").mapInArrow(_segment_rows, "doc_id long, nth int, s long, t long, start_at int, end_at int"))
    twice = cut(segs.where("nth >= 0").join(few(_in_two(segs.where("nth >= 0"), "s", "t")), ["s", "t"], "left_semi").select("doc_id", "nth", "start_at", "end_at"))
    left = segs.where("nth < 0").select("doc_id").distinct().join(hits, "doc_id").join(twice.groupBy("doc_id").agg(F.collect_set("nth").alias("segs")), "doc_id", "left")
    left = cut(left)
    keys = cut(d.join(few(left), "doc_id").mapInArrow(_key_rows, "digest long").distinct())
    held = rows.join(few(keys), "digest", "left_semi").join(few(left.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("nth").alias("keys"))
    left = cut(left.join(held, "doc_id", "left"))
    w = cut(d.join(few(left), "doc_id").mapInArrow(_window_rows, "doc_id long, pos int, h long, g long, loose boolean"))
    two = cut(w.groupBy("h", "g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("loose").alias("any")).where("a < b and any").select("h", "g"))
    w = w.where("loose").join(few(two), ["h", "g"], "left_semi").select("doc_id", F.col("pos").alias("start_at"), (F.col("pos") + SPAN).alias("end_at"))
    w = w.union(twice.select("doc_id", "start_at", "end_at"))
    by = W.partitionBy("doc_id").orderBy("start_at", "end_at")
    so_far = F.max("end_at").over(by.rowsBetween(W.unboundedPreceding, -1))
    w = w.withColumn("new", F.coalesce(F.col("start_at") > so_far, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    runs = w.groupBy("doc_id", "run").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).drop("run")
    whole = copies.select("doc_id", "start_at", "end_at")
    return runs.join(few(whole.select("doc_id")), "doc_id", "left_anti").union(whole)


def shared_share(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_shared, share) of every document: how much of it occurs elsewhere."""
    runs = shared_runs(documents).groupBy("doc_id").agg(F.sum(F.col("end_at") - F.col("start_at")).cast("long").alias("n_shared"))
    d = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    n = F.coalesce("n_shared", F.lit(0))
    return d.join(runs, "doc_id", "left").select("doc_id", "n_chars", n.alias("n_shared"), F.when(F.col("n_chars") > 0, F.round(n / F.col("n_chars"), 4)).otherwise(0.0).alias("share"))
