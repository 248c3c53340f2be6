"""Evaluation texts leaking into training text (problem 9).

Each shard of the corpus gets an FM-index over its words: suffix array, Burrows-Wheeler transform in a wavelet matrix
with rank counts, suffix positions sampled every SAMPLE words. All phrases of PHRASE words of the items are searched
backwards at once; ranges that are left are located by walking to a sampled position, and the phrases that a document
holds are merged into spans. Words that no item has can't be part of a phrase, so they end the text that is indexed, and
stretches of fewer than PHRASE other words are left out of the index.

The items are the query set: they are searched in blocks of at most BLOCK items and BLOCK_POINTS code points (or one
longer item), each of which goes to the workers as one table of word numbers and phrases. A shard has at most SHARD
documents and SHARD_POINTS code points (or one longer document). Cases: null or short texts and items hold no phrase; repeated items are found each; copies
of a document are documents of their own; null keys are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.textform import words

PHRASE, SAMPLE, BLOCK, SHARD = 12, 16, 20_000, 4_000
BLOCK_POINTS, SHARD_POINTS = 4 << 20, 16 << 20  # code points of a block of items and of a shard


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of t in order, by prefix doubling; t ends with its only least symbol."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - k] = rank[k:]
        order = np.lexsort((nxt, rank))
        r, s = rank[order], nxt[order]
        new = np.r_[0, np.cumsum((r[1:] != r[:-1]) | (s[1:] != s[:-1]))]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or k >= n:
            return order
        k *= 2


class Wavelet:
    """Wavelet matrix: one bitmap with running counts for each bit of the symbols."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        cur = seq
        for b in range(self.bits - 1, -1, -1):
            one = (cur >> b) & 1
            self.levels.append((np.r_[0, np.cumsum(one)].astype(np.int32), int(len(cur) - one.sum())))
            cur = np.concatenate([cur[one == 0], cur[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros_like(at), at.copy()
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            bit = (symbol >> b) & 1
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit, zeros + lo1, lo - lo1)
            hi = np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        sym, lo, hi = np.zeros_like(at), np.zeros_like(at), at.copy()
        for ones, zeros in self.levels:
            bit = ones[hi + 1] - ones[hi]
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit, zeros + lo1, lo - lo1)
            hi = np.where(bit, zeros + hi1, hi - hi1)
            sym = sym * 2 + bit
        return sym, hi - lo


class FMIndex:
    """t: symbols >= 1, 0 separates texts; a last separator is added below all."""

    def __init__(self, t: np.ndarray):
        s = np.r_[t + 1, 0].astype(np.int64)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.top = int(s.max())
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=self.top + 1))]
        self.tree = Wavelet(bwt, self.top)
        sampled = sa % SAMPLE == 0
        self.mark = np.r_[0, np.cumsum(sampled)].astype(np.int64)
        self.place = sa[sampled]
        self.n = len(s)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [lo, hi) of each row of phrases."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j] + 1
            known = c <= self.top
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            base = self.first[c]
            lo[live], hi[live] = base + self.tree.rank(c, lo[live]), base + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        row, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            r = row[left]
            hit = self.mark[r + 1] > self.mark[r]
            out[left[hit]] = self.place[self.mark[r[hit]]] + steps
            left = left[~hit]
            sym, rank = self.tree.access(row[left])
            row[left] = self.first[sym] + rank
            steps += 1
        return out


@dataclass
class Phrases:
    """The phrases of a block of items as word numbers (from 1), and the items of each distinct phrase."""

    number: dict[str, int]
    phrases: np.ndarray
    items: list[list[int]]


def phrases_of(items: list[tuple[int, str | None]]) -> Phrases:
    number: dict[str, int] = {}
    rows: dict[tuple[int, ...], list[int]] = {}
    for item, text in items:
        ids = [number.setdefault(w, len(number) + 1) for w in words(text)]
        for i in range(len(ids) - PHRASE + 1):
            own = rows.setdefault(tuple(ids[i : i + PHRASE]), [])
            if not own or own[-1] != item:
                own.append(item)
    return Phrases(number, np.array(list(rows), np.int64).reshape(-1, PHRASE), list(rows.values()))


def shard_hits(texts: list[str | None], p: Phrases) -> list[tuple[int, int, int]]:
    """(row of texts, place in words, phrase) of each phrase that a text of the shard holds."""
    ids, size = [], []
    get = p.number.get
    for t in texts:
        own = [get(w, 0) for w in words(t)]
        ids += own
        ids.append(0)
        size.append(len(own) + 1)
    if not len(p.phrases) or not ids:
        return []
    a = np.array(ids, np.int64)
    begin = np.r_[0, np.cumsum(size)]
    edge = np.flatnonzero(np.diff(np.r_[0, (a > 0).astype(np.int8), 0]))
    lo, hi = edge[0::2], edge[1::2]
    long = hi - lo >= PHRASE
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return []
    pieces = [np.r_[a[x:y], 0] for x, y in zip(lo, hi)]
    at = np.r_[0, np.cumsum([len(x) for x in pieces])]
    fm = FMIndex(np.concatenate(pieces))
    x, y = fm.search(p.phrases)
    hit = np.flatnonzero(y > x)
    n = (y - x)[hit]
    which = np.repeat(hit, n)
    pos = fm.locate(np.repeat(x[hit], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    k = np.searchsorted(at, pos, side="right") - 1
    place = lo[k] + pos - at[k]
    row = np.searchsorted(begin, place, side="right") - 1
    return list(zip(row.tolist(), (place - begin[row]).tolist(), which.tolist()))


def _shards(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of each shard of a batch."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    at, points = 0, 0
    for i, n in enumerate(size):
        if i > at and (points + n > SHARD_POINTS or i - at == SHARD):
            yield at, i - at
            at, points = i, 0
        points += n
    if len(size) > at:
        yield at, len(size) - at


def _search(block: Phrases, documents: DataFrame) -> DataFrame:
    share = documents.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = share.value
        for big in batches:
            for i, n in _shards(big.column("text")):
                b = big.slice(i, n)
                ids = b.column("doc_id").to_pylist()
                out = [(ids[r], item, place) for r, place, ph in shard_hits(b.column("text").to_pylist(), p) for item in p.items[ph]]
                cols = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["doc_id", "item_id", "at"])

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, item_id long, at int")


def hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, at): each phrase of PHRASE words of an item that a document holds, at a place in words."""
    rows = items.select("item_id", "text").where("item_id is not null").orderBy("item_id")
    out, block, points = None, [], 0

    def search(block: list) -> None:
        nonlocal out
        part = _search(phrases_of(block), documents)
        out = part if out is None else out.union(part)

    for r in rows.toLocalIterator():
        n = len(r[1] or "")
        if block and (len(block) == BLOCK or points + n > BLOCK_POINTS):
            search(block)
            block, points = [], 0
        block.append((r[0], r[1]))
        points += n
    if block or out is None:
        search(block)
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id)."""
    return hits(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_items): the merged spans that have to go, in words of the document."""
    from pyspark.sql import Window as W

    h = hits(documents, items)
    by = W.partitionBy("doc_id").orderBy("at")
    h = h.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(by) > PHRASE, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by.rangeBetween(W.unboundedPreceding, 0)))
    return h.groupBy("doc_id", "run").agg(F.min("at").alias("start_word"), (F.max("at") + PHRASE).alias("end_word"), F.count_distinct("item_id").alias("n_items")).drop("run")
