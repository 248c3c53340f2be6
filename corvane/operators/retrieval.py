"""Vectors, candidates, rank metrics and thresholds (VEC-01, TOP-07..11, JOI-14, AGG-23)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUERY_BLOCK, TERM_BLOCK = 4_096, 1_024


def dot(a: Column, b: Column) -> Column:
    """Dot product in the JVM, for a pair at hand."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def top_k(queries: DataFrame, items: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", extra: str = "label", skip_self: bool = True) -> DataFrame:
    """(q, q_<extra>, <key>, <extra>, score, rank): the k items of highest cosine for each query, ties by key.

    A stated query set against all items, in blocks: each block of at most QUERY_BLOCK query vectors is broadcast, every
    batch of items is one matrix product and leaves only its own k best, so the cross product is never shuffled."""
    spark = items.sparkSession
    rows = queries.select(key, extra, vector).where(F.col(vector).isNotNull()).orderBy(key)
    schema = f"q long, q_{extra} int, {key} long, {extra} int, score double"
    out, block = None, []

    def search(block) -> None:
        nonlocal out
        ids, labels = np.array([b[0] for b in block], np.int64), [b[1] for b in block]
        m = np.array([b[2] for b in block], np.float64)
        share = spark.sparkContext.broadcast((ids, labels, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qlab, q = share.value
            for b in batches:
                iid = b.column(key).to_numpy(zero_copy_only=False)
                lab = b.column(extra).to_pylist()
                s = np.round(q @ _matrix(b.column(vector)).T, 6)
                if skip_self:
                    s[qid[:, None] == iid[None, :]] = -np.inf
                o = np.lexsort((np.broadcast_to(iid, s.shape), -s), axis=1)[:, :k]
                r = np.repeat(np.arange(len(qid)), o.shape[1])
                c = o.ravel()
                ok = np.isfinite(s[r, c])
                r, c = r[ok], c[ok]
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array([qlab[i] for i in r.tolist()], pa.int32()), pa.array(iid[c]), pa.array([lab[i] for i in c.tolist()], pa.int32()), pa.array(s[r, c])], names=["q", f"q_{extra}", key, extra, "score"])

        part = items.select(key, extra, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)
        out = part if out is None else out.union(part)

    for r in rows.toLocalIterator():
        block.append((r[0], r[1], r[2]))
        if len(block) == QUERY_BLOCK:
            search(block)
            block = []
    if block or out is None:
        search(block or [(-1, 0, [0.0])])
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def rank_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), extra: str = "label") -> DataFrame:
    """One row: precision at each k, mean reciprocal rank, NDCG at the last k; a hit has the label of the query."""
    r = ranked.withColumn("hit", (F.col(extra) == F.col(f"q_{extra}")).cast("int"))
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("hits"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    per = r.groupBy("q").agg(*[(F.sum(F.when(F.col("rank") <= k, F.col("hit"))) / k).alias(f"p{k}") for k in ks], F.max(F.col("hit") / F.col("rank")).alias("rr"), F.sum(gain).alias("dcg"), F.sum("hit").cast("int").alias("hits"))
    per = per.withColumn("ndcg", F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0))
    return per.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(f"p{k}"), 6).alias(f"p_at_{k}") for k in ks], F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def hard_negatives(ranked: DataFrame, skip: int = 1, keep: int = 4, extra: str = "label") -> DataFrame:
    """The first ``keep`` items after rank ``skip`` that have another label than the query (TOP-08)."""
    wrong = ranked.where((F.col("rank") > skip) & (F.col(extra) != F.col(f"q_{extra}")))
    return wrong.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy("rank"))).where(F.col("nth") <= keep)


def select_tools(ranked: DataFrame, tau: float, delta: float, k_max: int = 3) -> DataFrame:
    """The items that the gap rule takes: none if the best score is below tau, else all within delta of it (TOP-11)."""
    best = ranked.groupBy("q").agg(F.max("score").alias("best"))
    return ranked.join(best, "q").where((F.col("best") >= tau) & (F.col("score") >= F.col("best") - delta) & (F.col("rank") <= k_max)).drop("best")


def margins(ranked: DataFrame) -> DataFrame:
    """(q, best, margin) between the first and the second score (WIN-11)."""
    return ranked.where("rank <= 2").groupBy("q").agg(F.max("score").alias("best"), F.round(F.max("score") - F.min("score"), 6).alias("margin"))


def threshold_sweep(tops: DataFrame, steps: int = 100, extra: str = "label") -> DataFrame:
    """(threshold, n_kept, precision, recall, f1) over a grid, from the first ranks only.

    Scores fall into a step each, are counted there, and the counts run up from the highest step: the grid never
    multiplies the rows."""
    t = tops.where("rank = 1").select(F.least(F.lit(steps), F.greatest(F.lit(-1), F.floor(F.col("score") * steps + 1e-9))).cast("int").alias("step"), (F.col(extra) == F.col(f"q_{extra}")).cast("long").alias("hit"))
    per = t.groupBy("step").agg(F.count("*").alias("n"), F.sum("hit").alias("hit"))
    total = per.agg(F.sum("n").alias("total"))
    grid = tops.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    j = grid.join(F.broadcast(per), "step", "left").fillna(0, ["n", "hit"])
    up = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)  # steps + 1 rows
    j = j.withColumn("n_kept", F.sum("n").over(up)).withColumn("n_hit", F.sum("hit").over(up)).crossJoin(F.broadcast(total))
    p, r = F.col("n_hit") / F.greatest("n_kept", F.lit(1)), F.col("n_hit") / F.greatest("total", F.lit(1))
    return j.select(F.round(F.col("step") / steps, 4).alias("threshold"), "n_kept", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(q, d, score, rank): the k documents of highest BM25 score of those that share a term with the query, ties by d;
    queries (q, terms), docs (d, terms).

    A stated query set against all documents, in blocks. The document frequencies of all query terms are one aggregate
    over the documents. A block of queries goes along as postings (term, queries, weight); each batch of documents is
    counted as sparse (document, term) pairs, only those that a query of the block names are multiplied out, and only
    the k best of each query leave the batch."""
    spark = docs.sparkSession
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg")).first()
    total, avg = stats["n"], float(stats["avg"] or 1)
    asked = queries.select("q", F.explode(F.array_distinct("terms")).alias("term"))
    df = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "term").groupBy("q").agg(F.collect_list(F.struct("term", "df")).alias("terms"))  # the terms of one query
    out, block = None, []

    def search(block: list) -> None:
        nonlocal out
        vocab: dict[str, int] = {}
        pairs = sorted({(vocab.setdefault(t, len(vocab)), i, n) for i, (_, terms) in enumerate(block) for t, n in terms})
        term, query, n = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        first = np.searchsorted(term, np.arange(len(vocab) + 1))  # the postings of term t are first[t] to first[t + 1]
        share = spark.sparkContext.broadcast((vocab, first, query, np.log(1 + (total - n + 0.5) / (n + 0.5)), np.array([q for q, _ in block], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, first, query, idf, qid = share.value
            for big in batches:
                for at in range(0, big.num_rows, 500):
                    part = big.slice(at, 500)
                    ids, lists = part.column("d").to_numpy(zero_copy_only=False), part.column("terms")
                    d = lists.flatten().dictionary_encode()
                    known = np.array([vocab.get(t, -1) for t in d.dictionary.to_pylist()], np.int64)
                    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    code = known[d.indices.to_numpy(zero_copy_only=False)] if len(d) else np.zeros(0, np.int64)
                    owner = np.repeat(np.arange(len(ids)), size)
                    cell, tf = np.unique((owner * max(len(vocab), 1) + code)[code >= 0], return_counts=True)
                    doc, t = cell // max(len(vocab), 1), cell % max(len(vocab), 1)
                    w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / avg))
                    width = first[t + 1] - first[t]
                    post = np.repeat(first[t] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                    place = query[post] * len(ids) + np.repeat(doc, width)
                    score = np.round(np.bincount(place, np.repeat(w, width) * idf[post], len(qid) * len(ids)), 5).reshape(len(qid), len(ids))
                    shared = np.bincount(place, minlength=len(qid) * len(ids)).reshape(score.shape) > 0
                    score = np.where(shared, score, -np.inf)
                    o = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                    r, c = np.repeat(np.arange(len(qid)), o.shape[1]), o.ravel()
                    ok = np.isfinite(score[r, c])
                    r, c = r[ok], c[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[c]), pa.array(score[r, c])], names=["q", "d", "score"])

        part = docs.select("d", "terms").mapInArrow(run, "q long, d long, score double")
        out = part if out is None else out.union(part)

    for r in weighted.orderBy("q").toLocalIterator():
        block.append((r["q"], [(x["term"], x["df"]) for x in r["terms"]]))
        if len(block) == TERM_BLOCK:
            search(block)
            block = []
    if block or out is None:
        search(block or [(-1, [])])
    return out.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "d"))).where(F.col("rank") <= k)


def domain_purity(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(n, n_distractors, purity): share of distractors in the group of a gold tool, by size of the set (AGG-23)."""
    g = groups.select("name", "grp")
    gold = candidates.where("is_gold").join(g, "name").select("rid", "n", F.col("grp").alias("gold_grp")).distinct()
    other = candidates.where("not is_gold").join(g, "name").select("rid", "n", "name", "grp")
    j = other.join(gold, ["rid", "n"]).groupBy("rid", "n", "name").agg(F.max((F.col("grp") == F.col("gold_grp")).cast("int")).alias("same"))
    return j.groupBy("n").agg(F.count("*").alias("n_distractors"), F.round(F.avg("same"), 6).alias("purity"))
