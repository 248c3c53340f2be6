"""Queries over embeddings (every vector whose id is divisible by 100, against all) and term search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import retrieval
from corvane.plans.common import Query, on
from corvane.plans.record_queries import NFKC
from corvane.session import cut


def _top(e: DataFrame, k: int = 10) -> DataFrame:
    return retrieval.top_k(e.where(F.col("vec_id") % 100 == 0), e, k)


def _terms(c: str):
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"[^A-Za-z]+", " ")), " "), lambda x: x != "")


def _words(c: str):
    """Runs of letters, their marks and digits of any script, in the form of the query key."""
    return F.regexp_extract_all(X.query_key(F.col(c)), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _bm25(i: DataFrame, d: DataFrame) -> DataFrame:
    q = i.select(F.col("item_id").alias("q"), _terms("text").alias("terms"))
    docs = d.where("text is not null").select(F.col("doc_id").alias("d"), _terms("text").alias("terms")).where("size(terms) > 0")
    return retrieval.bm25(q, docs, 5).select("q", "d", "score", "rank")


def _bm25_words(i: DataFrame, d: DataFrame) -> DataFrame:
    """The top 20 by words of any script (TOP-09); words are made once, as three passes read them."""
    q = i.select(F.col("item_id").alias("q"), _words("text").alias("terms"))
    docs = cut(d.where("text is not null").select(F.col("doc_id").alias("d"), _words("text").alias("terms"))).where("size(terms) > 0")
    return retrieval.bm25(q, docs, 20).select("q", "d", "score", "rank")


TOP = """WITH p AS (SELECT a.vec_id AS q, a.label AS q_label, b.vec_id AS vec_id, b.label AS label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
t AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INT) AS rank FROM p) WHERE rank <= 10)
"""
METRICS = """, h AS (SELECT q, rank, CASE WHEN label = q_label THEN 1 ELSE 0 END AS hit FROM t),
g AS (SELECT q, sum(CASE WHEN rank <= 1 THEN hit ELSE 0 END) / 1 AS p1, sum(CASE WHEN rank <= 3 THEN hit ELSE 0 END) / 3 AS p3, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) / 5 AS p5, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) / 10 AS p10, max(hit / rank) AS rr, sum(hit / log2(rank + 1)) AS dcg, sum(hit) AS hits FROM h GROUP BY q),
i AS (SELECT *, CASE WHEN hits > 0 THEN dcg / (SELECT sum(1 / log2(x + 1)) FROM unnest(range(1, CAST(hits AS BIGINT) + 1)) AS r(x)) ELSE 0 END AS ndcg FROM g)
SELECT count(*) AS n_queries, round(avg(p1), 6) AS p_at_1, round(avg(p3), 6) AS p_at_3, round(avg(p5), 6) AS p_at_5, round(avg(p10), 6) AS p_at_10, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM i"""


def queries() -> dict[str, Query]:
    emb = on("embeddings")
    return {
        "vector_topk": emb(_top),
        "retrieval_metrics": emb(lambda e: retrieval.rank_metrics(_top(e))),
        "hard_negatives": emb(lambda e: retrieval.hard_negatives(_top(e)).select("q", "vec_id", "rank", "nth")),
        "threshold_sweep": emb(lambda e: retrieval.threshold_sweep(_top(e))),
        "gap_selection": emb(lambda e: retrieval.select_tools(_top(e), 0.35, 0.21).select("q", "vec_id", "score", "rank")),
        "score_margins": emb(lambda e: retrieval.margins(_top(e))),
        "bm25_candidates": on("eval_items", "documents")(_bm25),
        "bm25_candidates_words": on("eval_items", "documents")(_bm25_words),
    }


def _bm25_sql(terms: str, k: int) -> str:
    return f"""WITH d AS (SELECT doc_id AS d, {terms} AS terms FROM documents WHERE text IS NOT NULL),
e AS (SELECT * FROM d WHERE len(terms) > 0), s AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_len FROM e),
q AS (SELECT DISTINCT item_id AS q, unnest({terms}) AS term FROM eval_items),
p AS (SELECT term, d, len, count(*) AS tf FROM (SELECT d, len(terms) AS len, unnest(terms) AS term FROM e) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT p.term AS term, d, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS w FROM p JOIN f ON p.term = f.term, s),
r AS (SELECT q, d, round(sum(w), 5) AS score FROM w JOIN q ON w.term = q.term GROUP BY 1, 2)
SELECT q, d, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM r) WHERE rank <= {k}"""


def oracle_sql() -> dict[str, str]:
    return {
        "vector_topk": TOP + "SELECT q, q_label, vec_id, label, score, rank FROM t",
        "retrieval_metrics": TOP + METRICS,
        "hard_negatives": TOP + "SELECT q, vec_id, rank, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS nth FROM t WHERE rank > 1 AND label <> q_label) WHERE nth <= 4",
        "threshold_sweep": TOP
        + """, o AS (SELECT floor(score * 100 + 1e-9) AS step, CASE WHEN label = q_label THEN 1 ELSE 0 END AS hit FROM t WHERE rank = 1),
g AS (SELECT unnest(range(0, 101)) AS step), j AS (SELECT g.step AS step, count(o.step) AS n_kept, coalesce(sum(o.hit), 0) AS n_hit FROM g LEFT JOIN o ON o.step >= g.step GROUP BY g.step), n AS (SELECT count(*) AS total FROM o)
SELECT round(step / 100, 4) AS threshold, n_kept, round(n_hit / greatest(n_kept, 1), 6) AS precision, round(n_hit / greatest(total, 1), 6) AS recall, round(coalesce(2 * (n_hit / greatest(n_kept, 1)) * (n_hit / greatest(total, 1)) / nullif(n_hit / greatest(n_kept, 1) + n_hit / greatest(total, 1), 0), 0), 6) AS f1 FROM j, n""",
        "gap_selection": TOP + "SELECT q, vec_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM t) WHERE best >= 0.35 AND score >= best - 0.21 AND rank <= 3",
        "score_margins": TOP + "SELECT q, max(score) AS best, round(max(score) - min(score), 6) AS margin FROM t WHERE rank <= 2 GROUP BY q",
        "bm25_candidates": _bm25_sql("list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: x <> '')", 5),
        "bm25_candidates_words": _bm25_sql(f"regexp_extract_all({NFKC.replace('query', 'text')}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')", 20),
    }
