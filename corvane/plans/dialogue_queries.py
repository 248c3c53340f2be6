"""Queries over dialogues (the transcripts among documents) and over failed outputs and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.functions import text as X
from corvane.operators import records, reports, scoring
from corvane.operators.ranking import ranked
from corvane.plans.common import Query, on


def _chats(d: DataFrame) -> DataFrame:
    return d.where("kind = 'transcript'")


def _turns(d: DataFrame) -> DataFrame:
    return _chats(d).select("doc_id", F.posexplode(X.turns(F.col("text"))).alias("pos", "t")).select("doc_id", "pos", "t.role", "t.content")


# the SQL cuts in front of each marker by a character that no text has
TURNS = r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '(^|\n)[ \t]*(USER|ASSISTANT|A|FUNCTION RESPONSE)[ \t]*:', chr(1) || '\2:', 'g'), chr(1)) AS parts FROM documents WHERE kind = 'transcript'),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s),
q AS (SELECT doc_id, i, regexp_extract(part, '^(USER|ASSISTANT|A|FUNCTION RESPONSE):', 1) AS m, part FROM p),
t AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, CASE m WHEN 'USER' THEN 'user' WHEN 'FUNCTION RESPONSE' THEN 'function' ELSE 'assistant' END AS role,
 regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(part, '^[^:]*:', ''), '<|endoftext|>', ''), '\n\n\n+', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS content FROM q WHERE m <> '')
"""


def _carry(d: DataFrame) -> DataFrame:
    """(doc_id, pos, last_call): the name of the last call before each turn, forgotten at a function turn (WIN-03)."""
    t = _turns(d).withColumn("name", F.nullif(F.regexp_extract("content", r'<functioncall> \{"name": "([^"]+)"', 1), F.lit("")))
    by = W.partitionBy("doc_id").orderBy("pos")
    t = t.withColumn("block", F.coalesce(F.sum((F.col("role") == "function").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = F.last("name", ignorenulls=True).over(W.partitionBy("doc_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return t.select("doc_id", "pos", "role", last.alias("last_call"))


def _flags(d: DataFrame) -> DataFrame:
    """One row: dialogues with any call, with several user turns, with a call in answer to the first one (AGG-17)."""
    t = X.turns(F.col("text"))
    c = _chats(d).select(F.contains("text", F.lit("<functioncall>")).alias("call"), (F.size(F.filter(t, lambda x: x["role"] == "user")) > 1).alias("multi"), F.exists(records.first_exchange(t), lambda x: (x["role"] == "assistant") & F.contains(x["content"], F.lit("<functioncall>"))).alias("first"))
    return c.agg(F.count("*").alias("n"), F.count_if("call").alias("n_call"), F.count_if("multi").alias("n_multi_turn"), F.count_if("first").alias("n_first_turn_call"))


def _single(d: DataFrame) -> DataFrame:
    """(filtered_index, doc_id): dialogues of one user turn, renumbered (SNK-06)."""
    one = _chats(d).where(F.size(F.filter(X.turns(F.col("text")), lambda x: x["role"] == "user")) == 1).select("doc_id", "origin")
    return ranked(one, ["doc_id"], "origin", "k").select("doc_id", "origin", (F.col("k") - 1).cast("int").alias("filtered_index"))


def _errors(f: DataFrame) -> DataFrame:
    return f.select(X.error_prefix(F.coalesce("error", F.lit("none"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def _streaks(f: DataFrame) -> DataFrame:
    return scoring.failure_streaks(f.where("dataset is not null"), "dataset", "fail_id", F.lower("error").rlike("error|failed"), 2)


def _checkpoints(c: DataFrame) -> DataFrame:
    """Checkpoints whose counters do not add up or that lack a time stamp."""
    gap = F.col("last_processed_index") + 1 - F.col("total_success") - F.col("total_failed")
    took = F.unix_timestamp(F.to_timestamp("last_update")) - F.unix_timestamp(F.to_timestamp("started_at"))
    rate = F.round((F.col("total_success") + F.col("total_failed")) / F.nullif(took, F.lit(0)), 4)
    return c.select("ckpt_id", "dataset", gap.alias("unaccounted"), F.col("last_update").isNull().alias("no_time"), took.alias("seconds"), rate.alias("rows_per_second"))


def queries() -> dict[str, Query]:
    doc = on("documents")
    return {
        "dialogue_turns": doc(_turns),
        "first_turn": doc(lambda d: records.from_chat(_chats(d)).select("doc_id", "query", F.size("function_calls").alias("n_calls"), F.col("function_calls")[0]["name"].alias("first_call"))),
        "negative_dialogues": doc(lambda d: records.negatives_from_chat(_chats(d))),
        "carry_forward_call": doc(_carry),
        "dialogue_flags": doc(_flags),
        "single_turn_index": doc(_single),
        "tool_page_objects": doc(lambda d: d.where("kind = 'tool_page'").select("doc_id", X.first_object_udf("text").alias("obj"))),
        "document_length_stats": doc(lambda d: reports.length_stats(d, F.col("text"), "kind")),
        "failed_error_prefixes": on("failed_output")(_errors),
        "failure_streaks": on("failed_output")(_streaks),
        "checkpoint_audit": on("checkpoints")(_checkpoints),
        "checkpoint_extra": on("checkpoints")(lambda c: c.select("ckpt_id", F.explode("extra").alias("key", "value"))),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "first_turn": TURNS
        + r""", u AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS nth, coalesce(sum(CASE WHEN role = 'function' THEN 1 ELSE 0 END) OVER w, 0) AS fn FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, content, pos FROM u WHERE nth = 1 AND role = 'assistant' AND fn = (SELECT coalesce(max(fn), 0) FROM u v WHERE v.doc_id = u.doc_id AND v.nth = 0)),
b AS (SELECT doc_id, pos, unnest(bs) AS block, generate_subscripts(bs, 1) AS i FROM (SELECT doc_id, pos, list_transform(string_split(content, '<functioncall>')[2:], lambda p: trim(string_split(p, chr(10) || chr(10))[1], chr(32) || chr(9) || chr(10) || chr(13))) AS bs FROM x)),
n AS (SELECT doc_id, pos, i, CASE WHEN json_valid(block) THEN json_extract_string(block, '$.name') ELSE regexp_extract(block, '["'']name["'']\s*:\s*["'']([^"'']+)["'']', 1) END AS name FROM b),
c AS (SELECT doc_id, count(*) AS n_calls, arg_min(name, pos * 1000 + i) AS first_call FROM n WHERE regexp_matches(name, '^[a-z][a-z0-9_]*$') GROUP BY doc_id),
fu AS (SELECT doc_id, arg_min(content, pos) AS query FROM t WHERE role = 'user' GROUP BY doc_id)
SELECT fu.doc_id AS doc_id, query, CAST(n_calls AS INT) AS n_calls, first_call FROM fu JOIN c ON fu.doc_id = c.doc_id WHERE query <> ''""",
        "dialogue_turns": TURNS + "SELECT doc_id, pos, role, content FROM t",
        "negative_dialogues": TURNS
        + """, f AS (SELECT doc_id, arg_min(content, pos) FILTER (WHERE role = 'user') AS query, max(CASE WHEN role = 'assistant' AND contains(content, '<functioncall>') THEN 1 ELSE 0 END) AS called FROM t GROUP BY doc_id)
SELECT doc_id, query FROM f WHERE query <> '' AND called = 0""",
        "carry_forward_call": TURNS
        + """, n AS (SELECT *, nullif(regexp_extract(content, '<functioncall> \\{"name": "([^"]+)"', 1), '') AS name, coalesce(sum(CASE WHEN role = 'function' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM t)
SELECT doc_id, pos, role, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_call FROM n""".replace("\\\\", "\\"),
        "dialogue_flags": TURNS
        + """, u AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM t),
g AS (SELECT doc_id, max(nth) AS users, max(CASE WHEN nth = 1 AND role = 'assistant' AND contains(content, '<functioncall>') THEN 1 ELSE 0 END) AS f FROM u GROUP BY doc_id)
SELECT count(*) AS n, count(*) FILTER (WHERE contains(d.text, '<functioncall>')) AS n_call, count(*) FILTER (WHERE users > 1) AS n_multi_turn, count(*) FILTER (WHERE f = 1) AS n_first_turn_call FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id WHERE d.kind = 'transcript'""",
        "single_turn_index": TURNS
        + """, g AS (SELECT doc_id FROM t GROUP BY doc_id HAVING count(*) FILTER (WHERE role = 'user') = 1)
SELECT d.doc_id AS doc_id, d.origin AS origin, CAST(row_number() OVER (PARTITION BY d.origin ORDER BY d.doc_id) - 1 AS INT) AS filtered_index FROM documents d JOIN g ON d.doc_id = g.doc_id""",
        "document_length_stats": "SELECT kind, count(text) AS n, CAST(min(length(text)) AS INT) AS least, CAST(max(length(text)) AS INT) AS most, round(avg(length(text)), 4) AS mean, median(length(text)) AS median FROM documents GROUP BY kind",
        "failed_error_prefixes": "SELECT trim(split_part(coalesce(error, 'none'), ':', 1)) AS prefix, count(*) AS n FROM failed_output GROUP BY 1",
        "failure_streaks": """WITH r AS (SELECT dataset, fail_id, coalesce(regexp_matches(lower(error), 'error|failed'), false) AS bad FROM failed_output WHERE dataset IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY fail_id) - row_number() OVER (PARTITION BY dataset, bad ORDER BY fail_id) AS island FROM r)
SELECT dataset, min(fail_id) AS first, max(fail_id) AS last, count(*) AS n FROM k WHERE bad GROUP BY dataset, island HAVING count(*) >= 2""",
        "checkpoint_audit": """SELECT ckpt_id, dataset, last_processed_index + 1 - total_success - total_failed AS unaccounted, last_update IS NULL AS no_time, CAST(epoch(CAST(last_update AS TIMESTAMPTZ)) - epoch(CAST(started_at AS TIMESTAMPTZ)) AS BIGINT) AS seconds,
round((total_success + total_failed) / nullif(epoch(CAST(last_update AS TIMESTAMPTZ)) - epoch(CAST(started_at AS TIMESTAMPTZ)), 0), 4) AS rows_per_second FROM checkpoints""",
        "checkpoint_extra": "SELECT ckpt_id, e.key AS key, e.value AS value FROM (SELECT ckpt_id, unnest(map_entries(extra)) AS e FROM checkpoints)",
    }
