"""Queries over predictions: parse, merge, score, latency, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import output as O
from corvane.operators import dedup, pairing, reports, scoring
from corvane.operators.records import name_key
from corvane.plans.common import Query, on
from corvane.plans.nested_queries import DECODED

LANG = "CASE WHEN regexp_matches(lower(trim(language)), '^(en|eng)([-_]|$)') THEN 'en' WHEN regexp_matches(lower(trim(language)), '^(vi|vie)([-_]|$)') THEN 'vi' ELSE 'other' END"
CALLED = """CASE WHEN len(regexp_extract_all(raw_output, '<function=([^>\\s]+)>', 1)) > 0 THEN regexp_extract_all(raw_output, '<function=([^>\\s]+)>', 1) ELSE regexp_extract_all(raw_output, '"name": "([^"]+)"', 1) END"""

# Structured outputs in SQL. Tagged functions come with their parameters as JSON (a lone "raw" that holds an object is all
# of them); blocks of JSON, and JSON outside of tags, with name and arguments. Arguments are compared by the sorted list
# of all of their places, kinds and values, so the order of keys makes no difference and numbers count by value.
# DuckDB lets a comma before a closing bracket pass, strict JSON does not; commas inside texts are left out of that test.
VALUE = "coalesce(" + DECODED.replace("{0}", "trim({0}, chr(32) || chr(9) || chr(10) || chr(13))") + ", CASE WHEN trim({0}, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND json_valid({0}) AND NOT regexp_matches(regexp_replace({0}, '\"([^\"\\x5c]|\\x5c.)*\"', '0', 'g'), ',\\s*[\\]}}]') THEN {0} ELSE CAST(to_json(trim({0}, chr(32) || chr(9) || chr(10) || chr(13))) AS VARCHAR) END)"
ONE_CALL = "CASE WHEN json_type(j, '$.function') = 'OBJECT' THEN json_extract(j, '$.function') ELSE j END"
PARSED = f"""t AS (SELECT pred_id, coalesce(raw_output, '') AS raw, len(regexp_extract_all(coalesce(raw_output, ''), '(?i)<tool_call\\b')) AS n_open, len(regexp_extract_all(coalesce(raw_output, ''), '(?i)</tool_call\\s*>')) AS n_close FROM predictions),
b AS (SELECT pred_id, unnest(x) AS block, generate_subscripts(x, 1) AS nb FROM (SELECT pred_id, regexp_extract_all(raw, '(?is)<tool_call>(.*?)</tool_call>', 1) AS x FROM t)),
bf AS (SELECT pred_id, nb, block, regexp_extract_all(block, '(?is)<function\\s*=\\s*([^>\\s]*)\\s*>(.*?)</function>', 1) AS fs, regexp_extract_all(block, '(?is)<function\\s*=\\s*([^>\\s]*)\\s*>(.*?)</function>', 2) AS bodies FROM b),
f AS (SELECT pred_id, nb, unnest(fs) AS name, unnest(bodies) AS body, generate_subscripts(fs, 1) AS nf FROM bf),
fp AS (SELECT pred_id, nb, nf, trim(name) AS name, regexp_extract_all(body, '(?is)<parameter\\s*=\\s*([^>\\s]+)\\s*>(.*?)</parameter>', 1) AS ks, list_transform(regexp_extract_all(body, '(?is)<parameter\\s*=\\s*([^>\\s]+)\\s*>(.*?)</parameter>', 2), lambda x: {VALUE.format('x')}) AS vs FROM f),
fc AS (SELECT pred_id, nb, nf, name, CASE WHEN ks = ['raw'] AND json_type(vs[1]) = 'OBJECT' THEN vs[1] ELSE '{{' || coalesce(array_to_string(list_transform(list_zip(ks, vs), lambda x: CAST(to_json(x[1]) AS VARCHAR) || ':' || x[2]), ','), '') || '}}' END AS args, len(ks) - len(list_distinct(ks)) AS n_twice FROM fp),
jt AS (SELECT pred_id, nb, trim(block, chr(32) || chr(9) || chr(10) || chr(13)) AS x FROM bf WHERE len(fs) = 0 UNION ALL SELECT pred_id, 0, trim(raw, chr(32) || chr(9) || chr(10) || chr(13)) FROM t WHERE n_open = 0 AND n_close = 0),
jd AS (SELECT pred_id, nb, CASE WHEN json_valid(y) AND NOT regexp_matches(regexp_replace(y, '\"([^\"\\x5c]|\\x5c.)*\"', '0', 'g'), ',\\s*[\\]}}]') THEN y END AS j FROM (SELECT pred_id, nb, trim(regexp_replace(x, '(?is)^```(json)?(.*)```$', '\\2'), chr(32) || chr(9) || chr(10) || chr(13)) AS y FROM jt)),
jl AS (SELECT pred_id, nb, unnest(CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.name') IS NOT NULL THEN [CAST(j AS JSON)] WHEN json_type(j, '$.tool_calls') = 'ARRAY' THEN json_extract(j, '$.tool_calls[*]') WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END) AS j FROM jd WHERE j IS NOT NULL),
jo AS (SELECT pred_id, nb, row_number() OVER (PARTITION BY pred_id, nb) AS nf, {ONE_CALL} AS j FROM jl),
jc AS (SELECT pred_id, nb, nf, CASE WHEN json_type(j, '$.name') = 'VARCHAR' AND trim(json_extract_string(j, '$.name')) <> '' THEN trim(json_extract_string(j, '$.name')) END AS name, json_type(j) AS kind,
 CASE WHEN json_type(j, '$.arguments') IS NULL THEN '{{}}' WHEN json_type(j, '$.arguments') = 'VARCHAR' THEN coalesce({DECODED.format("json_extract_string(j, '$.arguments')")}, CAST(json_extract(j, '$.arguments') AS VARCHAR)) ELSE CAST(json_extract(j, '$.arguments') AS VARCHAR) END AS args FROM jo),
c AS (SELECT pred_id, nb, nf, name, args FROM fc UNION ALL SELECT pred_id, nb, nf, name, CASE WHEN json_type(args) = 'OBJECT' THEN args ELSE '{{}}' END FROM jc WHERE name IS NOT NULL),
er AS (SELECT pred_id, 0 AS nb, 0 AS nf, 'unbalanced tags' AS e FROM t WHERE n_open <> n_close
 UNION ALL SELECT bf.pred_id, bf.nb, 0, 'block without function' FROM bf WHERE len(fs) = 0 AND NOT EXISTS (SELECT 1 FROM jc WHERE jc.pred_id = bf.pred_id AND jc.nb = bf.nb AND name IS NOT NULL)
 UNION ALL SELECT pred_id, nb, nf, CASE WHEN kind <> 'OBJECT' THEN 'call is no object' WHEN name IS NULL THEN 'call has no name' ELSE 'arguments are no object' END FROM jc WHERE nb = 0 AND (kind <> 'OBJECT' OR name IS NULL OR json_type(args) <> 'OBJECT')),
calls AS (SELECT pred_id, row_number() OVER (PARTITION BY pred_id ORDER BY nb, nf) AS pos, name, args FROM c),
faults AS (SELECT pred_id, count(*) AS n, string_agg(e, '; ' ORDER BY nb, nf) AS errors FROM er GROUP BY pred_id)
""".replace("\\\\", "\\")
# The parser of the benchmark: a block is one call with its first named function, and only an opening tag without any call is a fault.
BENCHMARK = PARSED.replace(
    "calls AS (SELECT",
    """bc AS (SELECT pred_id, nb, 1 AS nf, list_filter(regexp_extract_all(block, '(?i)<function\\s*=\\s*([^>\\s]+)\\s*>', 1), lambda x: x <> '')[1] AS name, block FROM b),
c2 AS (SELECT pred_id, nb, nf, name, (SELECT any_value(args) FROM fc WHERE fc.pred_id = bc.pred_id AND fc.nb = bc.nb AND fc.nf = 1) AS args FROM bc WHERE name IS NOT NULL UNION ALL SELECT c.pred_id, c.nb, c.nf, c.name, c.args FROM c JOIN jc ON c.pred_id = jc.pred_id AND c.nb = jc.nb AND c.nf = jc.nf AND c.nb > 0),
calls AS (SELECT""".replace("\\\\", "\\"),
).replace("name, args FROM c),\nfaults", "name, args FROM c2),\nfaults").replace("FROM er GROUP BY pred_id)", "FROM (SELECT pred_id, 0 AS nb, 0 AS nf, 'malformed_tool_call' AS e FROM t WHERE n_open > 0 AND pred_id NOT IN (SELECT pred_id FROM c2)) GROUP BY pred_id)")
SCORED = f"""m AS (SELECT max(pred_id) AS pred_id FROM (SELECT *, {LANG} AS lang FROM predictions) GROUP BY run, id, lang),
gold AS (SELECT pred_id, generate_subscripts(gold, 1) AS pos, trim(unnest(gold).name) AS name, unnest(gold).arguments AS raw FROM predictions),
sides AS (SELECT 'g' AS side, pred_id, pos, coalesce(name, '') AS name, coalesce({DECODED.format('raw')}, CASE WHEN json_valid(raw) AND json_type(raw) = 'VARCHAR' THEN raw END, '{{}}') AS j FROM gold UNION ALL SELECT 'o', pred_id, pos, name, args FROM calls),
keys AS (SELECT side, pred_id, pos, name, string_agg(t.fullkey || '=' || CASE WHEN t.type IN ('OBJECT', 'ARRAY', 'NULL') THEN t.type WHEN t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) ELSE t.type || CAST(t.atom AS VARCHAR) END, chr(31) ORDER BY t.fullkey) AS k FROM sides, json_tree(j) AS t GROUP BY side, pred_id, pos, name),
per AS (SELECT pred_id, list(name || chr(30) || k ORDER BY pos) FILTER (WHERE side = 'g') AS gk, list(name || chr(30) || k ORDER BY pos) FILTER (WHERE side = 'o') AS ok, list(lower(name) ORDER BY pos) FILTER (WHERE side = 'g') AS gn, list(lower(name) ORDER BY pos) FILTER (WHERE side = 'o') AS pn FROM keys GROUP BY pred_id),
s AS (SELECT p.pred_id AS pred_id, run, {LANG} AS lang, coalesce(gk, []) AS gk, coalesce(ok, []) AS ok, coalesce(gn, []) AS gn, coalesce(pn, []) AS pn, coalesce(f.n, 0) AS bad FROM predictions p LEFT JOIN per ON per.pred_id = p.pred_id LEFT JOIN faults f ON f.pred_id = p.pred_id WHERE p.pred_id IN (SELECT pred_id FROM m)),
r AS (SELECT *, len(gk) > 0 AS pos, len(gk) > 0 AND gn = pn AS names_ok, len(gk) > 0 AND list_sort(list_distinct(gn)) = list_sort(list_distinct(pn)) AS set_ok, gk = ok AS exact, list_sort(gk) = list_sort(ok) AS any_order FROM s)
"""


def _metrics_sql(parsed: str, *by: str) -> str:
    cols, pct = ", ".join(by), lambda n, d: f"round(100 * count(*) FILTER (WHERE {n}) / nullif({d}, 0), 2)"
    pos, neg = "count(*) FILTER (WHERE pos)", "count(*) FILTER (WHERE NOT pos)"
    return f"""WITH {parsed.rstrip()}, {SCORED}SELECT {cols}, count(*) AS n, {pos} AS n_pos, {neg} AS n_neg, {pct('names_ok', pos)} AS tool_pct, {pct('set_ok', pos)} AS tool_set_pct, {pct('exact', 'count(*)')} AS exact_pct, {pct('any_order', 'count(*)')} AS exact_any_order_pct,
{pct('exact AND bad = 0', 'count(*)')} AS clean_pct, {pct('NOT pos AND len(ok) = 0 AND bad = 0', neg)} AS non_call_pct, {pct('bad > 0', 'count(*)')} AS syntax_error_pct FROM r GROUP BY {cols}"""


def _merged(p: DataFrame) -> DataFrame:
    lang = F.coalesce(pairing.main_language(F.col("language")), F.lit("other"))
    return dedup.last_wins(p.withColumn("lang", lang), ["run", "id", "lang"], "pred_id")


def _scored(p: DataFrame, parser: str = "shared") -> DataFrame:
    return scoring.scored(_merged(p), parser)


def _names(p: DataFrame) -> DataFrame:
    """Name metrics that need no full parse: share of rows whose called names equal the gold names, in order."""
    want = F.coalesce(F.filter(F.transform("gold", lambda c: name_key(c["name"])), lambda x: x != ""), F.array().cast("array<string>"))
    got = F.coalesce(F.transform(O.called_names(F.col("raw_output")), name_key), F.array().cast("array<string>"))
    r = p.select("run", F.size(want).alias("n_gold"), (want == got).alias("same"))
    return r.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("n_gold") > 0).alias("n_pos"), F.count_if(F.col("same") & (F.col("n_gold") > 0)).alias("pos_ok"), F.count_if(F.col("same") & (F.col("n_gold") == 0)).alias("neg_ok"))


def _classes(p: DataFrame) -> DataFrame:
    first = lambda c: F.coalesce(F.nullif(F.get(c, F.lit(0)), F.lit("")), F.lit("no call"))
    gold = first(F.transform("gold", lambda c: name_key(c["name"])))
    return p.select("run", gold.alias("gold"), first(F.transform(O.called_names(F.col("raw_output")), name_key)).alias("predicted"))


def _report(p: DataFrame) -> DataFrame:
    """Exact-match table, runs by language, as texts."""
    m = scoring.metrics(_scored(p), "run", "lang")
    return reports.pivot_report(m, "run", "lang", ["en", "vi", "other"], F.format_number("exact_pct", 2))


def _errors(p: DataFrame) -> DataFrame:
    """Right, wrong, translated, partial and missing values of each gold argument, by run and key, without a key list."""
    cls = F.col("cls")
    return scoring.argument_errors(p).groupBy("run", "key").agg(F.count("*").alias("n"), F.count_if(cls.isNull()).alias("right"), *[F.count_if(cls == k).alias(c) for k, c in (("W", "wrong"), ("T", "transformed"), ("P", "partial"), ("I", "missing"))])


def queries() -> dict[str, Query]:
    pred = on("predictions")
    return {
        "prediction_merge": pred(lambda p: _merged(p).select("run", "id", "lang", "pred_id", "batch_size")),
        "output_calls": pred(lambda p: p.select("pred_id", O.parse_output(F.col("raw_output")).alias("o")).select("pred_id", F.size("o.calls").alias("n_calls"), F.array_join(F.transform("o.calls", lambda c: c["name"]), "|").alias("names"), F.array_join("o.errors", "; ").alias("errors"))),
        "output_calls_benchmark": pred(lambda p: p.select("pred_id", O.parse_output(F.col("raw_output"), "benchmark").alias("o")).select("pred_id", F.size("o.calls").alias("n_calls"), F.array_join("o.errors", "; ").alias("errors"))),
        "tag_balance": pred(lambda p: p.select("pred_id", O.tag_counts(F.coalesce("raw_output", F.lit("")))[0].alias("n_open"), O.tag_counts(F.coalesce("raw_output", F.lit("")))[1].alias("n_close")).withColumn("balanced", F.col("n_open") == F.col("n_close"))),
        "called_names": pred(lambda p: p.where("raw_output is not null").select("pred_id", F.array_join(O.called_names(F.col("raw_output")), "|").alias("names"))),
        "score_names": pred(_names),
        "score_metrics": pred(lambda p: scoring.metrics(_scored(p), "run")),
        "score_metrics_benchmark": pred(lambda p: scoring.metrics(_scored(p, "benchmark"), "run")),
        "score_by_language": pred(lambda p: scoring.metrics(_scored(p), "run", "lang")),
        "run_gap": pred(lambda p: scoring.gap(scoring.metrics(_scored(p), "run"), "run", "e4", "e0", ["tool_pct", "exact_pct", "non_call_pct"])),
        "metrics_report": pred(_report),
        "latency_percentiles": pred(lambda p: scoring.latency(p, "run")),
        "latency_by_tools": pred(lambda p: scoring.latency(p, "n_tools")),
        "class_scores": pred(lambda p: scoring.confusion_scores(_classes(p))),
        "macro_f1": pred(lambda p: scoring.macro_f1(scoring.confusion_scores(_classes(p)))),
        "argument_errors": pred(_errors),
        "bootstrap_ci": pred(lambda p: scoring.bootstrap(scoring.scored(p).select("pred_id", F.col("exact").cast("double").alias("v")), "pred_id", "v")),
    }


def oracle_sql() -> dict[str, str]:
    classes = f"""WITH c AS (SELECT coalesce(nullif(lower(trim(gold[1].name)), ''), 'no call') AS g, coalesce(nullif(lower(trim(({CALLED})[1])), ''), 'no call') AS p FROM predictions),
n AS (SELECT g AS cls, CASE WHEN g = p THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN g <> p THEN 1 ELSE 0 END AS fn FROM c UNION ALL SELECT p, 0, 1, 0 FROM c WHERE g <> p),
a AS (SELECT cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM n GROUP BY cls),
s AS (SELECT cls, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM a)
"""
    table = _metrics_sql(PARSED, "run", "lang")
    return {
        "output_calls": "WITH " + PARSED + "SELECT p.pred_id AS pred_id, CAST(coalesce(n, 0) AS INT) AS n_calls, coalesce(names, '') AS names, coalesce(errors, '') AS errors FROM predictions p LEFT JOIN (SELECT pred_id, count(*) AS n, string_agg(name, '|' ORDER BY pos) AS names FROM calls GROUP BY pred_id) c ON c.pred_id = p.pred_id LEFT JOIN (SELECT pred_id, errors FROM faults) f ON f.pred_id = p.pred_id",
        "output_calls_benchmark": "WITH " + BENCHMARK + "SELECT p.pred_id AS pred_id, CAST(coalesce(n, 0) AS INT) AS n_calls, coalesce(errors, '') AS errors FROM predictions p LEFT JOIN (SELECT pred_id, count(*) AS n FROM calls GROUP BY pred_id) c ON c.pred_id = p.pred_id LEFT JOIN (SELECT pred_id, errors FROM faults) f ON f.pred_id = p.pred_id",
        "score_metrics": _metrics_sql(PARSED, "run"),
        "score_metrics_benchmark": _metrics_sql(BENCHMARK, "run"),
        "score_by_language": table,
        "run_gap": "SELECT " + ", ".join(f"round(max({c}) FILTER (WHERE run = 'e4') - max({c}) FILTER (WHERE run = 'e0'), 4) AS {c}_gap" for c in ("tool_pct", "exact_pct", "non_call_pct")) + f" FROM ({_metrics_sql(PARSED, 'run')})",
        "metrics_report": "SELECT run, " + ", ".join(f"coalesce(max(printf('%.2f', exact_pct)) FILTER (WHERE lang = '{x}'), '-') AS {x}" for x in ("en", "vi", "other")) + f" FROM ({table}) GROUP BY run",
        "argument_errors": "WITH "
        + PARSED.rstrip()
        + f""", ga AS (SELECT pred_id, run, coalesce(query, '') AS query, generate_subscripts(gold, 1) AS pos, lower(trim(unnest(gold).name)) AS name, {DECODED.format('unnest(gold).arguments')} AS j FROM predictions),
sides AS (SELECT 'g' AS side, pred_id, pos, name, j FROM ga UNION ALL SELECT 'o', pred_id, pos, lower(name), args FROM calls),
nth AS (SELECT *, row_number() OVER (PARTITION BY side, pred_id, name ORDER BY pos) AS nth FROM sides),
one AS (SELECT side, pred_id, name, nth, e.key AS key, e.type AS type, e.value AS v, CASE WHEN e.type IN ('OBJECT', 'ARRAY') THEN CAST(e.value AS VARCHAR) WHEN e.type = 'NULL' THEN 'null' ELSE e.value ->> '$' END AS txt, row_number() OVER () AS nr FROM (SELECT * FROM nth WHERE json_type(j) = 'OBJECT'), json_each(j) AS e),
can AS (SELECT nr, string_agg(t.fullkey || '=' || CASE WHEN t.type IN ('OBJECT', 'ARRAY', 'NULL') THEN t.type WHEN t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) ELSE t.type || CAST(t.atom AS VARCHAR) END, chr(31) ORDER BY t.fullkey) AS k FROM one, json_tree(v) AS t GROUP BY nr),
x AS (SELECT one.*, can.k AS k FROM one JOIN can ON can.nr = one.nr),
m AS (SELECT g.pred_id AS pred_id, g.key AS key, g.txt AS gt, o.txt AS pt, coalesce(g.k = o.k, false) AS same FROM (SELECT * FROM x WHERE side = 'g') g LEFT JOIN (SELECT * FROM x WHERE side = 'o') o ON g.pred_id = o.pred_id AND g.name IS NOT DISTINCT FROM o.name AND g.nth = o.nth AND g.key = o.key),
z AS (SELECT p.run AS run, m.key AS key, CASE WHEN same THEN NULL WHEN gt IS NOT DISTINCT FROM pt THEN 'P' WHEN pt IS NULL OR pt = '' THEN 'I' WHEN contains(gt, pt) OR contains(pt, gt) THEN 'P' WHEN NOT contains(coalesce(p.query, ''), gt) THEN 'T' ELSE 'W' END AS cls FROM m JOIN predictions p ON p.pred_id = m.pred_id)
SELECT run, key, count(*) AS n, count(*) FILTER (WHERE cls IS NULL) AS "right", count(*) FILTER (WHERE cls = 'W') AS wrong, count(*) FILTER (WHERE cls = 'T') AS transformed, count(*) FILTER (WHERE cls = 'P') AS partial, count(*) FILTER (WHERE cls = 'I') AS missing FROM z GROUP BY run, key""",
        "bootstrap_ci": "WITH "
        + PARSED.rstrip()
        + ", "
        + SCORED.replace(" WHERE p.pred_id IN (SELECT pred_id FROM m)", "")
        + f""", draw AS (SELECT i, CAST(exact AS DOUBLE) AS v, ((CAST('0x' || substr(md5(CAST(pred_id AS VARCHAR)), 1, 7) AS BIGINT) * ((i * 48271 + 42) % 2147483647) + i) % 2147483647) / 2147483647 AS u FROM r, (SELECT unnest(range(1, 201)) AS i)),
w AS (SELECT i, sum(k * v) / sum(k) AS m FROM (SELECT i, v, len(list_filter({scoring.poisson_steps()}, lambda s: u >= s)) AS k FROM draw) GROUP BY i)
SELECT (SELECT round(avg(CAST(exact AS DOUBLE)), 6) FROM r) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM w""",
        "prediction_merge": f"SELECT run, id, lang, max(pred_id) AS pred_id, arg_max(batch_size, pred_id) AS batch_size FROM (SELECT *, {LANG} AS lang FROM predictions) GROUP BY 1, 2, 3",
        "tag_balance": r"""SELECT pred_id, CAST(len(regexp_extract_all(coalesce(raw_output, ''), '(?i)<tool_call\b')) AS INT) AS n_open, CAST(len(regexp_extract_all(coalesce(raw_output, ''), '(?i)</tool_call\s*>')) AS INT) AS n_close,
len(regexp_extract_all(coalesce(raw_output, ''), '(?i)<tool_call\b')) = len(regexp_extract_all(coalesce(raw_output, ''), '(?i)</tool_call\s*>')) AS balanced FROM predictions""",
        "called_names": f"SELECT pred_id, coalesce(array_to_string({CALLED}, '|'), '') AS names FROM predictions WHERE raw_output IS NOT NULL",
        "score_names": f"""WITH k AS (SELECT run, list_filter(coalesce(list_transform(gold, lambda c: lower(trim(c.name))), []), lambda x: x <> '') AS want, coalesce(list_transform({CALLED}, lambda x: lower(trim(x))), []) AS got FROM predictions)
SELECT run, count(*) AS n, count(*) FILTER (WHERE len(want) > 0) AS n_pos, count(*) FILTER (WHERE len(want) > 0 AND want = got) AS pos_ok, count(*) FILTER (WHERE len(want) = 0 AND want = got) AS neg_ok FROM k GROUP BY run""",
        "latency_percentiles": "SELECT run, count(ms) AS n, round(avg(ms), 4) AS mean_ms, round(quantile_cont(ms, 0.5), 4) AS p50_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM (SELECT run, batch_latency_ms / nullif(batch_size, 0) AS ms FROM predictions) GROUP BY run",
        "latency_by_tools": "SELECT n_tools, count(ms) AS n, round(avg(ms), 4) AS mean_ms, round(quantile_cont(ms, 0.5), 4) AS p50_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM (SELECT n_tools, batch_latency_ms / nullif(batch_size, 0) AS ms FROM predictions) GROUP BY n_tools",
        "class_scores": classes + "SELECT * FROM s",
        "macro_f1": classes + "SELECT count(*) AS n_classes, round(avg(f1), 6) AS macro_f1, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1 FROM s",
    }
