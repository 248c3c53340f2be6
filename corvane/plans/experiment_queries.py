"""Queries over experiment composition, quality rules and the checks around runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import experiments, pairing, quality
from corvane.operators.records import name_key
from corvane.plans.common import Query, on
from corvane.plans.nested_queries import DECODED
from corvane.plans.record_queries import PAIRS, SNAKE, _cache, _exploded_tools, _name, _pair_sides

# DuckDB lets a comma before a closing bracket pass, strict JSON does not
STRICT = "(json_valid({0}) AND NOT regexp_matches(regexp_replace({0}, '\"([^\"\\x5c]|\\x5c.)*\"', '0', 'g'), ',\\s*[\\]}}]'))"
ONE, TWO = ({"glaive": 40, "xlam": 60}, 20), ({"glaive": 20, "xlam": 30}, 10)


def _compose(r: DataFrame) -> DataFrame:
    en, vi = _pair_sides(r.where("split = 'train'"))
    return experiments.compose(en, vi, vi.where("source = 'custom_vi'").select("rid"), ONE, TWO)


def _sample(name: str, quota: tuple, seed: int) -> str:
    caps = " ".join(f"WHEN '{s}' THEN {n}" for s, n in quota[0].items())
    total = sum(quota[0].values()) + quota[1]
    return f"""{name}_r AS (SELECT id, rid, source, coalesce(len(function_calls) > 0, false) AS pos, sha256(concat('{seed}:', id)) AS o FROM en WHERE id IN (SELECT id FROM vi)),
{name}_n AS (SELECT * FROM {name}_r WHERE NOT pos ORDER BY o, id LIMIT {quota[1]}),
{name}_q AS (SELECT id, rid, source, pos, o FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, id) AS rn FROM {name}_r WHERE pos) WHERE rn <= CASE source {caps} ELSE 0 END),
{name}_g AS (SELECT *, 0 AS k FROM {name}_n UNION ALL SELECT *, 0 AS k FROM {name}_q),
{name} AS (SELECT id, rid FROM (SELECT * FROM {name}_g UNION ALL SELECT *, 1 AS k FROM {name}_r WHERE pos AND id NOT IN (SELECT id FROM {name}_g)) ORDER BY k, o, id LIMIT {total})"""


COMPOSED = (
    PAIRS.replace("WHERE id IS NOT NULL)", "WHERE id IS NOT NULL AND split = 'train')").rstrip()
    + ",\n"
    + _sample("a", ONE, 42)
    + ",\n"
    + _sample("b", TWO, 342)
    + """, x AS (SELECT 'e1' AS experiment, rid, 'en' AS language FROM a UNION ALL SELECT 'e2', rid, 'vi' FROM vi WHERE id IN (SELECT id FROM a)
UNION ALL SELECT e, rid, 'en' FROM b, (VALUES ('e3'), ('e4')) AS t(e) UNION ALL SELECT e, rid, 'vi' FROM vi, (VALUES ('e3'), ('e4')) AS t(e) WHERE id IN (SELECT id FROM b)
UNION ALL SELECT 'e4', rid, 'vi' FROM vi WHERE source = 'custom_vi')
"""
)


def _seen(r: DataFrame) -> DataFrame:
    """Training records whose calls name no tool that only val and test records call."""
    names = lambda df: df.select(F.explode("function_calls").alias("c")).select(name_key(F.col("c.name")).alias("name")).where("name <> ''").distinct()
    train = r.where("split = 'train'")
    rare = names(r.where("split in ('val', 'test')")).join(names(r.where("split = 'train' and source = 'xlam'")), "name", "left_anti")
    return experiments.without_unseen(train, rare).select("rid")


def _quality(r: DataFrame) -> DataFrame:
    p = pairing.pairs(*_pair_sides(r))
    return p.select("id", quality.translated_errors().alias("e")).select("id", F.size("e").alias("n_errors"), F.array_join("e", "; ").alias("errors"))


def _preflight(r: DataFrame) -> DataFrame:
    has = F.coalesce(F.size("function_calls") > 0, F.lit(False))
    return experiments.preflight(r, {"rows without rid": (F.col("rid").isNull(), 0), "positive negatives": (has & ~F.coalesce("has_tool_call", F.lit(True)), 0), "unknown sources": (~F.coalesce(F.col("source").isin("glaive", "xlam", "custom_vi"), F.lit(False)), 0)})


def queries() -> dict[str, Query]:
    rec = on("records")
    return {
        "experiment_rows": rec(_compose),
        "experiment_counts": rec(lambda r: experiments.training_counts(_compose(r).join(r.select("rid", "source"), "rid"), ["experiment", "language", "source"])),
        "experiment_unpaired": rec(lambda r: experiments.unpaired(_compose(r), r, "e3").agg(F.count("*").alias("n_unpaired"))),
        "unseen_tool_exclusion": rec(_seen),
        "prediction_alignment": on("predictions", "records")(lambda p, r: experiments.aligned(p.select("pred_id", "id", "run"), r.where("split = 'test' and id is not null").groupBy("id").agg(F.min("rid").alias("rid")), ["id"], "rid").select("pred_id", "run", "ordinal")),
        "lockstep_check": on("records", "predictions")(lambda r, p: experiments.lockstep(r.where("split = 'test' and id is not null").select("id"), p.where("id is not null").select("id"), "id")),
        "preflight_checks": rec(_preflight),
        "dataset_statistics": rec(experiments.statistics),
        "top_categories": on("records", "tool_pool")(lambda r, p: experiments.top_categories(pairing.with_category(_exploded_tools(r).select("name"), _cache(p)))),
        "input_file_counts": rec(experiments.file_counts),
        "translation_quality": rec(_quality),
        "merged_translations": rec(lambda r: quality.merged_calls(pairing.pairs(*_pair_sides(r)))),
        "fallback_parse": rec(lambda r: quality.parsed_with_fallback(r.select("rid", F.posexplode("function_calls").alias("pos", "c")).select("rid", "pos", F.col("c.arguments").alias("a")).where("a is not null"), "a").groupBy("step").agg(F.count("*").alias("n"))),
    }


def oracle_sql() -> dict[str, str]:
    seen = f"""WITH c AS (SELECT rid, split, source, {_name('x.name')} AS name FROM (SELECT rid, split, source, unnest(function_calls) AS x FROM records)),
u AS (SELECT DISTINCT name FROM c WHERE split IN ('val', 'test') AND name <> '' AND name NOT IN (SELECT name FROM c WHERE split = 'train' AND source = 'xlam' AND name <> ''))
SELECT rid FROM records WHERE split = 'train' AND rid NOT IN (SELECT rid FROM c WHERE name IN (SELECT name FROM u))"""
    return {
        "experiment_rows": COMPOSED + "SELECT experiment, rid, language FROM x",
        "experiment_counts": COMPOSED
        + """, y AS (SELECT x.experiment, x.language, r.source FROM x JOIN records r ON x.rid = r.rid)
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM y UNION ALL SELECT 'experiment', experiment, count(*) FROM y GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM y GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'none'), count(*) FROM y GROUP BY 2""",
        "experiment_unpaired": "SELECT CAST(0 AS BIGINT) AS n_unpaired",
        "unseen_tool_exclusion": seen,
        "prediction_alignment": "SELECT pred_id, run, ordinal FROM predictions p JOIN (SELECT id, min(rid) AS ordinal FROM records WHERE split = 'test' AND id IS NOT NULL GROUP BY id) t ON p.id = t.id",
        "lockstep_check": """WITH l AS (SELECT id, count(*) AS n FROM records WHERE split = 'test' AND id IS NOT NULL GROUP BY id), r AS (SELECT id, count(*) AS n FROM predictions WHERE id IS NOT NULL GROUP BY id)
SELECT count(*) FILTER (WHERE l.id IS NOT NULL AND r.id IS NOT NULL) AS n_both, count(*) FILTER (WHERE r.id IS NULL) AS only_left, count(*) FILTER (WHERE l.id IS NULL) AS only_right, count(*) FILTER (WHERE coalesce(l.n, 1) > 1 OR coalesce(r.n, 1) > 1) AS repeated FROM l FULL JOIN r ON l.id = r.id""",
        "preflight_checks": """SELECT 'rows without rid' AS name, CAST(0 AS BIGINT) AS want, count(*) FILTER (WHERE rid IS NULL) AS got, count(*) FILTER (WHERE rid IS NULL) = 0 AS ok FROM records
UNION ALL SELECT 'positive negatives', 0, count(*) FILTER (WHERE coalesce(len(function_calls) > 0, false) AND NOT coalesce(has_tool_call, true)), count(*) FILTER (WHERE coalesce(len(function_calls) > 0, false) AND NOT coalesce(has_tool_call, true)) = 0 FROM records
UNION ALL SELECT 'unknown sources', 0, count(*) FILTER (WHERE NOT coalesce(source IN ('glaive', 'xlam', 'custom_vi'), false)), count(*) FILTER (WHERE NOT coalesce(source IN ('glaive', 'xlam', 'custom_vi'), false)) = 0 FROM records""",
        "input_file_counts": "SELECT 'records.parquet' AS file, count(*) AS n FROM records",
        "translation_quality": PAIRS
        + f""", k AS (SELECT id, lg, query, function_calls, tools, list_transform(function_calls, lambda c: {_name('c.name')}) AS names, list_transform(function_calls, lambda c: coalesce(list_sort(list_distinct(json_keys({DECODED.format('c.arguments')}))), [])) AS keys FROM r),
e AS (SELECT v.id AS id, list_concat(list_filter([CASE WHEN coalesce(trim(v.query), '') = '' THEN 'query: missing' END, CASE WHEN coalesce(len(v.function_calls), 0) = 0 THEN 'calls: missing' END, CASE WHEN NOT (o.names IS NOT DISTINCT FROM v.names AND o.keys IS NOT DISTINCT FROM v.keys) THEN 'identifiers: differ from the original' END], lambda x: x IS NOT NULL),
 list_concat(coalesce(list_transform(list_filter(v.function_calls, lambda c: NOT {SNAKE.format('trim(c.name)')}), lambda c: 'call name not snake_case: ' || coalesce(c.name, 'null')), []), coalesce(list_transform(list_filter(v.tools, lambda t: NOT {SNAKE.format('trim(t.name)')}), lambda t: 'tool name not snake_case: ' || coalesce(t.name, 'null')), []))) AS e FROM k o JOIN k v ON o.id = v.id AND o.lg = 'en' AND v.lg = 'vi')
SELECT id, CAST(len(e) AS INT) AS n_errors, array_to_string(e, '; ') AS errors FROM e""",
        "fallback_parse": f"""WITH a AS (SELECT unnest(function_calls).arguments AS a FROM records), s AS (SELECT a, {STRICT.format('a')} AS ok, {STRICT.format("regexp_extract(a, '([{][^$]*[}])', 1)")} AS braces FROM a WHERE a IS NOT NULL)
SELECT CASE WHEN ok THEN 'strict' WHEN braces AND contains(a, '{{') AND contains(a, '}}') THEN 'braces' ELSE 'failed' END AS step, count(*) AS n FROM s GROUP BY 1""",
        "dataset_statistics": f"""WITH e AS (SELECT source, {_name('x.name')} AS name, {DECODED.format('x.parameters')} AS j FROM (SELECT source, unnest(tools) AS x FROM records)),
t AS (SELECT source, count(DISTINCT name) AS n_tools, round(avg(coalesce(CASE WHEN json_type(j, '$.type') = 'VARCHAR' AND json_extract_string(j, '$.type') = 'object' THEN len(json_keys(j, '$.properties')) WHEN json_type(j) = 'OBJECT' THEN len(json_keys(j)) END, 0)), 4) AS mean_parameters FROM e WHERE name <> '' GROUP BY source)
SELECT r.source AS source, count(*) AS n, round(avg(length(query)), 4) AS mean_query_length, round(avg(coalesce(len(tools), 0)), 4) AS mean_tools, round(avg(coalesce(len(function_calls), 0)), 4) AS mean_calls, coalesce(any_value(n_tools), 0) AS n_tools, any_value(mean_parameters) AS mean_parameters FROM records r LEFT JOIN t ON r.source IS NOT DISTINCT FROM t.source GROUP BY r.source""",
        "top_categories": f"""WITH t AS (SELECT {_name('x.name')} AS name FROM (SELECT unnest(tools) AS x FROM records)), c AS (SELECT {_name('name')} AS name, arg_min(feature_group, tool_id) AS category FROM tool_pool WHERE feature_group IS NOT NULL GROUP BY 1)
SELECT coalesce(category, 'Khác') AS category, count(*) AS n FROM t LEFT JOIN c ON t.name = c.name WHERE t.name <> '' GROUP BY 1 ORDER BY n DESC, category LIMIT 20""",
    }
