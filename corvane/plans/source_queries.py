"""Queries through readers and sinks: whole tables are written to the shared folder and come back; raw forms, names,
prompts and small values on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.jsonx import as_schema_udf
from corvane.operators import pairing, records, reports
from corvane.operators.records import name_key
from corvane.plans.common import Query, on
from corvane.plans.nested_queries import DECODED
from corvane.plans.record_queries import HAYSTACK, LANG, SNAKE, _haystack, _name
from corvane.session import shared_dir, table
from corvane.sources import readers, sinks
from corvane.streaming import clients
from corvane.streaming import progress as S

FAILED = "fail_id bigint, dataset string, source_index bigint, error string, model string"


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corvane-run-{uuid.uuid4().hex}"


def _strict(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    table(spark, d, "failed_output").select("fail_id", "dataset", "source_index", "error", "model").write.json(path)
    return readers.strict_jsonl(spark, path, FAILED)


def _mixed_lines(spark: SparkSession, d: str) -> str:
    """Lines of failed rows: JSON where there is an error, else broken text or, where the model is missing too, a blank."""
    path = _place(spark)
    f = table(spark, d, "failed_output")
    line = F.when(F.col("error").isNotNull(), F.to_json(F.struct("fail_id", "source_index"))).when(F.col("model").isNotNull(), F.concat(F.lit('{"fail_id": '), F.col("fail_id").cast("string"))).otherwise("")
    f.select(line.alias("value")).write.text(path)
    return path


def _lenient(spark: SparkSession, d: str) -> DataFrame:
    r = readers.lenient_jsonl(spark, _mixed_lines(spark, d), offsets=True)
    return r.select(F.get_json_object("json", "$.fail_id").cast("long").alias("fail_id"), F.get_json_object("json", "$.source_index").cast("long").alias("source_index"))


def _indices(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    table(spark, d, "failed_output").select("source_index").write.json(path)
    return readers.failed_indices(spark, path)


def _array(spark: SparkSession, d: str) -> DataFrame:
    """feature_groups, a fixed dimension, as one JSON array."""
    path = _place(spark)
    table(spark, d, "feature_groups").agg(F.to_json(F.collect_list(F.struct("feature_group", "label_en", "label_vi"))).alias("value")).write.text(path)
    return readers.json_array(spark, path, "feature_group string, label_en string, label_vi string")


def _revision(spark: SparkSession, d: str) -> str:
    """records by language and split, published as a revision."""
    path = _place(spark)
    r = table(spark, d, "records").withColumn("language", F.coalesce(pairing.main_language(F.col("language")), F.lit("other"))).withColumn("split", F.coalesce("split", F.lit("none")))
    return sinks.publish(spark, path, lambda stage: r.repartition("language", "split").write.partitionBy("language", "split").parquet(f"{stage}/records"))


def _promoted(spark: SparkSession, d: str) -> DataFrame:
    active = f"{_place(spark)}-active"
    sinks.promote(spark, _revision(spark, d), active)
    return spark.read.parquet(f"{active}/records").select("rid", "split")


def _folders(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    sinks.one_folder_per(table(spark, d, "tool_pool").select("tool_id", "name", F.coalesce("feature_group", F.lit("none")).alias("feature_group")), "feature_group", path)
    return spark.read.json(path).select("feature_group", F.input_file_name().alias("file")).groupBy("feature_group").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"))


def _json_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_place(spark)}.json"
    sinks.write_json(spark, path, [r.asDict() for r in reports.corpus_counts(table(spark, d, "records")).collect()])  # a few rows
    return spark.createDataFrame([(x["dimension"], x["value"], x["n"]) for x in sinks.read_json(spark, path)], "dimension string, value string, n long")


def _archived(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_place(spark)}/pool"
    table(spark, d, "tool_pool").select("tool_id", "name").write.parquet(path)
    done = sinks.archive(spark, [path], f"{path}-archive", dry_run=False)
    return spark.read.parquet(f"{done['target']}/pool")


def _flat(r: DataFrame) -> DataFrame:
    """records as flat raw rows and back (PRJ-03)."""
    raw = r.select(F.col("rid").cast("int").alias("id"), "query", F.to_json("function_calls").alias("answers"), F.to_json("tools").alias("tools"))
    return records.from_flat(raw).select("id", "query", F.array_join(F.transform("function_calls", lambda c: c["name"]), "|").alias("calls"), F.coalesce(F.size("tools"), F.lit(0)).alias("n_tools"))


def _tools(r: DataFrame) -> DataFrame:
    """Tools of each record with stubs for called names, and without repeats of the first definition (PRJ-04, PRJ-05)."""
    have = r.where("tools is not null and function_calls is not null")
    return have.select("rid", F.size(records.complete_tools(F.col("tools"), F.col("function_calls"))).alias("n_complete"), F.size(records.canonical_tools(F.col("tools"))).alias("n_canonical"))


def _parameters(p: DataFrame) -> DataFrame:
    """(tool_id, param, type, items, required, question) of the normalised schema of each tool (JSN-05..07, STR-14, 15,
    19)."""
    s = p.select("tool_id", F.try_parse_json(as_schema_udf("parameters")).alias("s"))
    need = F.coalesce(F.try_variant_get("s", "$.required", "array<string>"), F.array().cast("array<string>"))
    x = s.select("tool_id", need.alias("need"), F.explode(F.try_variant_get("s", "$.properties", "map<string, variant>")).alias("param", "v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    return x.select("tool_id", "param", get("$.type").alias("type"), get("$.items.type").alias("items"), F.array_contains("need", F.col("param")).alias("required"), X.schema_question(F.col("param"), get("$.description"), get("$.type"), get("$.enum", "array<string>")).alias("question"))


def _gold_schemas(r: DataFrame, p: DataFrame) -> DataFrame:
    """How many candidates have the schema of the sample's own tool and how many that of the pool (JOI-11)."""
    own = r.select("rid", F.explode("tools").alias("t")).select("rid", name_key(F.col("t.name")).alias("name"), F.col("t.parameters").alias("parameters")).where("name <> ''").groupBy("rid", "name").agg(F.min("parameters").alias("parameters"))
    pool = p.select(name_key(F.col("name")).alias("name"), "parameters").where("name <> ''").groupBy("name").agg(F.max("parameters").alias("pooled"))
    j = pairing.with_gold_schema(_haystack(r, p), own, pool.withColumnRenamed("pooled", "parameters"))
    return j.groupBy("n").agg(F.count("*").alias("n_candidates"), F.count("parameters").alias("n_schemas"), F.sum(F.length("parameters")).alias("n_chars"))


def _prompts(p: DataFrame) -> DataFrame:
    return p.select("tool_id", clients.translate_prompt(F.col("description")).alias("translate"), clients.classify_prompt(F.col("name"), F.col("description"), F.array(F.lit("a"), F.lit("b")), ["hotel", "flight"]).alias("classify"), X.category_in(F.coalesce("description", F.lit("")), ["Book", "Find", "Create"], "Khác").alias("category"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    out = _place(spark)
    bad = lambda b: b.withColumn("error", F.when(F.coalesce(F.col("value"), F.lit(-1.0)) < 0, "value: missing or negative"))
    S.run_batches(S.stream_table(spark, f"{d}/events.parquet"), bad, f"{out}/data", f"{out}/state")
    return S.run_metrics(spark, f"{out}/data").select("n_rows", "n_failed", (F.col("rows_per_second") > 0).alias("measured"))


def queries() -> dict[str, Query]:
    rec, pool = on("records"), on("tool_pool")
    return {
        "source_strict_jsonl": _strict,
        "source_lenient_jsonl": _lenient,
        "source_bad_lines": lambda s, d: readers.bad_lines(s, _mixed_lines(s, d)),
        "source_failed_indices": _indices,
        "source_json_array": _array,
        "source_split_rows": lambda s, d: readers.split_rows(s, _revision(s, d), "vi", "test").select("rid"),
        "sink_promoted": _promoted,
        "sink_folders": _folders,
        "sink_json_file": _json_file,
        "sink_archived": _archived,
        "flat_records": rec(_flat),
        "completed_tools": rec(_tools),
        "pool_parameters": pool(_parameters),
        "gold_schemas": on("records", "tool_pool")(_gold_schemas),
        "snake_case_names": pool(lambda p: p.select("tool_id", X.is_snake_case(F.col("name")).alias("ok"))),
        "tool_prompts": pool(_prompts),
        "rescaled_rates": on("checkpoints")(lambda c: c.select("ckpt_id", reports.rescaled(F.col("total_success") / F.nullif(F.col("total_success") + F.col("total_failed"), F.lit(0))).alias("pct"), reports.rescaled(F.col("total_failed").cast("double")).alias("failed"))),
        "counted_batches": on("events")(lambda e: S.counted_batches(e.select("event_id"), "event_id", 10)),
        "microbatch_metrics": _metrics,
    }


TYPE = "lower(regexp_replace(trim(coalesce({0}, 'string')), '(?i),\\s*optional\\s*$', ''))"
KIND = "CASE WHEN {0} IN ('str', 'string', 'enum') THEN 'string' WHEN {0} IN ('int', 'integer') THEN 'integer' WHEN {0} IN ('float', 'number') THEN 'number' WHEN {0} IN ('bool', 'boolean') THEN 'boolean' WHEN {0} IN ('list', 'array') OR regexp_matches({0}, '^list\\[.+\\]$') THEN 'array' WHEN {0} IN ('object', 'dict') THEN 'object' ELSE 'string' END"


def oracle_sql() -> dict[str, str]:
    kind = KIND.replace("{0}", TYPE.replace("{0}", "t"))
    return {
        "source_strict_jsonl": "SELECT fail_id, dataset, source_index, error, model FROM failed_output",
        "source_lenient_jsonl": "SELECT fail_id, source_index FROM failed_output WHERE error IS NOT NULL",
        "source_bad_lines": "SELECT count(*) AS n_lines, count(*) FILTER (WHERE error IS NULL AND model IS NULL) AS n_blank, count(*) FILTER (WHERE error IS NULL AND model IS NOT NULL) AS n_bad FROM failed_output",
        "source_failed_indices": "SELECT DISTINCT source_index FROM failed_output WHERE source_index IS NOT NULL",
        "source_json_array": "SELECT feature_group, label_en, label_vi FROM feature_groups",
        "source_split_rows": f"SELECT rid FROM records WHERE {LANG} = 'vi' AND split = 'test'",
        "sink_promoted": f"SELECT rid, coalesce(split, 'none') AS split FROM records WHERE {LANG} = 'vi'",
        "sink_folders": "SELECT coalesce(feature_group, 'none') AS feature_group, count(*) AS n, CAST(1 AS BIGINT) AS n_files FROM tool_pool GROUP BY 1",
        "sink_json_file": """WITH r AS (SELECT coalesce(source, 'none') AS s, CASE WHEN coalesce(len(function_calls), 0) > 0 THEN 'positive' ELSE 'negative' END AS p, CAST(coalesce(len(function_calls), 0) AS VARCHAR) AS c FROM records)
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM r UNION ALL SELECT 'source', s, count(*) FROM r GROUP BY s UNION ALL SELECT 'polarity', p, count(*) FROM r GROUP BY p UNION ALL SELECT 'n_calls', c, count(*) FROM r GROUP BY c""",
        "sink_archived": "SELECT tool_id, name FROM tool_pool",
        "flat_records": f"""SELECT * FROM (SELECT printf('xlam_%05d', rid) AS id, trim(query) AS query, array_to_string(list_filter(list_transform(function_calls, lambda c: c.name), lambda x: {SNAKE.format('x')}), '|') AS calls, CAST(coalesce(len(tools), 0) AS INT) AS n_tools FROM records) WHERE query <> '' AND calls <> ''""",
        "completed_tools": f"""WITH t AS (SELECT rid, tools, function_calls, list_transform(tools, lambda t: {_name('t.name')}) AS tn FROM records WHERE tools IS NOT NULL AND function_calls IS NOT NULL)
SELECT rid, CAST(len(tools) + len(list_filter(list_distinct(list_transform(function_calls, lambda c: c.name)), lambda x: NOT list_contains(list_transform(tools, lambda t: t.name), x)))
 + CASE WHEN len(list_filter(function_calls, lambda c: c.name IS NULL)) > 0 AND len(list_filter(tools, lambda t: t.name IS NULL)) = 0 THEN 1 ELSE 0 END AS INT) AS n_complete,
 CAST(len(list_filter(tools, lambda t, i: list_position(tn, tn[i]) = i OR tn[i] IS NULL OR tools[list_position(tn, tn[i])].parameters IS DISTINCT FROM t.parameters OR tools[list_position(tn, tn[i])].description IS DISTINCT FROM t.description)) AS INT) AS n_canonical FROM t""",
        "pool_parameters": f"""WITH p AS (SELECT tool_id, {DECODED.format('parameters')} AS j FROM tool_pool), s AS (SELECT *, coalesce(json_type(j, '$.type') = 'VARCHAR' AND json_extract_string(j, '$.type') = 'object', false) AS schema FROM p WHERE json_type(j) = 'OBJECT'),
k AS (SELECT tool_id, j, schema, unnest(json_keys(j, CASE WHEN schema THEN '$.properties' ELSE '$' END)) AS param FROM s),
v AS (SELECT tool_id, j, schema, param, json_extract(j, CASE WHEN schema THEN '$.properties."' ELSE '$."' END || param || '"') AS v FROM k),
w AS (SELECT tool_id, j, schema, param, v, json_extract_string(v, '$.type') AS t, nullif(trim(coalesce(json_extract_string(v, '$.description'), '')), '') AS d, json_extract_string(v, '$.enum[*]') AS e FROM v),
x AS (SELECT tool_id, param, {kind} AS type, CASE WHEN {kind} = 'array' THEN CASE WHEN json_type(v, '$.items') = 'OBJECT' THEN json_extract_string(v, '$.items.type') WHEN NOT schema THEN coalesce(nullif({KIND.replace('{0}', "regexp_extract(lower(t), '^list\\[(.+)\\]', 1)")}, ''), 'string') END END AS items,
 CASE WHEN schema THEN coalesce(list_contains(CAST(json_extract(j, '$.required') AS VARCHAR[]), param), false) ELSE json_type(v, '$.default') IS NULL AND NOT coalesce(regexp_matches(t, '(?i),\\s*optional\\s*$'), false) END AS required, coalesce(d, '') AS d, coalesce(e, []) AS e FROM w)
SELECT tool_id, param, type, items, required, concat('Param=', param, ' Desc=', d, ' Type=', type, CASE WHEN len(e) > 0 THEN ' Enum=' || array_to_string(e, '|') ELSE '' END) AS question FROM x""",
        "argument_labels": f"""WITH c AS (SELECT rid, query, tools, CAST(generate_subscripts(function_calls, 1) - 1 AS INT) AS pos, unnest(function_calls) AS c FROM records),
t AS (SELECT rid, query, pos, {DECODED.format('c.arguments')} AS args, list_filter(tools, lambda t: {_name('t.name')} = {_name('c.name')})[1].parameters AS raw FROM c),
p AS (SELECT rid, query, pos, args, {DECODED.format('raw')} AS j FROM t WHERE raw IS NOT NULL), s AS (SELECT *, coalesce(json_type(j, '$.type') = 'VARCHAR' AND json_extract_string(j, '$.type') = 'object', false) AS schema FROM p WHERE json_type(j) = 'OBJECT'),
k AS (SELECT *, unnest(json_keys(j, CASE WHEN schema THEN '$.properties' ELSE '$' END)) AS param FROM s),
v AS (SELECT rid, pos, query, param, json_extract(j, CASE WHEN schema THEN '$.properties."' ELSE '$."' END || param || '"') AS v, CASE WHEN json_type(args) = 'OBJECT' THEN json_extract(args, '$."' || param || '"') END AS a FROM k),
w AS (SELECT rid, pos, query, param, json_extract_string(v, '$.type') AS t, coalesce(json_extract_string(v, '$.enum[*]'), []) AS e, CASE WHEN json_type(a) = 'NULL' THEN NULL WHEN json_type(a) = 'VARCHAR' THEN a ->> '$' ELSE CAST(a AS VARCHAR) END AS value FROM v),
x AS (SELECT *, CASE WHEN len(e) > 0 THEN 'enum' ELSE CASE {kind} WHEN 'integer' THEN 'number' ELSE {kind} END END AS kind FROM w)
SELECT rid, pos, param, kind, value IS NOT NULL AS has_value, CASE WHEN kind IN ('string', 'number') AND strpos(query, value) > 0 AND value <> '' THEN CAST(strpos(query, value) - 1 AS INT) END AS span_start,
 CASE WHEN kind IN ('string', 'number') AND strpos(query, value) > 0 AND value <> '' THEN CAST(strpos(query, value) - 1 + length(value) AS INT) END AS span_end, CASE WHEN kind = 'enum' THEN CAST(nullif(list_position(e, value), 0) - 1 AS BIGINT) END AS enum_index,
 CASE WHEN kind = 'boolean' THEN CASE WHEN regexp_matches(query, '{X.cue_pattern(X.NO_CUES)}') THEN 1 WHEN regexp_matches(query, '{X.cue_pattern(X.YES_CUES)}') THEN 0 END END AS bool_label FROM x""",
        "gold_schemas": HAYSTACK
        + f""", o AS (SELECT rid, {_name('t.name')} AS name, min(t.parameters) AS own FROM (SELECT rid, unnest(tools) AS t FROM records) GROUP BY 1, 2), q AS (SELECT {_name('name')} AS name, max(parameters) AS pooled FROM tool_pool GROUP BY 1)
SELECT n, count(*) AS n_candidates, count(coalesce(own, pooled)) AS n_schemas, CAST(sum(length(coalesce(own, pooled))) AS BIGINT) AS n_chars FROM h LEFT JOIN o ON o.rid = h.rid AND o.name = h.name LEFT JOIN q ON q.name = h.name GROUP BY n""",
        "snake_case_names": f"SELECT tool_id, {SNAKE.format('name')} AS ok FROM tool_pool",
        "tool_prompts": """SELECT tool_id, concat('Translate the values into Vietnamese. Keep keys, names and structure.', chr(10), coalesce(description, 'null')) AS translate,
concat('Tool: ', coalesce(name, 'null'), chr(10), 'Description: ', coalesce(description, ''), chr(10), 'Parameters: a, b', chr(10), 'Answer with one of: hotel, flight') AS classify,
CASE WHEN contains(coalesce(description, ''), 'Book') THEN 'Book' WHEN contains(coalesce(description, ''), 'Find') THEN 'Find' WHEN contains(coalesce(description, ''), 'Create') THEN 'Create' ELSE coalesce(nullif(trim(coalesce(description, '')), ''), 'Khác') END AS category FROM tool_pool""",
        "rescaled_rates": "SELECT ckpt_id, CASE WHEN x <= 1 THEN round(x * 100, 2) ELSE x END AS pct, CASE WHEN y <= 1 THEN round(y * 100, 2) ELSE y END AS failed FROM (SELECT ckpt_id, total_success / nullif(total_success + total_failed, 0) AS x, CAST(total_failed AS DOUBLE) AS y FROM checkpoints)",
        "counted_batches": "SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 10) AS BIGINT) AS batch FROM events",
        "microbatch_metrics": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL OR value < 0) AS n_failed, true AS measured FROM events",
    }
