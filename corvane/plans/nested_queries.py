"""Queries of problem 6."""

from __future__ import annotations

from corvane.operators import nested
from corvane.session import table


def queries():
    return {
        "p6_found": lambda spark, d: nested.linked_paths(table(spark, d, "records")),
        "p6_tools": lambda spark, d: nested.tool_rows(table(spark, d, "records")),
        "p6_calls": lambda spark, d: nested.call_rows(table(spark, d, "records")),
        "p6_parameters": lambda spark, d: nested.parameter_rows(table(spark, d, "records")),
        "p6_arguments": lambda spark, d: nested.argument_rows(table(spark, d, "records")),
    }


# JSON text that may be encoded once more, null if it is not strict
# (DuckDB lets a comma before a closing bracket pass, strict JSON does not)
DECODED = "CASE WHEN json_valid({0}) AND NOT regexp_matches({0}, ',\\s*[\\]}}]') THEN CASE WHEN json_type({0}) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({0}, '$')) THEN json_extract_string({0}, '$') END ELSE {0} END END"
FOUND = f"""WITH p AS (SELECT rid, CAST(generate_subscripts(tools, 1) - 1 AS INT) AS pos, unnest(tools).parameters AS raw FROM records),
pj AS (SELECT rid, pos, {DECODED.format('raw')} AS j FROM p WHERE raw IS NOT NULL),
po AS (SELECT rid, pos, j, coalesce(json_type(j, '$.type') = 'VARCHAR' AND json_extract_string(j, '$.type') = 'object', false) AS schema FROM pj WHERE json_type(j) = 'OBJECT'),
pt AS (SELECT rid, pos, schema, t.fullkey AS k FROM po, json_tree(j) AS t),
pk AS (SELECT rid, pos, replace(replace(regexp_replace(k, CASE WHEN schema THEN '^\\$\\.properties\\.' ELSE '^\\$\\.' END, ''), '.items.properties.', '[].'), '.properties.', '.') AS path FROM pt
 WHERE regexp_matches(k, CASE WHEN schema THEN '^\\$\\.properties\\.[^.\\[]+((\\.items)*\\.properties\\.[^.\\[]+)*$' ELSE '^\\$\\.[^.\\[]+((\\.items)*\\.properties\\.[^.\\[]+)*$' END)),
c AS (SELECT rid, CAST(generate_subscripts(function_calls, 1) - 1 AS INT) AS pos, unnest(function_calls).arguments AS raw FROM records),
cj AS (SELECT rid, pos, {DECODED.format('raw')} AS j FROM c WHERE raw IS NOT NULL),
ck AS (SELECT rid, pos, regexp_replace(t.fullkey, '^\\$\\.?', '') AS path FROM (SELECT * FROM cj WHERE json_type(j) IN ('OBJECT', 'ARRAY')), json_tree(j) AS t WHERE regexp_matches(t.fullkey, '[^\\]]$') AND t.fullkey <> '$'),
u AS (SELECT DISTINCT 'param' AS kind, rid, pos, path FROM pk UNION ALL SELECT DISTINCT 'arg', rid, pos, path FROM ck)
SELECT kind, rid, pos, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '') ELSE '' END AS parent_path, path FROM u""".replace("\\\\", "\\")

ARGUMENTS = f"""WITH c AS (SELECT rid, CAST(generate_subscripts(function_calls, 1) - 1 AS INT) AS pos, unnest(function_calls).arguments AS raw FROM records),
cj AS (SELECT rid, pos, {DECODED.format('raw')} AS j FROM c WHERE raw IS NOT NULL),
ck AS (SELECT rid, pos, t.* FROM (SELECT * FROM cj WHERE json_type(j) IN ('OBJECT', 'ARRAY')), json_tree(j) AS t WHERE t.fullkey <> '$'),
a AS (SELECT rid, pos, regexp_replace(path, '^\\$\\.?', '') AS parent_path, regexp_replace(fullkey, '^\\$\\.?', '') AS path, ends_with(fullkey, ']') AS el, key, type, atom FROM ck)
SELECT DISTINCT rid, pos, parent_path, path, CASE WHEN NOT el THEN key END AS name, CASE WHEN el THEN CAST(key AS INT) END AS at,
 CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
 CASE WHEN type = 'NULL' THEN NULL ELSE atom ->> '$' END AS value FROM a""".replace("\\\\", "\\")
PARAMETERS = FOUND.split("pk AS (")[0] + """pk AS (SELECT rid, pos, schema, k, replace(replace(regexp_replace(k, CASE WHEN schema THEN '^\\$\\.properties\\.' ELSE '^\\$\\.' END, ''), '.items.properties.', '[].'), '.properties.', '.') AS path FROM pt
 WHERE regexp_matches(k, CASE WHEN schema THEN '^\\$\\.properties\\.[^.\\[]+((\\.items)*\\.properties\\.[^.\\[]+)*$' ELSE '^\\$\\.[^.\\[]+((\\.items)*\\.properties\\.[^.\\[]+)*$' END)),
q AS (SELECT DISTINCT pk.rid AS rid, pk.pos AS pos, j, k, pk.schema AS schema, path, regexp_extract(k, '[^.]+$') AS name, regexp_replace(k, '\\.properties\\.[^.]+$', '') AS up FROM pk JOIN po ON pk.rid = po.rid AND pk.pos = po.pos)
SELECT rid, pos, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '') ELSE '' END AS parent_path, path, name, json_extract_string(j, k || '.type') AS type,
 CASE WHEN up = k THEN json_extract(j, k || '.default') IS NULL AND NOT coalesce(regexp_matches(json_extract_string(j, k || '.type'), '(?i),\\s*optional\\s*$'), false) ELSE coalesce(list_contains(CAST(json_extract(j, up || '.required') AS VARCHAR[]), name), false) END AS required,
 CAST(json_extract(j, k || '.default') AS VARCHAR) AS "default", json_extract_string(j, k || '.description') AS description, CAST(json_extract(j, k || '.enum') AS VARCHAR) AS enum FROM q""".replace("\\\\", "\\")


def oracle_sql():
    return {
        "p6_found": FOUND,
        "p6_arguments": ARGUMENTS,
        "p6_parameters": PARAMETERS,
        "p6_tools": "SELECT rid, CAST(pos - 1 AS INT) AS pos, t.name AS name, t.description AS description, t.feature_group AS feature_group FROM (SELECT rid, unnest(tools) AS t, generate_subscripts(tools, 1) AS pos FROM records)",
        "p6_calls": "SELECT rid, CAST(pos - 1 AS INT) AS pos, c.name AS name FROM (SELECT rid, unnest(function_calls) AS c, generate_subscripts(function_calls, 1) AS pos FROM records)",
    }
