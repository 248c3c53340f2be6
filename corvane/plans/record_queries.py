"""Queries over records, their pairs, splits, tools and samples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import jsonx
from corvane.functions import text as X
from corvane.operators import dedup, labels, pairing, pool, records, reports, sampling, split
from corvane.operators.graph import components, dominant_stratum
from corvane.operators.records import name_key, names
from corvane.plans.common import Query, on
from corvane.plans.nested_queries import DECODED

KEY = r"trim(lower(regexp_replace(query, '[ \t\n\x0B\f\r]+', ' ', 'g')))"
# NFKC for what the tables hold: full-width forms by a table, blanks by a class, the rest is NFC
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NFKC = f"trim(regexp_replace(replace(lower(nfc_normalize(translate(query, '{WIDE}', '{''.join(map(chr, range(0x21, 0x7F))).replace(chr(39), chr(39) * 2)}'))), 'ß', 'ss'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
LANG = "CASE WHEN regexp_matches(lower(trim(language)), '^(en|eng)([-_]|$)') THEN 'en' WHEN regexp_matches(lower(trim(language)), '^(vi|vie)([-_]|$)') THEN 'vi' END"
NAME = r"lower(regexp_replace(regexp_replace({}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', ''))"
N = "n.name"


def _name(x: str) -> str:
    return NAME.replace("{}", x).replace("{{", "{").replace("}}", "}")


def _pair_sides(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pairing.one_per_id(r, "en"), pairing.one_per_id(r, "vi")


PAIRS = f"""WITH l AS (SELECT *, {LANG} AS lg FROM records WHERE id IS NOT NULL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lg ORDER BY rid) AS rn FROM l WHERE lg IS NOT NULL) WHERE rn = 1),
en AS (SELECT * FROM r WHERE lg = 'en'), vi AS (SELECT * FROM r WHERE lg = 'vi')
"""
FLAT_CALLS = r"coalesce(array_to_string(list_transform(function_calls, lambda c: concat(coalesce(lower(trim(c.name)), ''), chr(31), coalesce(c.arguments, ''))), chr(30)), '')"
FLAT_TOOLS = r"coalesce(array_to_string(list_transform(tools, lambda c: concat(coalesce(lower(trim(c.name)), ''), chr(31), coalesce(c.parameters, ''))), chr(30)), '')"
DEDUP = f"""WITH k AS (SELECT rid, id, {LANG} AS lg, concat_ws(chr(29), coalesce(source, ''), coalesce({KEY}, ''), {FLAT_CALLS}, {FLAT_TOOLS}) AS sk FROM records),
a AS (SELECT *, row_number() OVER (PARTITION BY id, lg ORDER BY rid) AS n_id FROM k),
b AS (SELECT *, CASE WHEN n_id = 1 THEN row_number() OVER (PARTITION BY n_id = 1, sk ORDER BY rid) END AS n_sc FROM a),
c AS (SELECT rid, CASE WHEN n_id > 1 THEN 'duplicate_id' WHEN n_sc > 1 THEN 'duplicate_scenario' END AS reason FROM b)
"""


COMPONENTS = PAIRS.replace("WITH l", "WITH RECURSIVE l") + f""", e AS (SELECT DISTINCT 'en:' || (SELECT {KEY} FROM (SELECT en.query AS query)) AS a, 'vi:' || (SELECT {KEY} FROM (SELECT vi.query AS query)) AS b FROM en JOIN vi ON en.id = vi.id WHERE trim(en.query) <> '' AND trim(vi.query) <> ''),
u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
c AS (SELECT x, y FROM u UNION SELECT c.x, u.y FROM c JOIN u ON c.y = u.x)
"""


STRATA = COMPONENTS + f""", n AS (SELECT x AS node, min(y) AS root FROM c GROUP BY x),
g AS (SELECT n.root AS grp, source, coalesce(len(function_calls) > 0, false) AS positive FROM en JOIN n ON n.node = 'en:' || {KEY}),
k AS (SELECT grp, source, positive, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, source, positive) AS rn FROM g GROUP BY 1, 2, 3)
"""
HASH_SPLIT = f"SELECT rid, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT rid, CAST(('0x' || substr(sha256({KEY}), 1, 8)) AS BIGINT) % 100 AS h FROM records WHERE query IS NOT NULL)"
DECONTAMINATED = f"""WITH k AS (SELECT rid, split, nullif({KEY}, '') AS key, CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 WHEN 'train' THEN 2 END AS p FROM records WHERE split IS NOT NULL)
SELECT rid, split FROM (SELECT *, min(p) OVER (PARTITION BY key) AS b FROM k) WHERE key IS NULL OR p = b"""
# the fold over groups in shuffled order, one step of a recursion for each rank, all strata at once
GREEDY = (
    STRATA.replace(KEY, NFKC).rstrip()
    + """, w AS (SELECT g.grp AS grp, concat_ws('/', k.source, CASE WHEN k.positive THEN 'true' ELSE 'false' END) AS stratum, CAST(count(*) AS DOUBLE) AS w, sha256('42:' || g.grp) AS o FROM g JOIN k ON k.grp = g.grp AND k.rn = 1 GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY o, grp) AS i, sum(w) OVER (PARTITION BY stratum) AS total FROM w),
f AS (SELECT stratum, grp, i, CASE WHEN dt >= dv AND dt >= ds THEN 'train' WHEN dv >= ds THEN 'val' ELSE 'test' END AS split, dt - CASE WHEN dt >= dv AND dt >= ds THEN w ELSE 0 END AS dt, dv - CASE WHEN NOT (dt >= dv AND dt >= ds) AND dv >= ds THEN w ELSE 0 END AS dv, ds - CASE WHEN NOT (dt >= dv AND dt >= ds) AND NOT dv >= ds THEN w ELSE 0 END AS ds
 FROM (SELECT stratum, grp, i, w, total * CAST(0.8 AS DOUBLE) AS dt, total * CAST(0.1 AS DOUBLE) AS dv, total * CAST(0.1 AS DOUBLE) AS ds FROM z WHERE i = 1)
 UNION ALL SELECT z.stratum, z.grp, z.i, CASE WHEN f.dt >= f.dv AND f.dt >= f.ds THEN 'train' WHEN f.dv >= f.ds THEN 'val' ELSE 'test' END, f.dt - CASE WHEN f.dt >= f.dv AND f.dt >= f.ds THEN z.w ELSE 0 END, f.dv - CASE WHEN NOT (f.dt >= f.dv AND f.dt >= f.ds) AND f.dv >= f.ds THEN z.w ELSE 0 END, f.ds - CASE WHEN NOT (f.dt >= f.dv AND f.dt >= f.ds) AND NOT f.dv >= f.ds THEN z.w ELSE 0 END FROM f JOIN z ON z.stratum = f.stratum AND z.i = f.i + 1)
"""
    + f"SELECT en.rid AS rid, n.root AS grp, f.split AS split FROM en JOIN n ON n.node = 'en:' || {NFKC} JOIN f ON f.grp = n.root"
)
# top-level arguments; a value that holds other values counts as its JSON text
ARGUMENTS = f"""WITH a AS (SELECT rid, CAST(generate_subscripts(function_calls, 1) - 1 AS INT) AS pos, unnest(function_calls).arguments AS raw FROM records),
j AS (SELECT rid, pos, {DECODED.format('raw')} AS j FROM a),
v AS (SELECT rid, pos, e.key AS key, CASE WHEN e.type IN ('OBJECT', 'ARRAY') THEN CAST(e.value AS VARCHAR) ELSE e.value ->> '$' END AS value FROM (SELECT * FROM j WHERE json_type(j) = 'OBJECT'), json_each(j) AS e)
"""
NORMALIZED_TEXT = "trim(regexp_replace(replace(lower(nfc_normalize(value)), 'ß', 'ss'), '[\\s\\p{Z}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
NORMALIZED = f"""CASE WHEN {NORMALIZED_TEXT} IN ('true', 'yes', 'có', 'đúng') THEN 'true' WHEN {NORMALIZED_TEXT} IN ('false', 'no', 'không', 'sai') THEN 'false'
 WHEN regexp_matches({NORMALIZED_TEXT}, '^-?\\d{{1,15}}([.,]\\d{{1,6}})?$') THEN regexp_replace(regexp_replace(printf('%.6f', CAST(replace({NORMALIZED_TEXT}, ',', '.') AS DOUBLE)), '0+$', ''), '\\.$', '')
 WHEN regexp_matches({NORMALIZED_TEXT}, '^\\d{{1,2}}[/.-]\\d{{1,2}}[/.-]\\d{{4}}$') THEN concat_ws('-', regexp_extract({NORMALIZED_TEXT}, '\\d{{4}}$'), lpad(regexp_extract({NORMALIZED_TEXT}, '^\\d{{1,2}}[/.-](\\d{{1,2}})', 1), 2, '0'), lpad(regexp_extract({NORMALIZED_TEXT}, '^\\d{{1,2}}'), 2, '0')) ELSE {NORMALIZED_TEXT} END"""


def _dedup(r: DataFrame, key=dedup.scenario_key, text=X.ascii_key) -> DataFrame:
    k = key(text(F.col("query")), F.col("source"), F.col("function_calls"), F.col("tools"))
    rows = r.select("rid", "id", pairing.main_language(F.col("language")).alias("lg"), k.alias("sk"))
    return dedup.first_wins(rows, ["id", "lg"], "sk", "rid").select("rid", "reason")


def _components(r: DataFrame, text=X.ascii_key) -> DataFrame:
    en, vi = _pair_sides(r)
    k = lambda lang: F.concat(F.lit(f"{lang}:"), text(F.col("query")))
    e = en.where("trim(query) <> ''").select("id", k("en").alias("a")).join(vi.where("trim(query) <> ''").select("id", k("vi").alias("b")), "id")
    return components(e, "a", "b")


def _groups(r: DataFrame, text=X.ascii_key) -> DataFrame:
    """(rid, id, source, positive, grp): the component of each English record that has a pair."""
    en, _ = _pair_sides(r)
    c = _components(r, text).withColumnRenamed("root", "grp")
    return en.select("rid", "id", "source", (F.coalesce(F.size("function_calls"), F.lit(0)) > 0).alias("positive"), F.concat(F.lit("en:"), text(F.col("query"))).alias("node")).join(c, "node").drop("node")


def _greedy(r: DataFrame) -> DataFrame:
    g = _groups(r, X.query_key)
    size = g.groupBy("grp").agg(F.count("*").alias("size"))
    s = dominant_stratum(g, "grp", "source", "positive").select("grp", F.concat_ws("/", "s0", F.col("s1").cast("string")).alias("stratum"))
    return split.greedy_group_split(size.join(s, "grp")).join(g.select("grp", "rid"), "grp").select("rid", "grp", "split")


def _reasons(d: DataFrame) -> DataFrame:
    return d.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _leak(r: DataFrame, key=dedup.scenario_key, text=X.ascii_key) -> DataFrame:
    sk = key(text(F.col("query")), F.col("source"), F.col("function_calls"), F.col("tools"))
    return dedup.leakage(r, {"id": F.col("id"), "query": F.nullif(text(F.col("query")), F.lit("")), "scenario": sk})


def _strata(r: DataFrame, text=X.ascii_key) -> DataFrame:
    return dominant_stratum(_groups(r, text), "grp", "source", "positive").select("grp", F.col("s0").alias("source"), F.col("s1").alias("positive"))


def _hash_split(r: DataFrame, text=X.ascii_key) -> DataFrame:
    return r.where("query is not null").select("rid", dedup.hash_split(text(F.col("query"))).alias("split"))


def _decontaminated(r: DataFrame, text=X.ascii_key) -> DataFrame:
    return dedup.keep_highest_split(r.where("split is not null").select("rid", "split", F.nullif(text(F.col("query")), F.lit("")).alias("key")), "key").select("rid", "split")


def _exploded_tools(r: DataFrame) -> DataFrame:
    t = r.select("rid", "source", F.posexplode("tools").alias("pos", "t")).select("rid", "source", "pos", name_key(F.col("t.name")).alias("name"), "t.feature_group", "t.description", "t.parameters")
    return t.where("name <> ''")


def _cache(p: DataFrame) -> DataFrame:
    return p.where("feature_group is not null").groupBy(name_key(F.col("name")).alias("name")).agg(F.min_by("feature_group", "tool_id").alias("category"))


def _enriched(r: DataFrame, p: DataFrame, g: DataFrame) -> DataFrame:
    t = pairing.with_category(_exploded_tools(r).select("rid", "pos", "name"), _cache(p))
    return t.join(pairing.small(g.select(F.col("feature_group").alias("category"), "label_en")), "category", "left").select("rid", "pos", "name", "category", F.coalesce("label_en", F.lit("-")).alias("label"))


def _positive(c: str = "function_calls"):
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _positional(r: DataFrame, f: DataFrame) -> DataFrame:
    en, vi = _pair_sides(r)
    idx = F.regexp_extract("id", r"_(\d+)$", 1).cast("long")
    src = pairing.without_failed(en.select("rid", F.col("source").alias("dataset"), idx.alias("source_index")), f, ["dataset", "source_index"])
    out = vi.select(F.col("rid").alias("vi_rid"), F.col("source").alias("dataset"))
    return pairing.positional(src, out, "rid", "vi_rid", "dataset").select("dataset", F.col("k").cast("int").alias("k"), "rid", "vi_rid")


SIZES = [3, 10, 50, 100, 500, 1000]


def _haystack(r: DataFrame, p: DataFrame) -> DataFrame:
    a = sampling.stratified_sample(r.select("rid", "function_calls"), "rid", _positive(), 200).select("rid", F.coalesce(F.array_compact(names(F.col("function_calls"))), F.array().cast("array<string>")).alias("gold"))
    return sampling.nested_candidates(a, p.select(name_key(F.col("name")).alias("name")), SIZES)


HAYSTACK = f"""WITH a AS (SELECT rid, list_slice(list_distinct_ordered, 1, 1000) AS gold FROM (SELECT rid, coalesce(list_filter(list_transform(function_calls, lambda c: {_name('c.name')}), lambda x: x IS NOT NULL), []) AS g,
 list_filter(g, lambda x, i: list_position(g, x) = i) AS list_distinct_ordered FROM (SELECT * FROM (SELECT rid, function_calls, sha256(concat('42:', rid)) AS o, row_number() OVER (PARTITION BY coalesce(len(function_calls) > 0, false) ORDER BY sha256(concat('42:', rid)), rid) > 100 AS extra FROM records) ORDER BY extra, o, rid LIMIT 200))),
n AS (SELECT DISTINCT {_name('name')} AS name FROM tool_pool WHERE name IS NOT NULL),
c AS (SELECT a.rid, n.name, len(a.gold) AS g, row_number() OVER (PARTITION BY a.rid ORDER BY sha256(concat('42:', a.rid, ':', n.name)), n.name) AS rn FROM a, n WHERE NOT list_contains(a.gold, n.name)),
s AS (SELECT unnest({SIZES}) AS n),
h AS (SELECT c.rid, CAST(s.n AS INT) AS n, CAST(c.rn + c.g AS INT) AS nth, c.name, false AS is_gold FROM c, s WHERE c.rn <= s.n - c.g
UNION ALL SELECT rid, CAST(s.n AS INT) AS n, CAST(p AS INT) AS nth, gold[p] AS name, true AS is_gold FROM (SELECT rid, gold, unnest(range(1, len(gold) + 1)) AS p FROM a), s WHERE p <= s.n)
"""


def _purity(r: DataFrame, p: DataFrame) -> DataFrame:
    from corvane.operators.retrieval import domain_purity

    return domain_purity(_haystack(r, p), _cache(p).withColumnRenamed("category", "grp"))


def _validated(r: DataFrame) -> DataFrame:
    return records.validated(r)


def _rejects(r: DataFrame) -> DataFrame:
    v = _validated(r)
    en, vi = _pair_sides(v)
    j = en.select("id", F.col("errors").alias("e"), F.col("ok").alias("eo")).join(vi.select("id", F.col("errors").alias("v"), F.col("ok").alias("vo")), "id")
    return j.where("not (eo and vo)").select("id", F.array_join("e", "; ").alias("en_errors"), F.array_join("v", "; ").alias("vi_errors"))


SNAKE = "coalesce(regexp_matches({}, '^[a-z][a-z0-9_]*$'), false)"
LACKING = """list_filter([
 CASE WHEN coalesce(trim(id), '') = '' THEN 'id: empty' END,
 CASE WHEN NOT coalesce(source IN ('glaive', 'xlam', 'custom_vi'), false) THEN 'source: unknown' END,
 CASE WHEN NOT coalesce(starts_with(id, source || '_'), false) THEN 'id: prefix is not the source' END,
 CASE WHEN coalesce(trim(query), '') = '' THEN 'query: empty' END,
 CASE WHEN function_calls IS NULL THEN 'calls: null' END,
 CASE WHEN coalesce(len(tools), 0) = 0 THEN 'tools: empty' END
], lambda x: x IS NOT NULL)"""
BROKEN = f"""list_filter([
 CASE WHEN len(list_filter(tools, lambda t: NOT {SNAKE.format('t.name')})) > 0 THEN 'tools: name not snake_case' END,
 CASE WHEN len(list_distinct(tn)) + CASE WHEN len(list_filter(tn, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END < len(tn) THEN 'tools: repeated name' END,
 CASE WHEN len(list_filter(function_calls, lambda c: NOT {SNAKE.format('c.name')})) > 0 THEN 'calls: name not snake_case' END,
 CASE WHEN len(list_filter(cn, lambda x: NOT coalesce(list_contains(tn, x), false))) > 0 AND tn IS NOT NULL THEN 'calls: not in tools' END,
 CASE WHEN len(list_filter(function_calls, lambda c: coalesce(json_type({DECODED.format('c.arguments')}), '') <> 'OBJECT')) > 0 THEN 'calls: arguments are no object' END
], lambda x: x IS NOT NULL)"""
NAMED = f"k AS (SELECT *, list_transform(tools, lambda t: {_name('t.name')}) AS tn, list_transform(function_calls, lambda c: {_name('c.name')}) AS cn FROM records)"
VALID = f"""WITH {NAMED}, l AS (SELECT *, {LACKING} AS lacking, {BROKEN} AS broken FROM k), v AS (SELECT *, CASE WHEN len(lacking) > 0 THEN lacking ELSE broken END AS errors FROM l)
"""
LEGACY = f"""WITH {NAMED}, l AS (SELECT *, list_filter([CASE WHEN coalesce(trim(id), '') = '' THEN 'id: empty' END, CASE WHEN coalesce(trim(query), '') = '' THEN 'query: empty' END,
 CASE WHEN coalesce(len(function_calls), 0) = 0 THEN 'calls: empty' END, CASE WHEN tools IS NULL THEN 'tools: null' END], lambda x: x IS NOT NULL) AS lacking,
 list_filter([CASE WHEN len(list_filter(cn, lambda x: NOT coalesce(list_contains(tn, x), false))) > 0 THEN 'calls: not in tools' END,
 CASE WHEN len(list_filter(function_calls, lambda c: coalesce(json_type({DECODED.format('c.arguments')}), '') <> 'OBJECT')) > 0 THEN 'calls: arguments are no object' END,
 CASE WHEN len(list_filter(tools, lambda t: NOT {SNAKE.format('t.name')})) > 0 THEN 'tools: name not snake_case' END,
 CASE WHEN len(list_filter(tools, lambda t: coalesce(trim(t.feature_group), '') = '')) > 0 THEN 'tools: no feature group' END], lambda x: x IS NOT NULL) AS broken FROM k),
v AS (SELECT *, CASE WHEN len(lacking) > 0 THEN lacking ELSE broken END AS errors FROM l)
"""
# what is inside JSON: schemas by a walk over the properties and items of JSON Schemas (the flat form has no faults once
# it is normalised), arguments against the first tool of their name
DEEP = VALID.rstrip() + f""",
t AS (SELECT rid, pos, {_name('x.name')} AS name, {DECODED.format('x.parameters')} AS j FROM (SELECT rid, unnest(tools) AS x, generate_subscripts(tools, 1) AS pos FROM records)),
tf AS (SELECT rid, name, j, coalesce(json_type(j, '$.type') = 'VARCHAR' AND json_extract_string(j, '$.type') = 'object', false) AS schema FROM (SELECT *, row_number() OVER (PARTITION BY rid, name ORDER BY pos) AS nth FROM t) WHERE nth = 1),
td AS (SELECT rid, name, CASE WHEN schema THEN coalesce(json_keys(j, '$.properties'), []) WHEN json_type(j) = 'OBJECT' THEN json_keys(j) ELSE [] END AS declared,
 CASE WHEN schema THEN coalesce(CAST(json_extract(j, '$.required') AS VARCHAR[]), []) WHEN json_type(j) = 'OBJECT' THEN list_filter(json_keys(j), lambda k: json_extract(j, '$."' || k || '".default') IS NULL AND NOT coalesce(regexp_matches(json_extract_string(j, '$."' || k || '".type'), '(?i),\\s*optional\\s*$'), false)) ELSE [] END AS needed FROM tf),
c AS (SELECT rid, {_name('x.name')} AS name, {DECODED.format('x.arguments')} AS j FROM (SELECT rid, unnest(function_calls) AS x FROM records)),
ck AS (SELECT c.rid AS rid, json_keys(c.j) AS keys, declared, needed FROM c LEFT JOIN td ON c.rid = td.rid AND c.name = td.name WHERE json_type(c.j) = 'OBJECT'),
ce AS (SELECT rid, 1 AS part, 'arguments: undeclared ' || k AS e FROM (SELECT rid, declared, unnest(keys) AS k FROM ck WHERE declared IS NOT NULL) WHERE NOT list_contains(declared, k)
 UNION SELECT rid, 2, 'arguments: missing ' || k FROM (SELECT rid, keys, unnest(needed) AS k FROM ck WHERE declared IS NOT NULL) WHERE NOT list_contains(keys, k)
 UNION SELECT rid, 3, 'arguments: key not snake_case ' || k FROM (SELECT rid, unnest(keys) AS k FROM ck) WHERE NOT {SNAKE.format('k')}
 UNION SELECT rid, 0, 'schema: ' || regexp_replace(replace(replace(n.fullkey, '.properties.', '.'), '.items', '[]'), '^', '') || CASE WHEN json_type(n.value) <> 'OBJECT' THEN ': not an object' ELSE ': unknown type None' END
  FROM (SELECT rid, j FROM t WHERE coalesce(json_type(j, '$.type') = 'VARCHAR' AND json_extract_string(j, '$.type') = 'object', false)), json_tree(j) AS n
  WHERE regexp_matches(n.fullkey, '^\\$((\\.properties\\.[^.\\[]+)|(\\.items))+$') AND (json_type(n.value) <> 'OBJECT' OR json_type(n.value, '$.type') IS NULL AND json_type(n.value, '$.properties') IS NULL)),
ca AS (SELECT rid, list(e ORDER BY part, e) AS inner_errors FROM (SELECT DISTINCT rid, part, e FROM ce) GROUP BY rid),
d AS (SELECT v.rid AS rid, id, language, CASE WHEN len(lacking) > 0 THEN lacking ELSE list_concat(broken, coalesce(inner_errors, [])) END AS errors FROM v LEFT JOIN ca ON v.rid = ca.rid)
""".replace("\\\\", "\\")


def _quota(r: DataFrame) -> DataFrame:
    return sampling.quota_sample(r.select("rid", "source", _positive().alias("p")), "rid", "source", F.col("p"), {"glaive": 60, "xlam": 80, "custom_vi": 500}, 40).select("rid", "source", "pick")


QUOTA = """WITH r AS (SELECT rid, source, coalesce(len(function_calls) > 0, false) AS pos, sha256(concat('42:', rid)) AS o FROM records),
neg AS (SELECT *, 'negative' AS pick FROM r WHERE NOT pos ORDER BY o, rid LIMIT 40),
q AS (SELECT rid, source, pos, o, 'quota' AS pick FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, rid) AS rn FROM r WHERE pos) WHERE rn <= CASE source WHEN 'glaive' THEN 60 WHEN 'xlam' THEN 80 WHEN 'custom_vi' THEN 500 ELSE 0 END),
g AS (SELECT * FROM neg UNION ALL SELECT * FROM q),
rest AS (SELECT *, 'refill' AS pick FROM r WHERE pos AND rid NOT IN (SELECT rid FROM g)),
u AS (SELECT * FROM g UNION ALL SELECT * FROM rest)
SELECT rid, source, pick FROM u ORDER BY CASE WHEN pick = 'refill' THEN 1 ELSE 0 END, o, rid LIMIT 680"""


def _args(r: DataFrame) -> DataFrame:
    """(rid, pos, key, value) of the top-level arguments of each call (JSN-04)."""
    c = r.select("rid", F.posexplode("function_calls").alias("pos", "c")).select("rid", "pos", F.try_variant_get(jsonx.parsed(F.col("c.arguments")), "$", "map<string, variant>").alias("m"))
    return c.select("rid", "pos", F.explode("m").alias("key", "v")).select("rid", "pos", "key", F.try_variant_get("v", "$", "string").alias("value"))


def _verbatim(r: DataFrame) -> DataFrame:
    """How many argument values the query holds as they are and how many not, for all keys."""
    a = _args(r).join(r.select("rid", "query"), "rid").where("query is not null and value is not null")
    return a.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.contains("query", "value")).alias("verbatim"), F.count_if(~F.contains("query", "value")).alias("transformed"))


def _taxonomy(r: DataFrame) -> DataFrame:
    """Argument values that the query does not hold as they are, by key, of the keys that its SQL names; without a
    prediction all are missing. argument_errors has all keys and classes of predictions (STR-26)."""
    a = _args(r).where(F.col("key").isin("city", "guest_name", "reference", "place_name")).join(r.select("rid", "query"), "rid").where("query is not null and value is not null")
    k = X.error_class(F.col("value"), F.lit(None).cast("string"), F.col("query"))
    return a.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.contains("query", "value")).alias("verbatim"), F.count_if(~F.contains("query", "value")).alias("transformed"), F.count_if(k == "I").alias("missing"))


def queries() -> dict[str, Query]:
    rec = on("records")
    return {
        "scenario_dedup": rec(_dedup),
        "dedup_reasons": rec(lambda r: _reasons(_dedup(r))),
        "scenario_dedup_canonical": rec(lambda r: _dedup(r, dedup.canonical_scenario_key, X.query_key)),
        "dedup_reasons_canonical": rec(lambda r: _reasons(_dedup(r, dedup.canonical_scenario_key, X.query_key))),
        "query_key_nfc": rec(lambda r: r.select("rid", X.query_key(F.col("query"), "NFC").alias("key"))),
        "query_key_nfkc": rec(lambda r: r.select("rid", X.query_key(F.col("query")).alias("key"))),
        "pair_completeness": rec(lambda r: pairing.pair_completeness(*_pair_sides(r))),
        "pair_checks": rec(lambda r: pairing.pair_checks(pairing.pairs(*_pair_sides(r)))),
        "pair_shapes": rec(lambda r: pairing.pair_shapes(pairing.pairs(*_pair_sides(r)))),
        "pair_identifiers": rec(lambda r: pairing.pairs(*_pair_sides(r)).select("id", records.identifier_integrity(F.col("en.function_calls"), F.col("vi.function_calls")).alias("same"))),
        "repeated_ids": rec(lambda r: pairing.repeated_keys(r.where("id is not null"), "id")),
        "record_validation": rec(lambda r: _validated(r).select("rid", "ok", F.array_join("errors", "; ").alias("errors"))),
        "record_validation_deep": rec(lambda r: records.validated(r, deep=True).select("rid", "ok", F.array_join("errors", "; ").alias("errors"))),
        "record_validation_legacy": rec(lambda r: records.validated(r, legacy=True).select("rid", "ok", F.array_join("errors", "; ").alias("errors"))),
        "validation_breakdown": rec(lambda r: reports.error_breakdown(_validated(r), F.col("errors"))),
        "validation_pass_rate": rec(lambda r: reports.pass_rate(_validated(r), F.col("ok"))),
        "reject_log": rec(_rejects),
        "components": rec(_components),
        "components_nfkc": rec(lambda r: _components(r, X.query_key)),
        "dominant_strata": rec(_strata),
        "dominant_strata_nfkc": rec(lambda r: _strata(r, X.query_key)),
        "greedy_split": rec(_greedy),
        "split_assignment": rec(_hash_split),
        "split_assignment_nfkc": rec(lambda r: _hash_split(r, X.query_key)),
        "ratio_split": rec(lambda r: split.ratio_split(r.where("source is not null").select("rid", "source"), "rid", part="source").select("rid", "split")),
        "split_leakage": rec(_leak),
        "split_leakage_canonical": rec(lambda r: _leak(r, dedup.canonical_scenario_key, X.query_key)),
        "decontaminate_priority": rec(_decontaminated),
        "decontaminate_priority_nfkc": rec(lambda r: _decontaminated(r, X.query_key)),
        "corpus_counts": rec(reports.corpus_counts),
        "split_counts": rec(lambda r: r.groupBy(F.coalesce(pairing.main_language(F.col("language")), F.lit("other")).alias("lang"), F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n"))),
        "normalize_stats": rec(reports.normalize_stats),
        "calls_per_sample": rec(lambda r: reports.histogram(r.where("function_calls is not null"), F.size("function_calls"))),
        "function_frequency": rec(lambda r: reports.name_frequency(r.select(F.explode("function_calls").alias("c")).select(name_key(F.col("c.name")).alias("name")).where("name <> ''"))),
        "query_length_stats": rec(lambda r: reports.length_stats(r, F.col("query"), "source")),
        "id_set_digest": rec(lambda r: reports.id_digest(r.where("split is not null"), "id", "split", "source")),
        "id_set_digest_merged": rec(lambda r: reports.id_digest(r.where("split is not null"), "id", "split")),
        "tool_pool_merge": on("tool_pool")(lambda p: pool.merge_pool(p, "tool_id", F.contains(F.col("parameters"), F.lit("type"))).select("key", "name", "description", "n")),
        "pool_category_counts": on("tool_pool")(lambda p: pool.category_counts(p, "feature_group")),
        "category_coverage": on("records", "tool_pool")(lambda r, p: pool.coverage(_exploded_tools(r), _cache(p))),
        "category_enrich": on("records", "tool_pool", "feature_groups")(_enriched),
        "pool_schemas": on("tool_pool")(lambda p: records.schema_report(p).select("tool_id", "schema", F.array_join("errors", "; ").alias("errors"))),
        "schema_shapes": on("tool_pool")(lambda p: p.select("tool_id", jsonx.schema_shape_udf(jsonx.as_schema_udf("parameters")).alias("shape"))),
        "stratified_sample": rec(lambda r: sampling.stratified_sample(r.select("rid", "source", "function_calls"), "rid", _positive(), 100).select("rid", "source")),
        "quota_sample": rec(_quota),
        "judge_sample": rec(lambda r: sampling.judge_sample(r.select("rid", "id"), "rid", 0.05)),
        "positional_pairing": on("records", "failed_output")(_positional),
        "pending_rows": on("records", "predictions")(lambda r, p: pairing.pending(r.where("split in ('val', 'test')").select("rid", "id"), p.where("run = 'e0'"), "id")),
        "nested_haystack": on("records", "tool_pool")(_haystack),
        "domain_purity": on("records", "tool_pool")(_purity),
        "length_batches": rec(lambda r: sampling.length_batches(r.select("rid", "source", "query").where("source is not null"), F.coalesce(F.length("query"), F.lit(0)), "rid", "source", 64).select("rid", F.col("batch").cast("long").alias("batch"))),
        "modulo_shard": rec(lambda r: sampling.shard(r, "rid", 4, 1).groupBy("source").agg(F.count("*").alias("n"))),
        "chat_rows": rec(lambda r: records.chat_rows(r, pairing.main_language(F.col("language"))).select("rid", "language", F.size("messages").alias("n_messages"), F.coalesce(F.size(F.col("messages")[2]["tool_calls"]), F.lit(0)).alias("n_calls"), F.size("tools").alias("n_tools"), F.array_join(records.chat_errors(F.col("messages")), "; ").alias("errors"))),
        "argument_values": rec(lambda r: _args(r).select("rid", "pos", "key", F.when(~F.col("value").rlike(r"^[\[{]"), F.col("value")).alias("value"))),
        "value_keys": rec(lambda r: _args(r).where("value is not null and not startswith(value, '{') and not startswith(value, '[')").select("rid", "pos", "key", X.strict_key(F.col("value")).alias("strict"), X.normalized_key(F.col("value")).alias("normalized"))),
        "argument_labels": rec(labels.argument_labels),
        "boolean_cues": rec(lambda r: r.select("rid", X.boolean_cue(F.col("query")).alias("cue"))),
        "error_taxonomy": rec(_taxonomy),
        "verbatim_arguments": rec(_verbatim),
        "manifest_conformance": rec(lambda r: pairing.conformance(r.where("id is not null").select("id", "split"), r.where("id is not null").groupBy("id").agg(F.min("split").alias("split")))),
        "source_differences": on("records", "predictions")(lambda r, p: pairing.differences(r.where("split = 'test' and id is not null").select("id"), p.where("id is not null").select("id"))),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "scenario_dedup": DEDUP + "SELECT rid, reason FROM c",
        "dedup_reasons": DEDUP + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM c GROUP BY 1",
        "query_key_nfc": r"SELECT rid, trim(regexp_replace(replace(lower(nfc_normalize(query)), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g')) AS key FROM records",
        "query_key_nfkc": f"SELECT rid, {NFKC} AS key FROM records",
        "components_nfkc": COMPONENTS.replace(KEY, NFKC) + "SELECT x AS node, min(y) AS root FROM c GROUP BY x",
        "dominant_strata_nfkc": STRATA.replace(KEY, NFKC) + "SELECT grp, source, positive FROM k WHERE rn = 1",
        "split_assignment_nfkc": HASH_SPLIT.replace(KEY, NFKC),
        "decontaminate_priority_nfkc": DECONTAMINATED.replace(KEY, NFKC),
        "greedy_split": GREEDY,
        "argument_values": ARGUMENTS + "SELECT rid, pos, key, CASE WHEN NOT regexp_matches(value, '^[\\[{]') THEN value END AS value FROM v",
        "value_keys": ARGUMENTS + f"SELECT rid, pos, key, nfc_normalize(value) AS strict, {NORMALIZED} AS normalized FROM v WHERE value IS NOT NULL AND NOT starts_with(value, '{{') AND NOT starts_with(value, '[')",
        "verbatim_arguments": ARGUMENTS + "SELECT key, count(*) AS n, count(*) FILTER (WHERE contains(query, value)) AS verbatim, count(*) FILTER (WHERE NOT contains(query, value)) AS transformed FROM v JOIN records r ON v.rid = r.rid WHERE query IS NOT NULL AND value IS NOT NULL GROUP BY key",
        "pair_completeness": PAIRS + "SELECT count(*) FILTER (WHERE en.id IS NOT NULL AND vi.id IS NOT NULL) AS n_pairs, count(*) FILTER (WHERE vi.id IS NULL) AS missing_vi, count(*) FILTER (WHERE en.id IS NULL) AS missing_en FROM en FULL JOIN vi ON en.id = vi.id",
        "pair_checks": PAIRS
        + f"""SELECT en.id AS id, en.source IS NOT DISTINCT FROM vi.source AS same_source, coalesce(len(en.function_calls) > 0, false) = coalesce(len(vi.function_calls) > 0, false) AS same_polarity,
list_transform(en.function_calls, lambda c: {_name('c.name')}) IS NOT DISTINCT FROM list_transform(vi.function_calls, lambda c: {_name('c.name')}) AS same_calls,
list_sort(list_transform(en.tools, lambda c: {_name('c.name')})) IS NOT DISTINCT FROM list_sort(list_transform(vi.tools, lambda c: {_name('c.name')})) AS same_tools FROM en JOIN vi ON en.id = vi.id""",
        "repeated_ids": "SELECT id, count(*) AS n FROM records WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
        "record_validation": VALID + "SELECT rid, len(errors) = 0 AS ok, coalesce(array_to_string(errors, '; '), '') AS errors FROM v",
        "record_validation_deep": DEEP + "SELECT rid, len(errors) = 0 AS ok, coalesce(array_to_string(errors, '; '), '') AS errors FROM d",
        "record_validation_legacy": LEGACY
        + "SELECT rid, len(errors) = 0 AS ok, coalesce(array_to_string(errors, '; '), '') AS errors FROM v",
        "validation_breakdown": VALID + "SELECT trim(split_part(e, ':', 1)) AS prefix, count(*) AS n FROM (SELECT unnest(errors) AS e FROM v) GROUP BY 1",
        "validation_pass_rate": VALID + "SELECT count(*) AS n, count(*) FILTER (WHERE len(errors) = 0) AS passed, round(count(*) FILTER (WHERE len(errors) = 0) / greatest(count(*), 1), 4) AS pass_rate FROM v",
        "reject_log": VALID.replace("FROM records)", f"FROM (SELECT *, {LANG} AS lg FROM records))")
        + """, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lg ORDER BY rid) AS rn FROM v WHERE lg IS NOT NULL AND id IS NOT NULL) WHERE rn = 1)
SELECT en.id AS id, array_to_string(en.errors, '; ') AS en_errors, array_to_string(vi.errors, '; ') AS vi_errors FROM r en JOIN r vi ON en.id = vi.id AND en.lg = 'en' AND vi.lg = 'vi' WHERE len(en.errors) + len(vi.errors) > 0""",
        "components": COMPONENTS + "SELECT x AS node, min(y) AS root FROM c GROUP BY x",
        "dominant_strata": STRATA + "SELECT grp, source, positive FROM k WHERE rn = 1",
        "boolean_cues": f"SELECT rid, CASE WHEN regexp_matches(query, '{X.cue_pattern(X.NO_CUES)}') THEN 1 WHEN regexp_matches(query, '{X.cue_pattern(X.YES_CUES)}') THEN 0 END AS cue FROM records",
        "id_set_digest_merged": """WITH d AS (SELECT DISTINCT split, id, sha256(id) AS h FROM records WHERE split IS NOT NULL AND id IS NOT NULL)
SELECT split, count(*) AS n, sha256(concat_ws(':', CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS digest FROM d GROUP BY split""",
        "pair_identifiers": PAIRS
        + f""", k AS (SELECT id, lg, list_transform(function_calls, lambda c: {_name('c.name')}) AS names, list_transform(function_calls, lambda c: coalesce(list_sort(list_distinct(json_keys({DECODED.format('c.arguments')}))), [])) AS keys FROM r)
SELECT e.id AS id, e.names IS NOT DISTINCT FROM v.names AND e.keys IS NOT DISTINCT FROM v.keys AS same FROM k e JOIN k v ON e.id = v.id AND e.lg = 'en' AND v.lg = 'vi'""",
        "error_taxonomy": f"""WITH c AS (SELECT rid, query, unnest(function_calls).arguments AS raw FROM records WHERE query IS NOT NULL), j AS (SELECT query, {DECODED.format('raw')} AS j FROM c),
k AS (SELECT unnest(['city', 'guest_name', 'reference', 'place_name']) AS key), v AS (SELECT key, query, json_extract_string(j, '$.' || key) AS value FROM j, k WHERE json_type(j) = 'OBJECT')
SELECT key, count(*) AS n, count(*) FILTER (WHERE contains(query, value)) AS verbatim, count(*) FILTER (WHERE NOT contains(query, value)) AS transformed, count(*) AS missing FROM v WHERE value IS NOT NULL GROUP BY key""",
        "split_assignment": HASH_SPLIT,
        "ratio_split": "SELECT rid, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (SELECT rid, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('42:', rid)), rid) AS rn, count(*) OVER (PARTITION BY source) AS n FROM records WHERE source IS NOT NULL)",
        "split_leakage": f"""WITH k AS (SELECT split, id, nullif({KEY}, '') AS q, concat_ws(chr(29), coalesce(source, ''), coalesce({KEY}, ''), {FLAT_CALLS}, {FLAT_TOOLS}) AS sk FROM records WHERE split IS NOT NULL),
l AS (SELECT split, 'id' AS kind, id AS key FROM k UNION ALL SELECT split, 'query', q FROM k UNION ALL SELECT split, 'scenario', sk FROM k)
SELECT kind, count(*) FILTER (WHERE n > 1) AS n_leaking, count(*) AS n_keys FROM (SELECT kind, key, count(DISTINCT split) AS n FROM l WHERE key IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
        "decontaminate_priority": DECONTAMINATED,
        "corpus_counts": """WITH r AS (SELECT coalesce(source, 'none') AS s, CASE WHEN coalesce(len(function_calls), 0) > 0 THEN 'positive' ELSE 'negative' END AS p, CAST(coalesce(len(function_calls), 0) AS VARCHAR) AS c FROM records)
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM r UNION ALL SELECT 'source', s, count(*) FROM r GROUP BY s UNION ALL SELECT 'polarity', p, count(*) FROM r GROUP BY p UNION ALL SELECT 'n_calls', c, count(*) FROM r GROUP BY c""",
        "split_counts": f"SELECT coalesce({LANG}, 'other') AS lang, coalesce(split, 'none') AS split, count(*) AS n FROM records GROUP BY 1, 2",
        "normalize_stats": """SELECT source, count(*) AS total, count(*) FILTER (WHERE c > 0) AS positive, count(*) FILTER (WHERE c = 0) AS negative, CAST(coalesce(min(c) FILTER (WHERE c > 0), 0) AS INT) AS calls_min, CAST(coalesce(max(c) FILTER (WHERE c > 0), 0) AS INT) AS calls_max,
round(coalesce(sum(c), 0) / greatest(count(*) FILTER (WHERE c > 0), 1), 2) AS calls_mean FROM (SELECT source, coalesce(len(function_calls), 0) AS c FROM records) GROUP BY source""",
        "calls_per_sample": "SELECT CAST(len(function_calls) AS INT) AS bucket, count(*) AS n FROM records WHERE function_calls IS NOT NULL GROUP BY 1",
        "function_frequency": f"SELECT name, count(*) AS n FROM (SELECT {_name('c.name')} AS name FROM (SELECT unnest(function_calls) AS c FROM records)) WHERE name <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 20",
        "query_length_stats": "SELECT source, count(query) AS n, CAST(min(length(query)) AS INT) AS least, CAST(max(length(query)) AS INT) AS most, round(avg(length(query)), 4) AS mean, median(length(query)) AS median FROM records GROUP BY source",
        "id_set_digest": """WITH d AS (SELECT DISTINCT split, source, id, sha256(id) AS h FROM records WHERE split IS NOT NULL AND id IS NOT NULL)
SELECT split, source, count(*) AS n, sha256(concat_ws(':', CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS digest FROM d GROUP BY split, source""",
        "tool_pool_merge": f"""WITH t AS (SELECT *, {_name('name')} AS key FROM tool_pool)
SELECT key, arg_min(name, tool_id) AS name, coalesce(arg_min(description, tool_id) FILTER (WHERE trim(description) <> ''), '') AS description, count(*) AS n FROM t WHERE key <> '' GROUP BY key""",
        "pool_category_counts": f"SELECT coalesce(feature_group, 'Khác') AS category, count(*) AS n_rows, count(DISTINCT {_name('name')}) AS n_names FROM tool_pool GROUP BY 1",
        "category_coverage": f"""WITH u AS (SELECT DISTINCT {_name('t.name')} AS name FROM (SELECT unnest(tools) AS t FROM records)), c AS (SELECT DISTINCT {_name('name')} AS name FROM tool_pool WHERE feature_group IS NOT NULL)
SELECT count(c.name) AS n_cached, count(*) FILTER (WHERE c.name IS NULL) AS n_fallback FROM u LEFT JOIN c ON u.name = c.name WHERE u.name <> ''""",
        "category_enrich": f"""WITH t AS (SELECT rid, CAST(pos - 1 AS INT) AS pos, {_name('t.name')} AS name FROM (SELECT rid, unnest(tools) AS t, generate_subscripts(tools, 1) AS pos FROM records)),
c AS (SELECT {_name('name')} AS name, arg_min(feature_group, tool_id) AS category FROM tool_pool WHERE feature_group IS NOT NULL GROUP BY 1)
SELECT rid, pos, t.name AS name, coalesce(c.category, 'Khác') AS category, coalesce(g.label_en, '-') AS label FROM t LEFT JOIN c ON t.name = c.name LEFT JOIN feature_groups g ON g.feature_group = coalesce(c.category, 'Khác') WHERE t.name <> ''""",
        "stratified_sample": """WITH r AS (SELECT rid, source, coalesce(len(function_calls) > 0, false) AS pos, sha256(concat('42:', rid)) AS o FROM records),
k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY o, rid) > 50 AS extra FROM r)
SELECT rid, source FROM k ORDER BY extra, o, rid LIMIT 100""",
        "quota_sample": QUOTA,
        "judge_sample": "SELECT rid, id FROM records ORDER BY sha256(concat('42:', rid)), rid LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) FROM records)",
        "positional_pairing": PAIRS
        + r""", f AS (SELECT DISTINCT dataset, source_index FROM failed_output WHERE dataset IS NOT NULL AND source_index IS NOT NULL),
s AS (SELECT en.source AS dataset, rid, row_number() OVER (PARTITION BY en.source ORDER BY rid) AS k FROM en WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dataset = en.source AND f.source_index = TRY_CAST(regexp_extract(en.id, '_(\d+)$', 1) AS BIGINT))),
t AS (SELECT source AS dataset, rid AS vi_rid, row_number() OVER (PARTITION BY source ORDER BY rid) AS k FROM vi)
SELECT s.dataset AS dataset, CAST(s.k AS INT) AS k, rid, vi_rid FROM s JOIN t ON s.dataset = t.dataset AND s.k = t.k""",
        "pending_rows": "SELECT rid, id FROM records r WHERE split IN ('val', 'test') AND NOT EXISTS (SELECT 1 FROM predictions p WHERE p.run = 'e0' AND p.id = r.id)",
        "nested_haystack": HAYSTACK + "SELECT * FROM h",
        "domain_purity": HAYSTACK
        + f""", g AS (SELECT {_name('name')} AS name, arg_min(feature_group, tool_id) AS grp FROM tool_pool WHERE feature_group IS NOT NULL GROUP BY 1),
gg AS (SELECT DISTINCT rid, n, g.grp AS grp FROM h JOIN g ON h.name = g.name WHERE is_gold),
x AS (SELECT h.rid, h.n, h.name, max(CASE WHEN g.grp = gg.grp THEN 1 ELSE 0 END) AS same FROM h JOIN g ON h.name = g.name JOIN gg ON gg.rid = h.rid AND gg.n = h.n WHERE NOT is_gold GROUP BY 1, 2, 3)
SELECT n, count(*) AS n_distractors, round(avg(same), 6) AS purity FROM x GROUP BY n""",
        "length_batches": "SELECT rid, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY coalesce(length(query), 0), rid) - 1) / 64) AS BIGINT) AS batch FROM records WHERE source IS NOT NULL",
        "modulo_shard": "SELECT source, count(*) AS n FROM records WHERE rid % 4 = 1 GROUP BY source",
        "chat_rows": f"""WITH k AS (SELECT rid, {LANG} AS language, function_calls AS c, tools AS t, query, list_transform(tools, lambda t: {_name('t.name')}) AS tn, list_transform(function_calls, lambda c: {_name('c.name')}) AS cn FROM records)
SELECT rid, language, 3 AS n_messages, CAST(coalesce(len(c), 0) AS INT) AS n_calls, CAST(len(t) AS INT) AS n_tools, CASE WHEN len(list_filter(c, lambda x: coalesce(trim(x.name), '') = '')) > 0 THEN 'call without a name' ELSE '' END AS errors FROM k
WHERE language IS NOT NULL AND coalesce(trim(query), '') <> '' AND len(t) > 0 AND len(list_filter(tn, lambda x: coalesce(x, '') = '')) = 0 AND len(list_filter(coalesce(cn, []), lambda x: NOT coalesce(list_contains(tn, x), false))) = 0""",
        "manifest_conformance": """WITH a AS (SELECT DISTINCT id, split AS got FROM records WHERE id IS NOT NULL), b AS (SELECT id, min(split) AS want FROM records WHERE id IS NOT NULL GROUP BY id)
SELECT CAST(0 AS BIGINT) AS not_in_manifest, CAST(0 AS BIGINT) AS not_in_files, count(*) FILTER (WHERE got IS DISTINCT FROM want) AS other_split FROM a JOIN b ON a.id = b.id""",
        "source_differences": """WITH a AS (SELECT DISTINCT id FROM records WHERE split = 'test' AND id IS NOT NULL), b AS (SELECT DISTINCT id FROM predictions WHERE id IS NOT NULL)
SELECT (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS only_b""",
    }
