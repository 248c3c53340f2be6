"""Queries of the problems of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import crosssplit, defects, langid, leaks, lookalikes, nearcopies, packing, sharedspans, splits
from corvane.llm import textform as T
from corvane.plans.nested_queries import DECODED
from corvane.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, name))


def _model(spark: SparkSession, d: str):
    return langid.train(table(spark, d, "documents"), table(spark, d, "eval_items"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda spark, d: defects.found(spark, table(spark, d, "records"), table(spark, d, "failed_output"), _model(spark, d)),
        "p2_found": _on("records", lambda r: lookalikes.changed_fields(r).select("rid", "field")),
        "p2_queries": _on("records", lookalikes.consistent_queries),
        "p3_found": _on("records", crosssplit.pairs),
        "p3_report": _on("records", crosssplit.report),
        "p3_coverage": _on("records", crosssplit.coverage),
        "p3_pair_counts": _on("records", crosssplit.pair_counts),
        "p4_found": lambda spark, d: langid.found(spark, *(table(spark, d, t) for t in ("records", "documents", "eval_items"))),
        "p4_segments": lambda spark, d: langid.languages(spark, table(spark, d, "records"), _model(spark, d)).select("rid", "field", "pos", "lang", "confidence"),
        "p5_found": _on("records", nearcopies.pairs),
        "p5_groups": _on("records", nearcopies.near_groups),
        "p7_found": _on("records", splits.groups),
        "p7_splits": _on("records", splits.balanced_splits),
        "p7_shares": _on("records", splits.split_shares),
        "p8_pack": _on("documents", packing.pack),
        "p8_containers": _on("documents", packing.containers),
        "p9_found": lambda spark, d: leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")),
        "p9_spans": lambda spark, d: leaks.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items")),
        "p10_found": _on("documents", sharedspans.shared_runs),
        "p10_share": _on("documents", sharedspans.shared_share),
    }


NAME = "lower(regexp_replace(regexp_replace({}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', ''))"
GROUPS = f"""WITH RECURSIVE t AS (SELECT DISTINCT rid, source, {NAME.format('x.name')} AS name FROM (SELECT rid, source, unnest(tools) AS x FROM records)),
n AS (SELECT * FROM t WHERE name <> ''),
e AS (SELECT DISTINCT a.source AS source, a.name AS x, b.name AS y FROM n a JOIN n b ON a.rid = b.rid),
c AS (SELECT source, x, y FROM e UNION SELECT c.source, c.x, e.y FROM c JOIN e ON c.y = e.x AND c.source IS NOT DISTINCT FROM e.source)
SELECT n.rid AS rid, n.source AS source, min(c.y) AS group_tool FROM n JOIN c ON c.x = n.name AND c.source IS NOT DISTINCT FROM n.source GROUP BY n.rid, n.source"""
SHARED = """WITH w AS (SELECT doc_id, p AS pos, md5(substr(text, CAST(p AS BIGINT) + 1, 400)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 399)) AS p FROM documents WHERE length(text) >= 400)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
k AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 400 THEN 0 ELSE 1 END AS new FROM w WHERE h IN (SELECT h FROM s)),
r AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM k),
f AS (SELECT doc_id, CAST(min(pos) AS INT) AS start_at, CAST(max(pos) + 400 AS INT) AS end_at FROM r GROUP BY doc_id, run)
"""


# ---- the consistent form and its words in SQL, from the same fixed tables ------------------------------------------------


def _set(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _move(x: str, table: dict[str, str]) -> str:
    return f"translate({x}, '{''.join(table)}', '{''.join(table.values())}')"


def _only(x: str, table: dict[str, str]) -> str:
    """Whether every character of x is a key of table."""
    return f"translate({x}, '{''.join(table)}', '') = ''"


ODD, LATIN = "\\x{370}-\\x{3ff}\\x{400}-\\x{52f}\\x{1f00}-\\x{1fff}", "A-Za-z\\x{aa}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}\\x{1e00}-\\x{1eff}"
WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c - 0xFEE0 != 0x27}
CLEAN = "nfc_normalize(" + _move(f"regexp_replace(regexp_replace(@TEXT, '[{_set(T.INVISIBLE + T.CONTROL)}]', '', 'g'), '[{_set(T.BLANK)}]', ' ', 'g')", WIDE) + ")"
TO_CYRILLIC = T.TO_CYRILLIC | T.GREEK_TO_CYRILLIC
# one word x with its odd letters o, Latin ones l and Greek ones g; s tells a Latin-script sentence
MAPPED = f"""CASE WHEN o = '' THEN x
 WHEN {_only('o', T.TO_LATIN)} THEN CASE WHEN l = '' AND (g = '' OR len(g) = len(o)) THEN CASE WHEN s THEN {_move('x', T.TO_LATIN)} ELSE x END
  WHEN NOT s AND len(g) < len(o) AND {_only('l', T.TO_CYRILLIC)} AND {_only('g', T.GREEK_TO_CYRILLIC)} THEN {_move('x', TO_CYRILLIC)} ELSE {_move('x', T.TO_LATIN)} END
 WHEN len(g) < len(o) AND (l <> '' OR g <> '') AND {_only('l', T.TO_CYRILLIC)} AND {_only('g', T.GREEK_TO_CYRILLIC)} THEN {_move('x', TO_CYRILLIC)} ELSE x END"""


def _words_sql(name: str, rows: str) -> str:
    """CTEs that end in ``name`` (k, w): the words of each text, in order; rows gives (k, t)."""
    return f"""{name}_a AS (SELECT k, {CLEAN.replace('@TEXT', 't')} AS t FROM ({rows})),
{name}_b AS (SELECT k, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT k, regexp_extract_all(t, '[^.!?…\n\r]+') AS p FROM {name}_a)),
{name}_c AS (SELECT k, i, unnest(ws) AS x, generate_subscripts(ws, 1) AS j, regexp_matches(p, '[{LATIN}]') AND {_only(f"regexp_replace(p, '[^{ODD}]', '', 'g')", T.TO_LATIN)} AS s FROM (SELECT k, i, p, regexp_extract_all(p, '[\\p{{L}}\\p{{N}}]+') AS ws FROM {name}_b)),
{name}_d AS (SELECT k, i, j, x, s, regexp_replace(x, '[^{ODD}]', '', 'g') AS o, regexp_replace(x, '[^{LATIN}]', '', 'g') AS l, regexp_replace(x, '[^\\x{{370}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1fff}}]', '', 'g') AS g FROM {name}_c),
{name} AS (SELECT k, list(lower(nfc_normalize({MAPPED})) ORDER BY i, j) AS w FROM {name}_d GROUP BY k)"""


# p3: equal ids, or similarity and function names; p5: similarity and tool overlap; both by a join over all pairs
SIMILAR = "len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
FOUND3 = f"""WITH {_words_sql('w', 'SELECT rid AS k, query AS t FROM records WHERE query IS NOT NULL')},
r AS (SELECT rid, id, CASE WHEN split = 'train' THEN 't' WHEN split IN ('val', 'test') THEN 'e' END AS side, list_distinct(w.w) AS ws, coalesce(list_filter(list_transform(function_calls, lambda c: {NAME.format('c.name')}), lambda n: n <> ''), []) AS calls FROM records LEFT JOIN w ON w.k = rid),
p AS (SELECT a.rid AS x, b.rid AS y FROM r a JOIN r b ON a.side = 't' AND b.side = 'e' AND a.calls = b.calls AND least(len(a.ws), len(b.ws)) >= 0.75 * greatest(len(a.ws), len(b.ws)) WHERE {SIMILAR.format('a.ws', 'b.ws')} >= 0.75
 UNION SELECT a.rid, b.rid FROM r a JOIN r b ON a.side = 't' AND b.side = 'e' AND a.id = b.id)
SELECT least(x, y) AS rid_a, greatest(x, y) AS rid_b FROM p"""
FOUND5 = f"""WITH {_words_sql('w', 'SELECT rid AS k, query AS t FROM records WHERE query IS NOT NULL')},
r AS (SELECT rid, list_distinct(w.w) AS ws, list_distinct(list_filter(list_transform(tools, lambda t: {NAME.format('t.name')}), lambda n: n <> '')) AS ts FROM records JOIN w ON w.k = rid),
e AS (SELECT rid, ws, ts, unnest(ts) AS tool FROM r),
p AS (SELECT DISTINCT a.rid AS rid_a, b.rid AS rid_b, a.ws AS u, b.ws AS v, a.ts AS t, b.ts AS s FROM e a JOIN e b ON a.tool = b.tool AND a.rid < b.rid AND least(len(a.ws), len(b.ws)) >= 0.75 * greatest(len(a.ws), len(b.ws)))
SELECT rid_a, rid_b FROM p WHERE {SIMILAR.format('u', 'v')} >= 0.75 AND {SIMILAR.format('t', 's')} >= 0.5"""
PHRASES = f"""WITH {_words_sql('d', 'SELECT doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL')}, {_words_sql('m', 'SELECT item_id AS k, text AS t FROM eval_items WHERE text IS NOT NULL')},
dp AS (SELECT k, p - 1 AS pl, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
mp AS (SELECT DISTINCT k, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 10)) AS p FROM m WHERE len(w) >= 12))
"""
# the form of each text (k, t)
def _form_sql(rows: str) -> str:
    return f"""q AS (SELECT k, t AS value, {CLEAN.replace('@TEXT', 't')} AS t FROM ({rows})),
b AS (SELECT k, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT k, regexp_extract_all(t, '[^.!?…\n\r]+|[.!?…\n\r]+') AS p FROM q)),
c AS (SELECT k, i, unnest(ws) AS x, generate_subscripts(ws, 1) AS j, regexp_matches(p, '[{LATIN}]') AND {_only(f"regexp_replace(p, '[^{ODD}]', '', 'g')", T.TO_LATIN)} AS s FROM (SELECT k, i, p, regexp_extract_all(p, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS ws FROM b)),
e AS (SELECT k, i, j, x, s, regexp_replace(x, '[^{ODD}]', '', 'g') AS o, regexp_replace(x, '[^{LATIN}]', '', 'g') AS l, regexp_replace(x, '[^\\x{{370}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1fff}}]', '', 'g') AS g FROM c),
f AS (SELECT k, nfc_normalize(string_agg({MAPPED}, '' ORDER BY i, j)) AS form FROM e GROUP BY k)"""


CHANGED = f"""WITH {_form_sql('SELECT rid AS k, query AS t FROM records')}
SELECT q.k AS rid, q.value AS query, CASE WHEN q.value IS NULL THEN NULL ELSE coalesce(form, '') END AS form, coalesce(q.value <> coalesce(form, ''), false) AS changed FROM q LEFT JOIN f ON f.k = q.k"""
FIELDS = f"""WITH RECURSIVE a AS (SELECT rid, unnest(function_calls).arguments AS raw FROM records), j AS (SELECT rid, {DECODED.format('raw')} AS j FROM a WHERE raw IS NOT NULL),
v AS (SELECT rid, 'query' AS field, query AS t FROM records WHERE query IS NOT NULL UNION ALL SELECT rid, 'arguments', n.atom ->> '$' FROM (SELECT * FROM j WHERE j IS NOT NULL), json_tree(j) AS n WHERE n.type = 'VARCHAR'),
u AS (SELECT t, row_number() OVER () AS k FROM (SELECT DISTINCT t FROM v)), {_form_sql('SELECT k, t FROM u')}
SELECT DISTINCT rid, field FROM v JOIN u ON u.t = v.t LEFT JOIN f ON f.k = u.k WHERE v.t <> coalesce(form, '')"""
NEAR3 = FOUND3[: FOUND3.index("\n UNION SELECT")] + ")"
PAIR_COUNTS = NEAR3 + """,
n AS (SELECT e.split AS split, e.source AS source, t.source AS source_train, count(DISTINCT y) AS n_records, count(*) AS n_pairs FROM p JOIN records t ON t.rid = x JOIN records e ON e.rid = y GROUP BY 1, 2, 3),
s AS (SELECT e.split AS split, e.source AS source, t.source AS source_train, count(*) AS n_same_id FROM records t JOIN records e ON t.split = 'train' AND e.split IN ('val', 'test') AND t.id = e.id GROUP BY 1, 2, 3)
SELECT coalesce(n.split, s.split) AS split, CASE WHEN n.split IS NULL THEN s.source ELSE n.source END AS source, CASE WHEN n.split IS NULL THEN s.source_train ELSE n.source_train END AS source_train, coalesce(n_records, 0) AS n_records, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_same_id, 0) AS n_same_id FROM n FULL JOIN s ON n.split = s.split AND n.source IS NOT DISTINCT FROM s.source AND n.source_train IS NOT DISTINCT FROM s.source_train"""
GROUPS5 = f"""WITH RECURSIVE {_words_sql('w', 'SELECT rid AS k, query AS t FROM records WHERE query IS NOT NULL')},
r AS (SELECT rid, list_sort(list_distinct(w.w)) AS ws, list_sort(list_distinct(list_filter(list_transform(tools, lambda t: {NAME.format('t.name')}), lambda n: n <> ''))) AS ts FROM records JOIN w ON w.k = rid),
k AS (SELECT rid, min(rid) OVER (PARTITION BY ws, ts) AS cid, ws, ts FROM r WHERE len(ws) > 0 AND len(ts) > 0),
e AS (SELECT DISTINCT cid, ws, ts, unnest(ts) AS tool FROM k),
p AS (SELECT DISTINCT a.cid AS x, b.cid AS y FROM e a JOIN e b ON a.tool = b.tool AND a.cid < b.cid AND least(len(a.ws), len(b.ws)) >= 0.75 * greatest(len(a.ws), len(b.ws)) WHERE {SIMILAR.format('a.ws', 'b.ws')} >= 0.75 AND {SIMILAR.format('a.ts', 'b.ts')} >= 0.5),
d AS (SELECT x, y FROM p UNION SELECT y, x FROM p), c AS (SELECT x, y FROM d UNION SELECT c.x, d.y FROM c JOIN d ON c.y = d.x),
g AS (SELECT x, least(x, min(y)) AS grp FROM c GROUP BY x), n AS (SELECT x, count(*) AS n FROM d GROUP BY x)
SELECT rid, cid, coalesce(grp, cid) AS grp, coalesce(n, 0) AS n_links FROM k LEFT JOIN g ON g.x = cid LEFT JOIN n ON n.x = cid"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": FIELDS,
        "p2_queries": CHANGED,
        "p3_pair_counts": PAIR_COUNTS,
        "p5_groups": GROUPS5,
        "p3_found": FOUND3,
        "p5_found": FOUND5,
        "p9_found": PHRASES + "SELECT DISTINCT dp.k AS doc_id, mp.k AS item_id FROM dp JOIN mp ON dp.g = mp.g",
        "p9_spans": PHRASES
        + """, hit AS (SELECT dp.k AS k, pl, mp.k AS item FROM dp JOIN mp ON dp.g = mp.g), places AS (SELECT DISTINCT k, pl FROM hit),
n AS (SELECT k, pl, CASE WHEN pl - lag(pl) OVER (PARTITION BY k ORDER BY pl) > 12 THEN 1 ELSE 0 END AS new FROM places), run AS (SELECT k, pl, sum(new) OVER (PARTITION BY k ORDER BY pl ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT hit.k AS doc_id, CAST(min(hit.pl) AS INT) AS start_word, CAST(max(hit.pl) + 12 AS INT) AS end_word, count(DISTINCT item) AS n_items FROM hit JOIN run ON run.k = hit.k AND run.pl = hit.pl GROUP BY hit.k, run.run""",
        "p7_found": GROUPS,
        "p10_found": SHARED + "SELECT doc_id, start_at, end_at FROM f",
        "p10_share": SHARED
        + """, g AS (SELECT doc_id, sum(end_at - start_at) AS n FROM f GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 4) ELSE 0.0 END AS share FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""",
    }
