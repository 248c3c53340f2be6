"""Operators on literal rows and their properties."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.operators import dedup, labels, pairing, pool, records, reports, retrieval, sampling, scoring, split
from corvane.plans import record_queries, vector_queries
from tests.fixtures import records as table
from tests.fixtures import rows, tool

SCHEMA = '{"type": "object", "properties": {"city": {"type": "string"}, "n": {"type": "integer"}, "c": {"type": "string", "enum": ["x", "y"]}}, "required": ["city"]}'


def test_rules(spark):
    flat = '{"city": {"type": "str"}, "n": {"type": "int, optional"}, "k": {"type": "int", "default": 1}}'
    broken = '{"type": "object", "properties": {"A-B": {}, "l": {"type": "array", "items": {"enum": 3, "type": "string"}}}, "required": ["x"]}'
    r = table(
        spark,
        [
            {"rid": 1, "id": "xlam_1", "source": "xlam", "query": "q", "function_calls": [("f", '{"city": "a"}')], "tools": [tool("f", SCHEMA)]},
            {"rid": 2, "id": "glaive_1", "source": "xlam", "query": " ", "tools": []},
            {"rid": 3, "id": "xlam_2", "source": "xlam", "query": "q", "function_calls": [("g", '{"z": 1}'), ("f", "[1]")], "tools": [tool("f", SCHEMA), tool("F", SCHEMA)]},
            {"rid": 4, "id": "xlam_4", "source": "xlam", "query": "q", "function_calls": [("f", '{"z": 1, "B c": 2}'), ("F ", '"{\\"city\\": 1}"'), ("f", "[1"), ("f", None)], "tools": [tool("f", SCHEMA)]},
            {"rid": 5, "id": "xlam_5", "source": "xlam", "query": "q", "function_calls": [("f", '{"n": 1}')], "tools": [tool("f", flat), tool("h", broken), tool("i", None)]},
            {"rid": 6, "id": "x", "source": "other", "query": "q", "function_calls": [("f", "{}")], "tools": [tool("f", flat), tool("No", flat)]},
            {"rid": 7, "id": "x", "query": "q", "function_calls": [], "tools": None},
            {},
        ],
    )
    got = {x["rid"]: x["errors"] for x in records.validated(r, deep=True).collect()}
    assert got[1] == []
    assert got[2] == ["id: prefix is not the source", "query: empty", "calls: null", "tools: empty"]
    assert got[3] == ["tools: name not snake_case", "tools: repeated name", "calls: not in tools", "calls: arguments are no object"]
    assert got[4] == ["calls: name not snake_case", "calls: arguments are no object", "arguments: undeclared B c", "arguments: undeclared z", "arguments: missing city", "arguments: key not snake_case B c"]
    assert got[5] == ["schema: $.A-B: unknown type None", "schema: $.l[]: enum is no list", "schema: $: required x is not declared", "arguments: missing city"]
    assert "source: unknown" in got[None]
    flat_errors = {x["rid"]: x["errors"] for x in records.validated(r).collect()}
    assert flat_errors[5] == [] and flat_errors[4] == got[4][:2]
    legacy = {x["rid"]: x["errors"] for x in records.validated(r, legacy=True).collect()}
    assert legacy[6] == ["tools: name not snake_case", "tools: no feature group"] and legacy[7] == ["calls: empty", "tools: null"] and legacy[1] == ["tools: no feature group"]


def test_raw_forms(spark):
    chat = 'USER: hi\n\nASSISTANT: <functioncall> {"name": "f", "arguments": {"a": 1}}\n\n<functioncall> {"name": "g", "arguments": {}}\n\nFUNCTION RESPONSE: {}\n\nASSISTANT: <functioncall> {"name": "h", "arguments": {}}\n\nUSER: more'
    late = 'USER: hi\n\nASSISTANT: hello\n\nUSER: again\n\nASSISTANT: <functioncall> {"name": "f", "arguments": {}}'
    df = spark.createDataFrame([(1, chat), (2, late), (3, "USER: x\n\nASSISTANT: y"), (4, None), (5, "")], "doc_id long, text string")
    got = records.from_chat(df).collect()
    assert [(r["doc_id"], r["query"], [c["name"] for c in r["function_calls"]]) for r in got] == [(1, "hi", ["f", "g"])]
    assert rows(records.negatives_from_chat(df)) == [(3, "x")]
    own = 'You may call: {"name": "f", "description": "d", "parameters": {"a": {"type": "int"}}}'
    both = spark.createDataFrame([(1, chat, own), (2, chat, "nothing here"), (3, "USER: x\n\nASSISTANT: y", own), (4, "USER: x\n\nASSISTANT: y", None)], "doc_id long, text string, system string")
    got = {r["doc_id"]: r for r in records.from_chat(both, system="system").collect()}
    assert [t["name"] for t in got[1]["tools"]] == ["f", "g"] and got[1]["tools"][0]["parameters"] == '{"properties":{"a":{"type":"integer"}},"required":["a"],"type":"object"}'
    assert [t["name"] for t in got[2]["tools"]] == ["f", "g"] and got[2]["has_tool_call"] and got[2]["source"] == "glaive"
    assert [(r["doc_id"], r["tools"][0]["name"]) for r in records.negatives_from_chat(both, system="system").collect()] == [(3, "f")]
    flat = spark.createDataFrame([(7, "q", '[{"name": "f", "arguments": {"a": 1}}, {"name": "Bad", "arguments": {}}]', '[{"name": "f", "description": "d", "parameters": {}}]'), (8, "", "[]", "[]"), (9, "q", "{bad", "[]")], "id int, query string, answers string, tools string")
    got = records.from_flat(flat).collect()
    assert [(r["id"], [tuple(c) for c in r["function_calls"]]) for r in got] == [("xlam_00007", [("f", '{"a": 1}')])] or [r["id"] for r in got] == ["xlam_00007"]


def test_tools_of_a_record(spark):
    t = "array<struct<name: string, description: string, parameters: string>>"
    df = spark.createDataFrame([([("a", "d", "{}"), ("A ", "d", "{}"), ("a", "other", "{}")], [("a", "{}"), ("z", "{}")])], f"tools {t}, calls array<struct<name: string, arguments: string>>")
    r = df.select(records.canonical_tools(F.col("tools")).alias("c"), records.complete_tools(F.col("tools"), F.col("calls")).alias("f")).first()
    assert [x["description"] for x in r["c"]] == ["d", "other"]
    assert [x["name"] for x in r["f"]] == ["a", "A ", "a", "z"]


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "a", "t"), (3, "b", "s"), (4, "c", "t"), (5, "d", "t")], "ord int, id string, sk string")
    got = {r["ord"]: r["reason"] for r in dedup.first_wins(df, ["id"], "sk", "ord").collect()}
    assert got == {1: None, 2: "duplicate_id", 3: "duplicate_scenario", 4: None, 5: "duplicate_scenario"}
    kept = dedup.first_wins(df, ["id"], "sk", "ord").where("reason is null").drop("reason")
    assert dedup.first_wins(kept, ["id"], "sk", "ord").where("reason is not null").count() == 0


def test_canonical_scenario(spark):
    f, g = '{"type": "object", "properties": {"a": {"type": "string", "description": "d"}}}', '{"type": "object", "properties": {"b": {"type": "integer"}}}'
    one = lambda i, args, tools: {"rid": i, "id": f"xlam_{i}", "source": "xlam", "language": "en", "split": "train" if i % 2 else "test", "query": "q", "function_calls": [("f", args)], "tools": tools}
    r = table(
        spark,
        [
            one(1, '{"a": "x", "b": 1}', [tool("f", f), tool("g", g)]),
            one(2, '{"b":1,"a":"x"}', [tool("f", f), tool("g", g)]),  # order of keys, white space
            one(3, '"{\\"a\\": \\"x\\", \\"b\\": 1}"', [tool("f", f), tool("g", g)]),  # encoded twice
            one(4, '{"a": "x", "b": 1}', [tool("g", g, "other"), tool("f", f.replace('"d"', '"e"'))]),  # order and descriptions of tools
            one(5, '{"a": "x", "b": 2}', [tool("f", f), tool("g", g)]),
            one(6, '{"a": "x", "b": 1}', [tool("f", f), tool("g", g.replace("integer", "string"))]),
            one(7, '{"a": "x", "b": 1', [tool("f", f), tool("g", g)]),
            one(8, '{"a": "x", "b": 3', [tool("f", f), tool("g", g)]),
        ],
    )
    assert rows(record_queries._dedup(r, dedup.canonical_scenario_key).where("reason is not null").select("rid", "reason")) == [(i, "duplicate_scenario") for i in (2, 3, 4)]
    assert record_queries._dedup(r).where("reason is not null").count() == 0
    assert rows(record_queries._leak(r, dedup.canonical_scenario_key).where("kind = 'scenario'")) == [("scenario", 1, 5)]


def test_unicode_query_keys(spark):
    """Full-width letters, a combining accent and a non-breaking space: one query, against a brute force."""
    texts = ["Book café 7", "\uff22ook café 7", "book cafe\u0301 7", "Book café\u00a07", "other"]
    r = table(spark, [{"rid": 2 * i + k, "id": f"xlam_{i}", "source": "xlam", "language": lang, "split": ("test", "train", "val")[i % 3], "query": t if lang == "en" else f"vi {i}", "function_calls": [], "tools": []} for i, t in enumerate(texts) for k, lang in enumerate(("en", "vi"))])
    q, key = record_queries, lambda s: " ".join(unicodedata.normalize("NFKC", s).casefold().split())
    en = r.where("language = 'en'")
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(key(t), []).append(i)
    assert [len(v) for v in by.values()] == [4, 1]
    assert rows(q._leak(en, dedup.canonical_scenario_key, q.X.query_key)) == [("id", 0, 5), ("query", 1, 2), ("scenario", 1, 2)]
    assert q._dedup(en, dedup.canonical_scenario_key, q.X.query_key).where("reason = 'duplicate_scenario'").count() == 3
    assert [x[0] for x in rows(q._decontaminated(en, q.X.query_key))] == [0, 6, 8]
    parts = {x["rid"]: x["split"] for x in q._hash_split(en, q.X.query_key).collect()}
    h = {i: int(hashlib.sha256(key(t).encode()).hexdigest()[:8], 16) % 100 for i, t in enumerate(texts)}
    assert parts == {2 * i: "train" if v < 80 else "val" if v < 90 else "test" for i, v in h.items()}
    assert q._components(r, q.X.query_key).select("root").distinct().count() == q._strata(r, q.X.query_key).count() == 2
    split = {x["rid"]: (x["grp"], x["split"]) for x in q._greedy(r).collect()}
    assert len({split[2 * i] for i in range(4)}) == 1 and len(split) == 5


def test_argument_errors(spark):
    call = lambda name, args: f'<tool_call>{{"name": "{name}", "arguments": {args}}}</tool_call>'
    gold = [("F", '{"note": "to the door", "city": "Hue", "day": "2030-01-02", "tags": ["a"], "n": 6, "gone": true, "same": {"b": 1, "a": 2}}'), ("f", '{"city": "Hue"}'), ("g", '"{\\"x\\": 1}"')]
    out = call("f", '{"note": "door", "city": "Da Nang", "day": "3 Jan", "tags": ["b"], "n": "6", "same": {"a": 2.0, "b": 1}, "more": 1}') + call("f", '{"city": "Hue"}')
    p = spark.createDataFrame([(1, "e0", "Bring 6 to the door in Hue", gold, out), (2, "e0", None, [("f", '{"city": "Hue"}')], None), (3, "e0", "q", [], out), (4, "e0", "q", None, out)], "pred_id long, run string, query string, gold array<struct<name: string, arguments: string>>, raw_output string")
    got = rows(scoring.argument_errors(p).select("pred_id", "name", "nth", "key", "cls"))
    assert got == [(1, "f", 1, k, c) for k, c in (("city", "W"), ("day", "T"), ("gone", "I"), ("n", "P"), ("note", "P"), ("same", None), ("tags", "T"))] + [(1, "f", 2, "city", None), (1, "g", 1, "x", "I"), (2, "f", 1, "city", "I")]


def test_verbatim_arguments(spark):
    r = table(spark, [{"rid": 1, "query": "2 in Hue", "function_calls": [("f", '{"city": "Hue", "size": 2, "memo": "m"}')]}])
    assert rows(record_queries._verbatim(r)) == [("city", 1, 1, 0), ("memo", 1, 0, 1), ("size", 1, 1, 0)]


def test_priorities_and_leakage(spark):
    df = spark.createDataFrame([(1, "k", "train"), (2, "k", "test"), (3, "m", "train"), (4, None, "train"), (5, "k", "test")], "rid int, key string, split string")
    assert [r[0] for r in rows(dedup.keep_highest_split(df, "key").select("rid"))] == [2, 3, 4, 5]
    assert rows(dedup.leakage(df, {"key": F.col("key")})) == [("key", 1, 2)]
    a, b = spark.createDataFrame([("x", 1, 1)], "name string, v int, o int"), spark.createDataFrame([("x", 2, 1), ("y", 3, 1)], "name string, v int, o int")
    assert rows(dedup.priority_union([a, b], "name", "o").select("name", "v")) == [("x", 2), ("y", 3)]


def test_bm25_of_words_in_any_script(spark):
    texts = ["забронируй столик в ресторане", "погода в городе", "đặt bàn ở Huế", "đạt bán", "dat ban", "\uff22ook 7", None, "..."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    i = spark.createDataFrame([(1, "Столик в РЕСТОРАНЕ"), (2, "đặt bàn"), (3, "book 7"), (4, "da\u0323t ba\u0301n")], "item_id long, text string")
    got = rows(vector_queries._bm25_words(i, d).select("q", "rank", "d"))
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 2), (3, 1, 5), (4, 1, 3)]
    assert vector_queries._bm25(i, d).where("q = 1").count() == 0


@pytest.mark.parametrize("block", [50_000, 20])
def test_greedy_split_keeps_ratios(spark, block):
    g = spark.createDataFrame([(f"g{i}", "s" if i % 3 else "t", 1 + i % 4) for i in range(300)], "grp string, stratum string, size int")
    got = split.greedy_group_split(g, block=block)
    assert got.count() == 300
    n = {r["split"]: r["n"] for r in got.join(g, "grp").groupBy("split").agg(F.sum("size").alias("n")).collect()}
    total = sum(n.values())
    assert abs(n["train"] / total - 0.8) < 0.05 and abs(n["val"] / total - 0.1) < 0.04


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 10 == 0) for i in range(200)], "rid int, source string, neg boolean")
    s = sampling.stratified_sample(df, "rid", ~F.col("neg"), 50)
    assert s.count() == 50 and s.where("neg").count() == 20
    q = sampling.quota_sample(df, "rid", "source", ~F.col("neg"), {"a": 30, "b": 500}, 5)
    n = {r[0]: r[1] for r in q.groupBy("pick").count().collect()}
    assert n["negative"] == 5 and q.count() == q.select("rid").distinct().count() == 185 and n["quota"] == 110 and n["refill"] == 70
    three = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "a", False)], "rid int, source string, p boolean")
    got = sampling.quota_sample(three, "rid", "source", F.col("p"), {"a": 1}, 2)
    assert sorted(r["pick"] for r in got.collect()) == ["negative", "quota", "refill"]


def test_nested_candidates(spark):
    a = spark.createDataFrame([(1, ["t1", "t1", "t2"]), (2, []), (3, [f"t{i}" for i in range(9)])], "rid long, gold array<string>")
    p = spark.createDataFrame([(f"t{i}",) for i in range(30)], "name string")
    sets = {}
    for r in sampling.nested_candidates(a, p, [3, 10, 50]).collect():
        sets.setdefault((r["rid"], r["n"]), set()).add(r["name"])
    assert all(len(sets[i, 3]) == 3 and len(sets[i, 10]) == 10 and len(sets[i, 50]) == 30 for i in (1, 2, 3))
    assert all(sets[i, 3] <= sets[i, 10] <= sets[i, 50] for i in (1, 2, 3))
    assert {"t1", "t2"} <= sets[1, 3]


def test_pairing(spark):
    r = table(spark, [{"rid": 1, "id": "a", "language": "en-US"}, {"rid": 2, "id": "a", "language": "VIE"}, {"rid": 3, "id": "b", "language": "eng"}, {"rid": 4, "id": "c", "language": "vi"}, {"rid": 5, "id": "c", "language": "vi"}, {"rid": 6, "language": "en"}, {"rid": 7, "id": "d", "language": "envy"}])
    en, vi = pairing.one_per_id(r, "en"), pairing.one_per_id(r, "vi")
    assert tuple(pairing.pair_completeness(en, vi).first()) == (1, 1, 1)
    src = spark.createDataFrame([(i, i) for i in range(6)], "rid int, source_index int")
    bad = spark.createDataFrame([(1,), (None,), (4,)], "source_index int")
    left = pairing.without_failed(src, bad, ["source_index"])
    out = spark.createDataFrame([(10 + i,) for i in range(3)], "vi int")
    assert rows(pairing.positional(left, out, "rid", "vi").select("rid", "vi")) == [(0, 10), (2, 11), (3, 12)]


def test_pair_shapes(spark):
    one = lambda rid, i, lang, args, params: {"rid": rid, "id": i, "language": lang, "source": "xlam", "function_calls": [("f", args)], "tools": [tool("f", params), tool("g")]}
    same = '{"type": "object", "properties": {"city": {"description": "d", "type": "string"}}}'
    r = table(
        spark,
        [
            one(1, "a", "en", '{"city": "x", "n": 1}', same),
            one(2, "a", "vi", '{"n": 2, "city": "y"}', '{"properties": {"city": {"type": "string"}}, "type": "object"}'),
            one(3, "b", "en", '{"city": "x"}', same),
            one(4, "b", "vi", '{"town": "x"}', same),
            one(5, "c", "en", '{"city": "x"}', same),
            one(6, "c", "vi", '{"city": "x"}', same.replace("string", "integer")),
            one(7, "d", "en", "{}", '{"city": {"type": "str", "default": "x"}}'),
            one(8, "d", "vi", "{}", same),
            one(9, "e", "en", "{}", "{bad"),
            one(10, "e", "vi", "{}", "{worse"),
        ],
    )
    p = pairing.pairs(pairing.one_per_id(r, "en"), pairing.one_per_id(r, "vi"))
    assert rows(pairing.pair_shapes(p).select("id", "same_calls", "same_tools")) == [("a", True, True), ("b", False, True), ("c", True, False), ("d", True, True), ("e", True, False)]


def test_pool_merge(spark):
    t = spark.createDataFrame([(1, "F", "", "{}"), (2, "f ", "d", '{"type": 1}'), (3, "g", None, "{}"), (4, None, "x", "{}")], "o int, name string, description string, parameters string")
    got = {r["key"]: tuple(r)[1:] for r in pool.merge_pool(t, "o", F.contains("parameters", F.lit("type"))).collect()}
    assert got == {"f": ("F", "d", '{"type": 1}', 2), "g": ("g", "", "{}", 1)}


def test_scores(spark):
    p = spark.createDataFrame(
        [
            (1, [("f", '{"a": 1.0}')], '{"name": "f", "arguments": {"a": 1}}'),
            (2, [("f", "{}"), ("g", "{}")], '[{"name": "g", "arguments": {}}, {"name": "f", "arguments": {}}]'),
            (3, [], "<tool_call>"),
            (4, None, "plain"),
            (5, [("f", "{}")], ""),
        ],
        "pred_id int, gold array<struct<name: string, arguments: string>>, raw_output string",
    )
    s = {r["pred_id"]: r for r in scoring.scored(p).collect()}
    assert s[1]["exact"] and s[1]["clean"] and s[1]["names_ok"]
    assert not s[2]["exact"] and s[2]["exact_any_order"] and s[2]["set_ok"]
    assert s[3]["exact"] and not s[3]["clean"] and not s[3]["neg_ok"] and s[4]["neg_ok"] and not s[5]["exact"]
    m = scoring.metrics(scoring.scored(p)).first()
    assert (m["n"], m["n_pos"], m["tool_pct"], m["exact_pct"], m["clean_pct"], m["non_call_pct"]) == (5, 3, 33.33, 60.0, 40.0, 50.0)
    assert scoring.metrics(scoring.scored(p.where("pred_id = 4"))).first()["tool_pct"] is None


def test_latency_and_bootstrap(spark):
    p = spark.createDataFrame([(1.0, 1), (2.0, 1), (20.0, 2), (None, 1), (3.0, 0)], "batch_latency_ms double, batch_size int")
    r = scoring.latency(p).first()
    assert (r["n"], r["p50_ms"], r["p95_ms"]) == (3, 2.0, 9.2)
    v = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "k int, v double")
    b = scoring.bootstrap(v, "k", "v", rounds=100).first()
    assert b["mean"] == 0.5 and 0.4 < b["low"] < 0.5 < b["high"] < 0.6


def test_streaks(spark):
    df = spark.createDataFrame([("a", i, c == "x") for i, c in enumerate("xx.xxx.x")], "d string, i int, bad boolean")
    assert rows(scoring.failure_streaks(df, "d", "i", F.col("bad"))) == [("a", 0, 1, 2), ("a", 3, 5, 3)]


def test_digests(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "id string")
    import hashlib

    other = spark.createDataFrame([("a",), ("b",)], "id string")
    assert reports.id_digest(df, "id").first()["digest"] == reports.id_digest(other, "id").first()["digest"] != reports.id_digest(other.where("id = 'a'"), "id").first()["digest"]
    assert reports.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n|---|---|\n| 1 | - |"


def test_retrieval_blocks_agree(spark, monkeypatch):
    import random

    rnd = random.Random(1)
    e = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)], i % 3) for i in range(60)] + [(60, None, 1)], "vec_id long, embedding array<float>, label int")
    q = e.where("vec_id < 7")
    whole = rows(retrieval.top_k(q, e, 5))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert rows(retrieval.top_k(q, e, 5)) == whole and len(whole) == 35
    j = q.alias("a").join(e.alias("b"), F.expr("a.vec_id <> b.vec_id and b.embedding is not null")).select(F.col("a.vec_id").alias("q"), F.round(retrieval.dot(F.col("a.embedding"), F.col("b.embedding")) / F.sqrt(retrieval.dot(F.col("a.embedding"), F.col("a.embedding")) * retrieval.dot(F.col("b.embedding"), F.col("b.embedding"))), 5).alias("s"))
    best = {r["q"]: r["m"] for r in j.groupBy("q").agg(F.max("s").alias("m")).collect()}
    assert {r[0]: round(r[4], 5) for r in whole if r[5] == 1} == pytest.approx(best, abs=2e-5)


def test_labels(spark):
    r = table(spark, [{"rid": 1, "query": "go to Rome, please", "function_calls": [("F", '{"city": "Rome", "c": "y"}')], "tools": [tool("f", SCHEMA)]}, {"rid": 2, "query": None, "function_calls": [("zz", "{}")], "tools": [tool("f", SCHEMA)]}])
    got = {x["param"]: x for x in labels.argument_labels(r).collect()}
    assert (got["city"]["span_start"], got["city"]["span_end"]) == (6, 10) and got["c"]["enum_index"] == 1 and not got["n"]["has_value"] and got["n"]["kind"] == "number"


def test_chat_rows(spark):
    r = table(spark, [{"rid": 1, "query": "q", "function_calls": [("f", "{}")], "tools": [tool("f")]}, {"rid": 2, "query": "q", "function_calls": [], "tools": [tool("f")]}, {"rid": 3, "query": " ", "tools": [tool("f")]}, {"rid": 4, "query": "q", "function_calls": [("x", "{}")], "tools": [tool("f")]}, {"rid": 5, "query": "q", "tools": []}])
    c = records.chat_rows(r, F.lit("vi"))
    assert [x[0] for x in rows(c.select("rid"))] == [1, 2]
    assert c.where(F.size(records.chat_errors(F.col("messages"))) > 0).count() == 0


@pytest.mark.parametrize("block", [256, 2])
def test_bm25_like_the_formula(spark, monkeypatch, block):
    import math
    import random

    monkeypatch.setattr(retrieval, "TERM_BLOCK", block)
    rnd = random.Random(7)
    voc = [f"t{i}" for i in range(12)]
    docs = [(d, [rnd.choice(voc + ["z"]) for _ in range(rnd.randint(1, 9))]) for d in range(40)]
    qs = [(q, [rnd.choice(voc) for _ in range(3)]) for q in range(5)] + [(9, []), (10, ["none"])]
    avg = sum(len(t) for _, t in docs) / len(docs)
    df = {t: sum(t in x for _, x in docs) for t in voc}
    want = []
    for q, terms in qs:
        s = []
        for d, x in docs:
            if set(terms) & set(x):
                s.append((-round(sum(math.log(1 + (40 - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / avg)) for t in set(terms) if t in x), 5), d))
        want += [(q, d, r + 1) for r, (_, d) in enumerate(sorted(s)[:4])]
    q, d = spark.createDataFrame(qs, "q long, terms array<string>"), spark.createDataFrame(docs, "d long, terms array<string>")
    assert rows(retrieval.bm25(q, d, 4).select("q", "d", "rank")) == sorted(want)
    assert retrieval.bm25(q.limit(0), d, 4).count() == 0 and retrieval.bm25(q, d.limit(0), 4).count() == 0
