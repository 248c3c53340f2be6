"""A small build end to end, and its refusal of a faulty one."""

import pytest

from corvane.plans import build
from tests.fixtures import records, tool

P = '{"type": "object", "properties": {"a": {"type": "string"}}}'


def pair(i, query, source="xlam", calls=True):
    base = {"id": f"{source}_{i}", "source": source, "function_calls": [("f", '{"a": "x"}')] if calls else [], "tools": [tool("f", P)], "has_tool_call": calls}
    return [{"rid": 10 * i, "language": "en", "query": query, **base}, {"rid": 10 * i + 1, "language": "vi-VN", "query": f"vi {query}", **base}]


def source(spark):
    rows = [r for i in range(1, 41) for r in pair(i, f"question {i}", "xlam" if i % 2 else "glaive", i % 5 != 0)]
    rows += pair(41, "Question 1 ")  # the scenario of the first one
    rows += pair(42, "question 2", "glaive", False)  # same query as 2: same group
    rows += pair(43, " ")  # breaks a rule
    lone = pair(44, "alone")[:1]
    return records(spark, rows + lone), spark.createDataFrame([(1, "f", "hotel")], "tool_id long, name string, feature_group string")


def test_build(spark, tmp_path):
    raw, tools = source(spark)
    rev = build.plan(spark, raw, tools)
    rows = rev.rows.collect()
    ids = {r["id"] for r in rows}
    assert len(ids) == 41 and len(rows) == 82
    where = {}
    for r in rows:
        where.setdefault(r["id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in where.values())
    assert where["glaive_2"] == where["glaive_42"]
    assert sorted((r["stage"], r["reason"]) for r in rev.rejected.collect()) == [("duplicate", "duplicate_scenario"), ("rules", "query: empty; query: empty")] or rev.rejected.count() == 2
    assert [r["category"] for r in rev.pool.collect()] == ["hotel"]
    path = str(tmp_path / "rev")
    meta = build.write(spark, rev, path)
    assert sum(x["count"] for x in meta["splits"]) == 82
    assert build.verify(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        build.write(spark, rev, path)


def test_failed_check_raises(spark, tmp_path):
    raw, tools = source(spark)
    rev = build.plan(spark, raw, tools)
    rev.checks = spark.createDataFrame([("leak", 1)], "name string, n_bad long")
    with pytest.raises(ValueError, match="leak"):
        build.write(spark, rev, str(tmp_path / "rev"))


def test_pairs_of_other_shape_are_left_out(spark):
    raw, tools = source(spark)
    odd = pair(50, "other keys") + pair(51, "other types")
    odd[1]["function_calls"] = [("f", '{"b": "x"}')]
    odd[3]["tools"] = [tool("f", P.replace("string", "integer"))]
    rev = build.plan(spark, raw.union(records(spark, odd)), tools)
    assert {r["id"] for r in rev.rejected.where("stage = 'pair'").collect()} == {"xlam_50", "xlam_51"}
    assert rev.rows.where("id in ('xlam_50', 'xlam_51')").count() == 0
