"""Linked tables of nested records against a recursive brute force."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.functions.jsonindex import index, strict_without_recursion, unwrap
from corvane.operators import nested
from tests.fixtures import ordered, records, rows, tool


def brute_args(v, base="", out=None):
    out = {} if out is None else out
    if isinstance(v, dict):
        for k, x in v.items():
            p = f"{base}.{k}" if base else k
            out.setdefault(p, base)
            brute_args(x, p, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            brute_args(x, f"{base}[{i}]", out)
    return out


def brute_params(v):
    out = {}

    def schema(s, base):
        if not isinstance(s, dict):
            return
        if isinstance(s.get("properties"), dict):
            for k, x in s["properties"].items():
                p = f"{base}.{k}" if base else k
                out.setdefault(p, base)
                schema(x, p)
        if base and isinstance(s.get("items"), dict):
            schema(s["items"], base + "[]")

    if v.get("type") == "object":
        schema(v, "")
    else:
        for k, x in v.items():
            out.setdefault(k, "")
            schema(x, k)
    return out


name = st.text(alphabet='ab"\\{}[]:, é\u200b', min_size=1, max_size=4)
leaf = st.none() | st.booleans() | st.integers(-5, 5) | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet='x"\\{}[]:,\n é', max_size=6)
value = st.recursive(leaf, lambda c: st.lists(c, max_size=3) | st.dictionaries(name, c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(name, value, max_size=3) | st.lists(value, max_size=3), min_size=1, max_size=4), st.sampled_from([None, 1]), st.booleans())
def test_arguments_like_brute_force(values, indent, ascii_only):
    texts = [json.dumps(v, indent=indent, ensure_ascii=ascii_only) for v in values]
    got = nested.arg_paths([unwrap(t) for t in texts])
    assert [{b: a for a, b in g} for g in got] == [brute_args(v) for v in values]


part = st.recursive(
    st.fixed_dictionaries({"type": st.sampled_from(["string", "integer"])}),
    lambda c: st.fixed_dictionaries({"type": st.just("object"), "properties": st.dictionaries(st.sampled_from(["a", "type", "properties", "items", "é"]), c, max_size=3)}) | st.fixed_dictionaries({"type": st.just("array"), "items": c}),
    max_leaves=8,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "properties", "items", "type"]), part, max_size=4), min_size=1, max_size=4), st.booleans())
def test_parameters_like_brute_force(flats, as_schema):
    values = [{"type": "object", "properties": f, "required": []} if as_schema else f for f in flats]
    got = nested.param_paths([json.dumps(v) for v in values])
    assert [{b: a for a, b in g} for g in got] == [brute_params(v) for v in values]


def test_depth_and_spans():
    ix = index(['{"a": [1, {"b": "x"}]}', "[]"])
    assert [(n, int(d)) for n, d in zip(ix.name, ix.depth)] == [(None, 0), ("a", 1), (None, 2), (None, 2), ("b", 3), (None, 0)]
    assert ix.parent.tolist() == [-1, 0, 1, 1, 3, -1]


def test_very_deep_text():
    deep = "[" * 3000 + "]" * 3000
    assert nested.arg_paths([unwrap('{"a": ' + deep + "}")])[0] == [("", "a")]


def rebuilt(rows):
    """The value whose rows these are."""
    made = {}
    held = {"": {}}
    for up, path, name, at, kind, value in rows:
        v = {"object": dict, "array": list}[kind]() if kind in ("object", "array") else None if kind == "null" else value if kind == "string" else json.loads(value)
        made[path] = v
        if name is not None:
            (made[up] if up else held[""])[name] = v
        else:
            assert len(made[up]) == at
            made[up].append(v)
    return held[""]


flat_name = st.text(alphabet='abé"\\', min_size=1, max_size=3)
flat_value = st.recursive(leaf, lambda c: st.lists(c, max_size=3) | st.dictionaries(flat_name, c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(flat_name, flat_value, max_size=3), min_size=1, max_size=3), st.sampled_from([None, 2]))
def test_argument_rows_are_a_round_trip(values, indent):
    got = nested.arg_values([unwrap(json.dumps(v, indent=indent)) for v in values])
    assert [rebuilt(g) for g in got] == values


def test_a_dotted_name_is_not_a_nested_one():
    assert nested.arg_paths(['{"a.b":1,"a":{"b":2}}']) == [[("", "a.b"), ("", "a"), ("a", "a.b")]]
    assert nested.param_paths(['{"a.b":{"type":"string"},"a":{"type":"object","properties":{"b":{"type":"string"}}}}']) == [[("", "a.b"), ("", "a"), ("a", "a.b")]]


def test_deep_texts_are_judged_strictly():
    n = 200_000
    assert unwrap('{"a":[1 1]}') is None
    assert unwrap('{"a":' + "[" * n + "1 1" + "]" * n + "}") is None
    assert unwrap('{"a":' + "[" * n + "1," + "]" * n + "}") is None
    assert unwrap('{"a":' + "[" * n + "}" * n + "}") is None
    good = '{"a":' + "[" * n + '1, {"b": null}' + "]" * n + "}"
    up, path = nested.arg_paths([unwrap(good)])[0][1]
    assert path == up + ".b" and up.startswith("a[0]") and up.endswith("[1]")


@settings(max_examples=200, deadline=None)
@given(value, st.data())
def test_the_walk_without_recursion_agrees(v, data):
    t = json.dumps(v)
    assert strict_without_recursion(t)
    k = data.draw(st.integers(0, len(t) - 1))
    bad = t[:k] + data.draw(st.sampled_from(["", ",", "]", "}", '"', "1"])) + t[k + 1 :]
    try:
        json.loads(bad, parse_constant=lambda x: 1 / 0)
        ok = True
    except (ValueError, ZeroDivisionError):
        ok = False
    assert strict_without_recursion(bad) is ok


def test_value_tables(spark):
    schema = json.dumps({"type": "object", "properties": {"n": {"type": "int", "default": 3, "description": "how many"}, "o": {"type": "array", "items": {"type": "object", "properties": {"sku": {"type": "string", "enum": ["a", "b"]}}, "required": ["sku"]}}}, "required": ["o"]})
    flat = '{"city": {"type": "str"}, "day": {"type": "str, optional"}, "k": {"type": "int", "default": 1}}'
    r = records(spark, [{"rid": 1, "tools": [tool("a", schema), tool("b", flat), tool("c", None)], "function_calls": [("a", '{"o": [{"sku": "x"}, 2], "z": null}'), ("b", "{bad"), None]}])
    assert rows(nested.parameter_rows(r)) == ordered(
        [
            (1, 0, "", "n", "n", "int", False, "3", "how many", None),
            (1, 0, "", "o", "o", "array", True, None, None, None),
            (1, 0, "o[]", "o[].sku", "sku", "string", True, None, None, '["a","b"]'),
            (1, 1, "", "city", "city", "str", True, None, None, None),
            (1, 1, "", "day", "day", "str, optional", False, None, None, None),
            (1, 1, "", "k", "k", "int", False, "1", None, None),
        ]
    )
    assert rows(nested.argument_rows(r)) == ordered(
        [(1, 0, "", "o", "o", None, "array", None), (1, 0, "o", "o[0]", None, 0, "object", None), (1, 0, "o[0]", "o[0].sku", "sku", None, "string", "x"), (1, 0, "o", "o[1]", None, 1, "number", "2"), (1, 0, "", "z", "z", None, "null", None)]
    )


def test_cases(spark):
    p = '{"type": "object", "properties": {"order_items": {"type": "array", "items": {"type": "object", "properties": {"sku": {"type": "string"}}}}}}'
    flat = '{"properties": {"type": "string"}, "type": {"type": "string"}}'
    r = records(
        spark,
        [
            {"rid": 1, "tools": [tool("a", p), tool("b", flat), tool("c", None), tool("d", " "), tool("e", "{bad")], "function_calls": [("a", '{"order_items": [{"sku": 1}]}'), ("a", json.dumps('{"x": 1, "x": 2}')), ("a", "{'x': 1}"), ("a", '{"x": NaN}'), ("a", None), (None, '"text"')]},
            {"rid": 1, "tools": [tool("a", p)], "function_calls": []},
            {"rid": 2},
            {"rid": None, "tools": [tool("a", p)]},
        ],
    )
    got = rows(nested.linked_paths(r))
    assert got == ordered(
        [("param", 1, 0, "", "order_items"), ("param", 1, 0, "order_items[]", "order_items[].sku"), ("param", 1, 1, "", "properties"), ("param", 1, 1, "", "type"), ("arg", 1, 0, "", "order_items"), ("arg", 1, 0, "order_items[0]", "order_items[0].sku"), ("arg", 1, 1, "", "x"), ("param", 1, 0, "", "order_items"), ("param", 1, 0, "order_items[]", "order_items[].sku")]
    )
    assert rows(nested.tool_rows(r).select("rid", "pos", "name"))[0] == (1, 0, "a")
    assert nested.call_rows(r).count() == 6


@pytest.mark.parametrize("f", [nested.linked_paths, nested.tool_rows, nested.call_rows, nested.argument_rows, nested.parameter_rows])
def test_empty_table(spark, f):
    assert f(records(spark, [])).count() == 0
