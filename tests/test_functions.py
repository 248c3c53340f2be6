"""Text, JSON and output functions on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import jsonx as J
from corvane.functions import output as O
from corvane.functions import text as X
from corvane.sources import readers


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_query_keys(spark):
    vals = ["  Hello\tWorld \n", "Straße", "ＡＢＣ　x", None, "", "Cafe\u0301"]
    assert col(spark, vals, X.query_key) == ["hello world", "strasse", "abc x", None, "", "café"]
    assert col(spark, vals, lambda c: X.query_key(c, "NFC"))[2] == "ａｂｃ x"


def test_snake_case(spark):
    assert col(spark, ["a_b1", "A", "1a", "", None, "a\n", "_a"], X.is_snake_case) == [True, False, False, False, False, False, False]


def test_turns_in_both_languages(spark):
    t = "intro\n\nUSER: hi\n\nASSISTANT: <functioncall> {\"name\": \"f\", \"arguments\": {}} <|endoftext|>\n\n\n\nFUNCTION RESPONSE: {}\nNGƯỜI DÙNG: chào\nTrợ lý: vâng"
    got = col(spark, [t, "", None], X.turns)
    assert [x["role"] for x in got[0]] == ["user", "assistant", "function", "user", "assistant"]
    assert got[0][0]["content"] == "hi" and got[0][3]["content"] == "chào"
    assert got[1] == [] and got[2] is None


def test_calls_of_a_turn(spark):
    s = """<functioncall> {"name": "f", "arguments": '{"k": "v"}'} <|endoftext|>\n\n<functioncall> {"name": "g", "arguments": {"x": 1}}"""
    blocks = col(spark, [s], X.call_blocks)[0]
    assert len(blocks) == 2
    got = col(spark, [[*blocks, '{"name": "Bad Name"}', "nonsense", None], [], None], X.parse_calls, "array<string>")
    assert [(g["name"], json.loads(g["arguments"])) for g in got[0]] == [("f", {"k": "v"}), ("g", {"x": 1})]
    assert got[1:] == [[], None]


def test_first_object():
    assert X.first_object('SYSTEM: {a} {"name": "f", "d": "}\\"{"} rest') == "{a}"
    assert X.first_object('x {"k": "} \\" {"} y') == '{"k": "} \\" {"}'
    assert X.first_object("{ {") is None and X.first_object(None) is None


def test_small_text_functions(spark):
    assert col(spark, ["A: b: c", "no colon", None], X.error_prefix) == ["A", "no colon", None]
    assert col(spark, ["```json\n{}\n```"], X.without_fence) == ["{}"]
    assert col(spark, ["Không cần đâu", "yes please", "zzz", "I do not need it", None, "Cấm hút thuốc", "tôi từ chối.", "nên đi", "NO", "đúng", "note", "yêu cầu"], X.boolean_cue) == [1, 0, None, None, None, 1, 1, 0, 1, 0, None, 0]
    assert col(spark, [" Yes ", "Không", "1,50", "1.5", "-3", "05/9/2031", "05-09-2031", "A  b", None], X.normalized_key) == ["true", "false", "1.5", "1.5", "-3", "2031-09-05", "2031-09-05", "a b", None]
    assert col(spark, ["about hotel", " ", "x"], lambda c: X.category_in(c, ["hotel", "loan"], "Khác")) == ["hotel", "Khác", "x"]
    df = spark.createDataFrame([("b", "abc"), ("z", "abc"), ("", "abc"), (None, "abc")], "v string, q string")
    assert [r[0] and tuple(r[0]) for r in df.select(X.span_of(F.col("v"), F.col("q"))).collect()] == [(1, 2), None, None, None]


@pytest.mark.parametrize(("raw", "want"), [("nửa triệu", "500000"), ("1,5 triệu", "1500000"), ("2 triệu rưỡi", "2500000"), ("ngày 3/4/2030", "2030-04-03"), ("03-04-31", "2031-04-03"), ("99/99/2030", "99/99/2030"), ("xin chào", "xin chào"), (None, None)])
def test_vietnamese_values(raw, want):
    assert X.vi_value(raw) == want


@pytest.mark.parametrize(("raw", "want"), [("str", ("string", False)), ("int, optional", ("integer", True)), ("List[int]", ("array", False)), ("Dict[str, int]", ("string", False)), ("", ("string", False)), (None, ("string", False)), ("enum", ("string", False)), ("float", ("number", False))])
def test_type_strings(raw, want):
    assert J.type_of(raw) == want


@pytest.mark.parametrize(("raw", "want"), [("List[int]", {"type": "integer"}), ("List[Union[int, float]]", {"type": "number"}), ("List[List[int]]", {"type": "array", "items": {"type": "integer"}}), ("List[Tuple[int, int]]", {"type": "array"}), ("str", None), ("List[foo]", None)])
def test_item_types(raw, want):
    assert J.items_of(raw) == want


def test_type_column_agrees(spark):
    vals = ["str", "int, optional", "List[int]", "list", "x", "", None]
    assert col(spark, vals, J.type_column) == [J.type_of(v)[0] for v in vals]


def test_schemas():
    flat = {"a": {"type": "int, optional"}, "b": {"type": "List[str]", "description": " d "}, "c": {"type": "str", "default": 1}, "d": {"type": "str", "default": ""}, "properties": {"type": "str"}}
    s = J.as_schema(flat)
    assert s["required"] == ["b", "properties"] and s["properties"]["b"] == {"type": "array", "description": "d", "items": {"type": "string"}}
    assert s["properties"]["c"]["default"] == 1 and "default" not in s["properties"]["d"]
    nested = {"type": "object", "properties": {"x": {"properties": {"y": {"type": "int"}}}}}
    assert J.as_schema(nested)["properties"]["x"] == {"properties": {"y": {"type": "integer"}}, "type": "object"}
    assert J.tidy_schema({"type": "object", "properties": {"x": {"type": "str", "default": 1}}, "required": ["x"]}, True).get("required") is None
    assert J.as_schema(None) == {"type": "object", "properties": {}}
    assert J.schema_errors(s) == []
    assert J.schema_errors({"type": "object", "properties": {"a": {"type": "foo", "enum": 3}}, "required": ["b"]}) == ["$: required b is not declared", "$.a: unknown type foo", "$.a: enum is no list"]
    assert J.schema_errors([]) == ["$: not an object"]


def test_structural_merge():
    a = {"x": "1", "y": [{"z": 1}, 2], "description": "en"}
    b = {"x": "2", "y": [{"z": 5, "q": 1}], "w": 9, "description": "vi"}
    assert J.merge_values(a, b) == {"x": "2", "y": [{"z": 5}, 2], "description": "vi"}
    assert J.merge_descriptions(a, b) == {"x": "1", "y": [{"z": 1}, 2], "description": "vi"}
    assert J.structure(a) == {"x": None, "y": [{"z": None}, None]}


def test_json_columns(spark):
    assert col(spark, ['{"b":1,"a":2}', "{bad", None], J.canonical) == ['{"a":2,"b":1}', None, None]
    assert col(spark, ['[{"a":1}', '[{"a":1}}', "[1]", "x"], J.repaired_list) == ['[{"a":1}]', '[{"a":1}]', "[1]", None]
    assert col(spark, [" 5 ", "true", "", ' a "b" '], J.decoded_parameter) == ["5", "true", '""', '"a \\"b\\""']
    assert col(spark, ['{"b":1,"a":2}', '"{\\"c\\":1}"', "[]", None], J.object_keys) == [["a", "b"], ["c"], [], []]
    assert col(spark, ['{"a":1.0}', '{"a":1}'], J.canonical_exact) == ['{"a":1.0}', '{"a":1}']


TAG = "<tool_call><function=f><parameter=a>\ntrue\n</parameter><parameter=b> x y </parameter></function></tool_call>"


@pytest.mark.parametrize(
    ("text", "calls", "errors"),
    [
        (TAG, [("f", {"a": True, "b": "x y"})], []),
        (TAG + TAG.replace("=f>", "=g>"), [("f", {"a": True, "b": "x y"}), ("g", {"a": True, "b": "x y"})], []),
        ("Just a sentence.", [], []),
        ("", [], []),
        (None, [], []),
        ('{"name": "lookup", "arguments": {"q": 1}}', [("lookup", {"q": 1})], []),
        ('```json\n[{"function": {"name": "f", "arguments": {}}}]\n```', [("f", {})], []),
        ("<tool_call><function=lookup>", [], ["unbalanced tags"]),
        ("<tool_call>nothing</tool_call>", [], ["block without function"]),
        ("<tool_call><function=f><parameter=a>1</parameter><parameter=a>2</parameter></function></tool_call>", [("f", {"a": 1})], ["duplicate parameter: a"]),
        ('{"tool_calls": [{"name": "f", "arguments": 3}, 4, {"name": ""}]}', [("f", {})], ["arguments are no object", "call is no object", "call has no name"]),
    ],
)
def test_shared_parser(text, calls, errors):
    c, e = O.shared(text)
    assert [(n, json.loads(a)) for n, a in c] == calls and e == errors


def test_parsers_differ():
    twice = "<tool_call><function=f><parameter=a>1</parameter></function><function=g><parameter=a>2</parameter></function></tool_call>"
    assert [n for n, _ in O.shared(twice)[0]] == ["f", "g"]
    assert [(n, json.loads(a)) for n, a in O.benchmark(twice)[0]] == [("f", {"a": 2})]
    assert O.benchmark("<tool_call>") == ([], ["malformed_tool_call"])
    assert O.shared('{"name": "x", "arguments": {}}', {"f"})[1] == ["unknown tool: x"]


def test_environment_and_configuration():
    from corvane.plans.build import BuildConfig

    assert readers.resolve_env({"a": ["${X}", "${A_B}", "${NONE}"]}, {"X": "1", "A__B": "2"}) == {"a": ["1", "2", ""]}
    c = readers.configured(BuildConfig, {"seed": 1, "old": "y", "zzz": 3}, {"seed": None, "strict_pairs": True}, {"old": "default_category"})
    assert c == BuildConfig(1, True, "y")
