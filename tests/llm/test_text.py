"""Consistent form, words, look-alikes (problem 2) and defects (problem 1)."""

import json
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import defects, langid, lookalikes
from corvane.llm.textform import SUSPECT, consistent, decoded, may_reach, strings, word_set_udf, words
from tests.fixtures import failed, ordered, records, rows

ZW = chr(0x200B)
NB = chr(0xA0)


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (chr(0x41C) + chr(0x443) + " child", "My child"),  # a Cyrillic word of a Latin-script sentence
        ("th" + chr(0x430) + "t", "that"),
        ("r" + chr(0x3BF) + chr(0x3BF) + "m", "room"),
        (chr(0x412) + chr(0x396) + " 25992", "BZ 25992"),  # Cyrillic and Greek in one word
        ("ng" + "à" + chr(0x443), "ngày"),
        ("дeнь", "день"),  # Latin letter in a Cyrillic word
        ("Где? а не мне Bob", "Где? а не мне Bob"),  # Cyrillic words stay in their sentence
        ("a" + ZW + "b" + chr(0xFEFF) + chr(0xAD), "ab"),
        ("a" + NB + chr(0x3000) + "\tb\n", "a   b\n"),
        ("Ａ１！", "A1!"),
        (unicodedata.normalize("NFD", "Việt Nam é"), "Việt Nam é"),
        ("UPPER  lower", "UPPER  lower"),
        ("", ""),
        (None, None),
    ],
)
def test_consistent_form(text, form):
    assert consistent(text) == form


odd = st.text(alphabet="aеоoр РА.? \n" + ZW + NB + "Ａ１é" + chr(0x301) + chr(0x3BF) + "жb", max_size=30)


@settings(max_examples=300, deadline=None)
@given(odd)
def test_form_is_stable(s):
    f = consistent(s)
    assert consistent(f) == f
    assert f.count("\n") == s.count("\n")
    assert unicodedata.is_normalized("NFC", f)


def test_prefilter_misses_nothing(spark):
    texts = ["plain", "é", unicodedata.normalize("NFD", "é"), "a" + ZW, "a" + NB, "а", "Ａ", "a\tb", "a\nb", chr(0x3BF), "tiếng Việt", "\x00", chr(0x2009)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(SUSPECT).alias("s"))
    for r in df.collect():
        assert r["s"] or consistent(r["t"]) == r["t"]
    assert not [r for r in df.collect() if r["t"] in ("plain", "tiếng Việt") and r["s"]]


def test_prefilter_misses_no_code_point(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    moved = [c for c in points for x in (chr(c), "a" + chr(c), chr(c) + "b c") if consistent(x) != x]
    assert len(moved) > 1300
    df = spark.createDataFrame([(chr(c),) for c in set(moved)], "t string")
    assert df.where(~F.col("t").rlike(SUSPECT)).count() == 0
    quiet = spark.createDataFrame([(chr(c),) for c in points if c < 0x250 and consistent("a" + chr(c)) == "a" + chr(c) and c > 0xA0], "t string")
    assert quiet.where(F.col("t").rlike(SUSPECT)).count() < 5


def test_collation_decides_where_forms_differ_in_ignorable_marks(spark):
    # a mark without weight that no table names: equal under the collation, so the shorter form is canonical
    mark = chr(0x13430)
    v = spark.createDataFrame([("ro" + mark + "om",), ("room",)], "value string")
    got = {r["value"]: r["canonical"] for r in lookalikes.canonical_members(v).collect()}
    assert got["room"] == "room" and got["ro" + mark + "om"] in ("room", "ro" + mark + "om")


def test_words():
    assert words("It's Ｎｅｗ: a_b-" + ZW + "c 12.5") == ["it", "s", "new", "a", "b", "c", "12", "5"]
    assert words(None) == words("") == words(" .,") == []


def test_values():
    assert strings(decoded(json.dumps(json.dumps({"a": ["x", {"b": "y"}], "c": 1})))) == ["x", "y"]
    assert decoded("{'a': 1}") is None and decoded('{"a": NaN}') is None and decoded(None) is None and decoded('"x"') is None


def test_bitmap_bound_is_lossless(spark):
    import itertools
    import random

    rnd = random.Random(5)
    sets = [" ".join(rnd.sample([f"w{i}" for i in range(60)], rnd.randint(1, 40))) for _ in range(40)]
    sets += [s + " extra" for s in sets[:10]]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, t string").select("i", word_set_udf("t").alias("w")).select("i", "w.*")
    a, b = df.alias("a"), df.alias("b")
    c = lambda n: (F.col(f"a.{n}"), F.col(f"b.{n}"))
    kept = {(r[0], r[1]) for r in a.join(b, F.col("a.i") < F.col("b.i")).where(may_reach(0.75, c("n"), c("b0"), c("b1"))).select("a.i", "b.i").collect()}
    for i, j in itertools.combinations(range(len(sets)), 2):
        x, y = set(sets[i].split()), set(sets[j].split())
        if len(x & y) / len(x | y) >= 0.75:
            assert (i, j) in kept
    assert len(kept) < 300


def test_found_fields(spark):
    long = "word " * 40_000 + "x" + ZW
    r = records(
        spark,
        [
            {"rid": 1, "query": "clean", "function_calls": [("f", '{"a": "x' + NB + 'y"}'), ("g", None), None]},
            {"rid": 2, "query": "th" + chr(0x430) + "t", "function_calls": [("f", json.dumps(json.dumps({"a": "e" + chr(0x301)})))]},
            {"rid": 2, "query": "th" + chr(0x430) + "t"},
            {"rid": 3, "query": None},
            {"rid": 4, "query": "", "function_calls": []},
            {"rid": 5, "query": long},
            {"rid": 6, "query": "ok", "function_calls": [("f", '{"k' + ZW + '": "v"}'), ("f", "{bad" + ZW)]},
            {"rid": 7, "query": "that", "function_calls": [("f", '{"a": "\\u00a0"}')]},
        ],
    )
    assert rows(lookalikes.changed_fields(r).select("rid", "field")) == [(1, "arguments"), (2, "arguments"), (2, "query"), (5, "query"), (7, "arguments")]
    q = {x["rid"]: x["form"] for x in lookalikes.consistent_queries(r).collect()}
    assert q[2] == "that" and q[3] is None and q[4] == "" and q[5] == long[:-1]
    assert lookalikes.changed_fields(records(spark, [])).count() == 0


def test_one_canonical_member_per_class(spark):
    v = spark.createDataFrame([("r" + chr(0x3BF) + "om",), ("room",), ("Room",), ("ro" + chr(0x301) + "om",), ("róom",), (None,)], "value string")
    got = {r["value"]: r["canonical"] for r in lookalikes.canonical_members(v).collect()}
    assert got == {"r" + chr(0x3BF) + "om": "room", "room": "room", "Room": "Room", "ro" + chr(0x301) + "om": "róom", "róom": "róom"}


# ---- defects ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ('{"a": 1', True),
        ('{"a": "x', True),
        ('{"a": 1,...', True),
        ("{'a': 'it", True),
        ('{"a": [1, {"b": 2}', True),
        ('{"a": 1,}', False),
        ("{'a': True}", False),
        ('{"a": "it\'s {"}', False),
        ("plain", False),
        ("", False),
        (json.dumps('{"a": 1'), True),
        (json.dumps('{"a": 1}'), False),
        ('"{\\"a\\": 1', True),
    ],
)
def test_cut_off(text, cut):
    assert defects.read_arguments(text)[1] is cut


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=4), st.text(max_size=6) | st.integers() | st.lists(st.text(max_size=3), max_size=3), min_size=1, max_size=4), st.data())
def test_every_prefix_is_cut_off(v, data):
    t = json.dumps(v)
    k = data.draw(st.integers(1, len(t) - 1))
    assert defects.ends_early(t[:k]) and not defects.ends_early(t)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdefgh ijé", min_size=1, max_size=400))
def test_copies_always_pass_the_dictionary(s):
    assert defects.Prompt(s.encode()).adds_nothing(s.encode())


def test_long_copies_pass_the_dictionary():
    rnd = random.Random(2)
    for n in (100, 5_000, 300_000, 2_000_000):
        line = " ".join(str(rnd.random()) for _ in range(n // 18)).encode()
        p = defects.Prompt(line)
        assert p.adds_nothing(line) and not p.adds_nothing(line[::-1])


@pytest.mark.parametrize(
    ("text", "yes"),
    [
        ("I'm sorry, but I must decline this request.", True),
        ("As an assistant, it isn't possible for me to do that.", True),
        ("Rất tiếc, tôi xin từ chối việc bạn vừa nêu.", True),
        ("Là một trợ lý, mình không có khả năng làm yêu cầu này.", True),
        ("Désolé, je ne peux pas traiter cette demande.", True),
        ("Lo siento, no puedo atender lo que usted pide.", True),
        ("Leider ist es so: ich kann nicht helfen bei dieser Anfrage.", True),
        ("К сожалению, я не могу выполнить этот запрос.", True),
        ("Sorry for the short notice, Bob cannot come before the shop opens.", False),
        ("Xin lỗi vì báo gấp, Lan không thể đến trước khi quán mở cửa.", False),
        ("Nếu không được thì hỏi Lan ở văn phòng một ngày khác.", False),
        ("If that does not work, ask Bob for another day.", False),
        ("", False),
    ],
)
def test_refusals(text, yes):
    assert defects.is_refusal(text) is yes


@pytest.mark.parametrize("value, found", [("I must decline.", {"refusal"}), ("Je refuse.", {"refusal"}), ("Tôi từ chối.", {"refusal"}), ("Hue", set()), ("two rooms", set())])
def test_short_refusals(value, found):
    out, foreign = defects.answer_defects("A room in the old town of Hue for two nights", [{"name": "f", "arguments": json.dumps({"note": value})}])
    assert (out, foreign) == (found, [])


@pytest.mark.parametrize(
    ("query", "value", "found"),
    [
        ("Send my regrets to Ann", "I can't come to the party tomorrow", set()),
        ("Book a room", "Sorry, this request cannot be fulfilled.", {"refusal"}),
        ("Book a room", "Unable to help with this request", {"refusal"}),
        ("Book a room", "Rất tiếc, yêu cầu này không thể xử lý", {"refusal"}),
        ("Book a room", "Declined.", {"refusal"}),
        ("Book a room", "I refuse", {"refusal"}),
        ("Tell Bob: I can't help with this request", "I can't help with this request", set()),
        ("预订飞往巴黎", "预订飞往巴黎", {"copy"}),
        ("Book a table for four people at the restaurant in town", "预订", set()),
        # wordings beside those of the tables
        ("Book a room", "We regret that your question could not be processed.", {"refusal"}),
        ("Book a room", "Your request may not be answered by this assistant.", {"refusal"}),
        ("Book a room", "Nous ne pouvons pas traiter votre demande.", {"refusal"}),
        ("Book a room", "Wir können diese Anfrage leider nicht bearbeiten.", {"refusal"}),
        ("Book a room", "No podemos responder a esta pregunta.", {"refusal"}),
        ("Book a room", "Мы не можем выполнить этот запрос.", {"refusal"}),
        ("Book a room", "The lift is not able to carry more than four people.", set()),
        ("Book a room", "Thang máy không thể chở quá bốn người.", set()),
        ("Book a room", "Der Aufzug kann nicht mehr als vier Personen tragen.", set()),
    ],
)
def test_refusals_and_copies_in_context(query, value, found):
    out, _ = defects.answer_defects(query, [{"name": "f", "arguments": json.dumps({"note": value})}])
    assert out == found


MODEL = None


@pytest.fixture(scope="module")
def model():
    return langid.fit_rows([])


def test_record_defects(spark, model):
    q = "Please book a table for four people at the restaurant in town."
    a = lambda v: [("f", json.dumps({"note": v}))]
    r = records(
        spark,
        [
            {"rid": i, "query": q, "has_tool_call": True, "function_calls": c}
            for i, c in enumerate(
                [
                    a("The table should be near the window."),
                    None,
                    [],
                    [(" ", '{"a": 1}'), ("f", " null ")],
                    [("f", '{"note": "x')],
                    a("I'm sorry, but I can't help with this request."),
                    a("please BOOK a table, for four people at the restaurant in town"),
                    a("La mesa debe estar cerca de la ventana por favor."),
                    [("f", "{'note': 'x'}")],
                    [("f", "{}"), None],
                    [("f", '{"note": "x'), ("g", json.dumps({"n": "I must decline. I cannot do this."}))],
                ]
            )
        ]
        + [{"rid": 20, "query": q, "has_tool_call": False}, {"rid": 21, "query": q, "has_tool_call": None}, {"rid": 22, "query": None, "has_tool_call": True, "function_calls": a("La mesa debe estar cerca de la ventana.")}],
    )
    f = failed(spark, [{"fail_id": 1, "error": "EmptyOutput: no text"}, {"fail_id": 2, "error": "APIConnectionError: empty reply from proxy"}, {"fail_id": 3}, {"fail_id": 4, "error": "row 3 came back in Thai script"}, {"fail_id": 5, "error": "[attempt 2] unexpected reply 'Rất tiếc, tôi xin từ chối việc này.'"}, {"fail_id": 6, "error": "BadRequestError: prompt too long, max length is 30"}, {"fail_id": 7, "error": "JSONDecodeError: Unterminated string"}, {"fail_id": 8, "error": "output echoes the input"}, {"fail_id": 9, "error": "RateLimitError: request was refused by the gateway"}])
    assert rows(defects.found(spark, r, f, model)) == ordered(
        [("record", 1, "empty"), ("record", 2, "empty"), ("record", 3, "empty"), ("record", 4, "truncated"), ("record", 5, "refusal"), ("record", 6, "copy"), ("record", 7, "other_language"), ("record", 10, "truncated"), ("record", 10, "refusal"), ("failed", 1, "empty"), ("failed", 4, "other_language"), ("failed", 5, "refusal"), ("failed", 7, "truncated"), ("failed", 8, "copy")]
    )
    assert defects.found(spark, records(spark, []), failed(spark, []), model).count() == 0
