"""Language identification (problem 4): held-out accuracy, segments, cases."""

import os

import pytest

from corvane.llm import langid
from tests.fixtures import documents, items, records, rows, tool

DATA = "/root/testdata/sf0.01"
TEXTS = {
    "en": "Please send me the report before the meeting, I will read it tonight.",
    "vi": "Tôi muốn đặt bàn cho năm người ở nhà hàng này vào ngày mai.",
    "fr": "Je voudrais réserver une table pour cinq personnes dans ce restaurant.",
    "de": "Ich möchte morgen einen Tisch für fünf Personen in diesem Restaurant.",
    "es": "Quiero reservar una mesa para cinco personas en este restaurante.",
    "ru": "Я хочу заказать столик на пять человек в этом ресторане.",
}


@pytest.fixture(scope="module")
def model():
    return langid.fit_rows([])


def test_defined_without_training_rows(model):
    got = langid.scores(list(TEXTS.values()), model).argmax(axis=1)
    assert [langid.LANGS[k] for k in got] == list(TEXTS)


def test_without_accents(model):
    s = [langid.without_accents(TEXTS["vi"]), TEXTS["vi"].upper()]
    assert [langid.LANGS[k] for k in langid.scores(s, model).argmax(axis=1)] == ["vi", "vi"]


def test_batches_do_not_matter(model):
    t = list(TEXTS.values()) * 500
    one = langid.scores(t[:6], model)
    many = langid.scores(t, model)
    assert abs(many[2994:] - one).max() < 1e-6


def test_segments(model):
    q = f"{TEXTS['en']} {TEXTS['en']}\n{TEXTS['vi']} 12345. {TEXTS['en']}"
    got = langid.text_segments([q, None, "", "123 !!", TEXTS["ru"]], model)
    assert [[langid.LANGS[k] for k, _ in g] for g in got] == [["en", "vi", "en"], [], [], [], ["ru"]]
    assert all(0.99 < c <= 1 for g in got for _, c in g)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    d, i = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    m = langid.train(d, i.where("item_id % 2 = 0"))
    held = i.where("item_id % 2 = 1").collect()
    got = langid.scores([r["text"] for r in held], m).argmax(axis=1)
    assert sum(langid.LANGS[k] == r["lang"] for k, r in zip(got, held)) >= 0.99 * len(held)


def test_cases(spark):
    r = records(
        spark,
        [
            {"rid": 1, "language": "EN", "query": TEXTS["en"], "tools": [tool("a", description=TEXTS["fr"]), tool("b", description=" "), tool("c"), tool("d", description=TEXTS["en"])]},
            {"rid": 2, "language": "und", "query": TEXTS["de"]},
            {"rid": 3, "language": "vie", "query": TEXTS["es"], "tools": []},
            {"rid": 4, "language": "en-US", "query": TEXTS["en"] + " " + TEXTS["ru"]},
            {"rid": 5, "language": None, "query": None, "tools": [tool("a", description=TEXTS["fr"])]},
            {"rid": 6, "language": "pt", "query": TEXTS["en"]},
            {"rid": 7, "language": "vi-VN", "query": TEXTS["vi"] * 3000},
            {"rid": 8, "language": "", "query": "  "},
        ],
    )
    got = rows(langid.found(spark, r, documents(spark, []), items(spark, [])))
    assert got == [(1, "tools", 0, "fr"), (2, "query", 0, "de"), (3, "query", 0, "es"), (4, "query", 0, "en"), (4, "query", 1, "ru"), (6, "query", 0, "en")]
    assert langid.found(spark, records(spark, []), documents(spark, []), items(spark, [])).count() == 0


def test_wrong_labels_are_outvoted():
    wrong = [(TEXTS["fr"], "en")] * 2 + [(TEXTS["fr"], "fr")] * 8 + [(TEXTS["en"], "en")] * 10
    m = langid.fit_rows(wrong)
    assert langid.LANGS[int(langid.scores([TEXTS["fr"]], m).argmax())] == "fr"
