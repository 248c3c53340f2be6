"""Small tables in the shape of the driver's, with columns whose names clash with names used inside operators."""

from __future__ import annotations

RECORDS = (
    "rid long, id string, source string, language string, split string, query string, function_calls array<struct<name: string, arguments: string>>, "
    "tools array<struct<name: string, description: string, feature_group: string, parameters: string>>, has_tool_call boolean, contributor string, created_at timestamp, ingested_at timestamp, "
    "words string, n int, cid long, pos int, key string, value string, mapped string, canonical string, names string, label string, text string, errors string, line string, side string, root string, node string, lang string, b0 long"
)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, origin string, nth int, digest long, n_tokens long, size int, rank int, h long, start_at int, first long, n int, k string, label string"
ITEMS = "item_id long, id string, lang string, source string, text string, at int, words string"
FAILED = "fail_id long, dataset string, source_index long, error string, model string, defect string"


def _width(schema: str) -> int:
    depth, n = 0, 1
    for c in schema:
        depth += (c == "<") - (c == ">")
        n += c == "," and depth == 0
    return n


def records(spark, rows):
    """rows: dicts; columns that are left out are null."""
    return _table(spark, RECORDS, rows)


def documents(spark, rows):
    return _table(spark, DOCS, rows)


def items(spark, rows):
    return _table(spark, ITEMS, rows)


def failed(spark, rows):
    return _table(spark, FAILED, rows)


def _table(spark, schema, rows):
    empty = spark.createDataFrame([], schema)
    names = empty.columns
    assert len(names) == _width(schema)
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], empty.schema) if rows else empty


def tool(name, parameters='{"type": "object", "properties": {}}', description=None):
    return (name, description, None, parameters)


def rows(df):
    return ordered(map(tuple, df.collect()))


def ordered(xs):
    """Sorted, nulls last."""
    return sorted(xs, key=lambda r: [(x is None, x) for x in r])
