"""Labels for argument extraction: type routing, spans, enums, booleans (LBL-01, LBL-02, ARR-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.jsonx import as_schema_udf, parsed
from corvane.operators.records import name_key

# Schema types as the label vocabulary names them; a list of values makes an enum of any of them.
ROUTES = {"string": "string", "integer": "number", "number": "number", "boolean": "boolean", "array": "array", "object": "object"}


def label_type(kind: Column, enum: Column) -> Column:
    known = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in ROUTES.items()], F.lit("string"))
    return F.when(F.coalesce(F.size(enum) > 0, F.lit(False)), "enum").otherwise(known)


def argument_labels(records: DataFrame) -> DataFrame:
    """(rid, pos, param, kind, has_value, span_start, span_end, enum_index, bool_label) for each declared parameter of
    each called tool, one row each; parameters that the call leaves out have has_value = false."""
    c = records.select("rid", "query", "tools", F.posexplode("function_calls").alias("pos", "c"))
    tool = F.get(F.filter("tools", lambda t: name_key(t["name"]) == name_key(F.col("c.name"))), F.lit(0))
    c = c.select("rid", "query", "pos", F.col("c.arguments").alias("args"), tool["parameters"].alias("raw")).where("raw is not null")
    c = c.withColumn("schema", as_schema_udf("raw"))
    props = F.try_variant_get(F.try_parse_json("schema"), "$.properties", "map<string, variant>")
    p = c.select("rid", "query", "pos", F.try_variant_get(parsed(F.col("args")), "$", "map<string, variant>").alias("args"), F.explode(props).alias("param", "def"))
    value = F.try_variant_get(F.try_element_at("args", F.col("param")), "$", "string")
    enum = F.try_variant_get("def", "$.enum", "array<string>")
    kind = label_type(F.try_variant_get("def", "$.type", "string"), enum)
    p = p.select("rid", "pos", "param", "query", kind.alias("kind"), value.alias("value"), enum.alias("enum"))
    span = X.span_of(F.col("value"), F.col("query"))
    return p.select(
        "rid",
        "pos",
        "param",
        "kind",
        F.col("value").isNotNull().alias("has_value"),
        F.when(F.col("kind").isin("string", "number"), span["start"]).alias("span_start"),
        F.when(F.col("kind").isin("string", "number"), span["end"]).alias("span_end"),
        F.when(F.col("kind") == "enum", F.nullif(F.array_position("enum", F.col("value")) - 1, F.lit(-1))).alias("enum_index"),
        F.when(F.col("kind") == "boolean", X.boolean_cue(F.col("query"))).alias("bool_label"),
    )
