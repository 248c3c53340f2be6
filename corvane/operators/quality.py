"""Rules for translated rows against their originals, repairs with fallbacks (PRD-06..08, JSN-08..10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import jsonx as J
from corvane.functions import text as X
from corvane.operators.records import identifier_integrity


def translated_errors(original: str = "en", translated: str = "vi") -> Column:
    """ARRAY<STRING> for a pair of structs: required fields, snake_case names, calls with the names and keys of the
    original. A record without calls breaks 'calls', as rows of this kind have to have one."""
    t = lambda f: F.col(f"{translated}.{f}")
    bad_names = lambda c, what: F.transform(F.filter(F.coalesce(c, F.expr("array()")), lambda x: ~X.is_snake_case(F.trim(x["name"]))), lambda x: F.concat(F.lit(f"{what} name not snake_case: "), F.coalesce(x["name"], F.lit("null"))))
    fixed = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(t("query")), F.lit("")) == "", F.lit("query: missing")),
            F.when(F.coalesce(F.size(t("function_calls")), F.lit(0)) <= 0, F.lit("calls: missing")),
            F.when(~F.coalesce(identifier_integrity(F.col(f"{original}.function_calls"), t("function_calls")), F.lit(False)), F.lit("identifiers: differ from the original")),
        )
    )
    return F.concat(fixed, bad_names(t("function_calls"), "call"), bad_names(t("tools"), "tool"))


def merged_calls(p: DataFrame) -> DataFrame:
    """(id, pos, name, arguments): calls of the original with the values of the translation in its structure."""
    c = p.select("id", F.col("vi.function_calls").alias("other"), F.posexplode("en.function_calls").alias("pos", "c"))
    return c.select("id", "pos", F.trim("c.name").alias("name"), J.merge_values_udf(F.col("c.arguments"), F.get("other", F.col("pos"))["arguments"]).alias("arguments"))


def parsed_with_fallback(rows: DataFrame, text: str) -> DataFrame:
    """rows with value and step: canonical JSON of text, by the first step that can read it: strict, without a code
    fence, from the first to the last brace, as a repaired list; 'failed' if none can."""
    c = F.col(text)
    steps = [("strict", J.canonical(c)), ("fence", J.canonical(X.without_fence(c))), ("braces", J.canonical(X.outer_object(c))), ("list", J.repaired_list(c))]
    tried = rows.withColumn("tried", F.array(*[F.struct(F.lit(k).alias("step"), v.alias("value")) for k, v in steps]))
    first = F.get(F.filter("tried", lambda x: x["value"].isNotNull()), F.lit(0))
    return tried.withColumn("first", first).withColumn("value", F.col("first.value")).withColumn("step", F.coalesce("first.step", F.lit("failed"))).drop("tried", "first")
