"""Visually identical text with different characters (problem 2).

The look-alike map of ``textform`` gives every value its mapped form. Values whose mapped forms are equal under the
accent-sensitive collation UNICODE are one class; the canonical member of a class is its shortest mapped form, ties by
code points; it is joined back to every value of the class. A value has to change if it differs from it.

Cases: null fields give no row; '' and blank texts are their own form unless a blank is not U+0020; repeated values are
mapped once; arguments that can't be decoded hold no value; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import cut
from corvane.llm.textform import SUSPECT, _NONLATIN, consistent, consistent_udf, decoded, strings


def canonical_members(values: DataFrame) -> DataFrame:
    """(value, canonical) for each distinct non-null value of the column ``value``."""
    m = cut(values.select("value").where("value is not null").distinct().withColumn("mapped", consistent_udf("value")))
    classes = m.withColumn("class", F.collate("mapped", "UNICODE"))
    # one row for each mapped form before the collation compares anything: a hot class is aggregated map-side
    canon = classes.groupBy("class").agg(F.min(F.struct(F.length("mapped").alias("n"), F.col("mapped").alias("form"))).alias("best")).select("class", F.col("best.form").alias("canonical"))
    return classes.join(canon, "class").select("value", "canonical")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _odd_strings(a: pd.Series) -> pd.Series:
    def odd(text: str | None) -> list[str]:
        return list(dict.fromkeys(s for s in strings(decoded(text)) if consistent(s) != s or _NONLATIN.search(s)))

    return a.map(odd)


def field_values(records: DataFrame) -> DataFrame:
    """(rid, field, value): the query and the string values in arguments that may not be in the consistent form.

    The pattern runs in the JVM, so plain ASCII values never reach Python."""
    q = records.select("rid", F.lit("query").alias("field"), F.col("query").alias("value")).where(F.col("value").rlike(SUSPECT))
    a = (
        records.select("rid", F.explode("function_calls").alias("c"))
        .select("rid", F.col("c.arguments").alias("a"))
        .where(F.col("a").rlike(SUSPECT) | F.col("a").contains("\\"))
        .select("rid", F.lit("arguments").alias("field"), F.explode(_odd_strings("a")).alias("value"))
    )
    return q.union(a)


def changed_fields(records: DataFrame) -> DataFrame:
    """(rid, field, n_values): the fields of each record that differ from their consistent form, and in how many values."""
    v = cut(field_values(records))  # read by the classes and by the join back
    c = canonical_members(v)
    return v.join(c, "value").where("value <> canonical").groupBy("rid", "field").agg(F.count("*").alias("n_values"))


def consistent_queries(records: DataFrame) -> DataFrame:
    """(rid, query, form, changed) for every record; null queries keep a null form and changed = false."""
    q = records.select("rid", "query").withColumn("odd", F.coalesce(F.col("query").rlike(SUSPECT), F.lit(False)))
    c = canonical_members(q.where("odd").select(F.col("query").alias("value")))
    return q.join(c, F.col("odd") & (q["query"] == c["value"]), "left").select("rid", "query", F.coalesce("canonical", "query").alias("form"), F.coalesce(F.col("canonical") != F.col("query"), F.lit(False)).alias("changed"))
