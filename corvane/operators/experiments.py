"""Experiment composition and the checks around runs (JOI-04, JOI-12, JOI-15, PRD-10, PRD-11, AGG-02, AGG-05, AGG-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.jsonx import parsed
from corvane.operators.records import name_key
from corvane.operators.sampling import quota_sample


def compose(en: DataFrame, vi: DataFrame, custom: DataFrame, one: tuple[dict[str, int], int], two: tuple[dict[str, int], int], seed: int = 42) -> DataFrame:
    """(experiment, rid, language) of the training rows: e1 a quota sample of English rows, e2 the Vietnamese rows of
    the same ids, e3 a smaller sample in both languages, e4 that and the custom rows; e0 trains on nothing.

    one and two: (positives per source, negatives). Samples are drawn among ids that both languages have."""
    both = en.join(vi.select("id"), "id", "left_semi")
    pos = F.coalesce(F.size("function_calls") > 0, F.lit(False))
    pick = lambda q, s: quota_sample(both.select("id", "rid", "source", "function_calls"), "id", "source", pos, q[0], q[1], s).select("id", "rid")
    a, b = pick(one, seed), pick(two, seed + 300)
    other = lambda x: vi.join(x.select("id"), "id", "left_semi").select("rid")
    row = lambda df, e, lang: df.select(F.lit(e).alias("experiment"), "rid", F.lit(lang).alias("language"))
    e3 = lambda name: row(b, name, "en").union(row(other(b), name, "vi"))
    return row(a, "e1", "en").union(row(other(a), "e2", "vi")).union(e3("e3")).union(e3("e4")).union(row(custom, "e4", "vi"))


def unpaired(composed: DataFrame, records: DataFrame, experiment: str) -> DataFrame:
    """Ids of an experiment that do not occur once in each language; empty for a sound bilingual set."""
    r = composed.where(F.col("experiment") == experiment).join(records.select("rid", "id"), "rid")
    return r.groupBy("id").agg(F.count_if(F.col("language") == "en").alias("n_en"), F.count_if(F.col("language") == "vi").alias("n_vi")).where("n_en <> 1 or n_vi <> 1")


def training_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by each single column and in total, in one pass."""
    g = rows.groupingSets([[], *[[c] for c in by]], *by).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in by])
    dim = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in by], F.lit("total"))
    val = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in by], F.lit("all"))
    return g.select(dim.alias("dimension"), val.alias("value"), "n")


def aligned(predictions: DataFrame, tests: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Predictions of rows of the test set, with the place of the row there; the others are left out."""
    return predictions.join(tests.select(*keys, F.col(ordinal).alias("ordinal")), keys)


def lockstep(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """One row: indices on both sides, only left, only right, and repeated ones; all but the first have to be 0."""
    n = lambda df, c: df.groupBy(index).agg(F.count("*").alias(c))
    j = n(left, "l").join(n(right, "r"), index, "full_outer")
    return j.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if((F.coalesce("l", F.lit(1)) > 1) | (F.coalesce("r", F.lit(1)) > 1)).alias("repeated"))


def preflight(rows: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """(name, want, got, ok) for conditions and the number of rows that have to meet them, in one pass."""
    got = rows.agg(*[F.count_if(c).alias(k) for k, (c, _) in expected.items()])
    one = [F.struct(F.lit(k).alias("name"), F.lit(n).cast("long").alias("want"), F.col(k).alias("got"), (F.col(k) == n).alias("ok")) for k, (_, n) in expected.items()]
    return got.select(F.explode(F.array(*one)).alias("x")).select("x.*")


def without_unseen(train: DataFrame, unseen: DataFrame, key: str = "rid") -> DataFrame:
    """Training rows of which no call names an unseen tool; unseen(name)."""
    called = train.select(key, F.explode("function_calls").alias("c")).select(key, name_key(F.col("c.name")).alias("name"))
    bad = called.join(unseen.select(name_key(F.col("name")).alias("name")).distinct(), "name", "left_semi").select(key).distinct()
    return train.join(bad, key, "left_anti")


def statistics(records: DataFrame) -> DataFrame:
    """One row per source: records, mean query length, distinct tools, mean tools and calls of a record, mean parameters
    of a tool (AGG-25)."""
    r = records.select("source", "rid", F.length("query").alias("len"), F.greatest(F.coalesce(F.size("tools"), F.lit(0)), F.lit(0)).alias("nt"), F.greatest(F.coalesce(F.size("function_calls"), F.lit(0)), F.lit(0)).alias("nc"))
    a = r.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("len"), 4).alias("mean_query_length"), F.round(F.avg("nt"), 4).alias("mean_tools"), F.round(F.avg("nc"), 4).alias("mean_calls"))
    v = parsed(F.col("t.parameters"))
    keys = lambda x: F.size(F.json_object_keys(F.to_json(x)))
    schema = F.try_variant_get(v, "$.type", "string") == "object"
    n = F.when(schema, keys(F.try_variant_get(v, "$.properties", "variant"))).otherwise(keys(v))
    t = records.select("source", F.explode("tools").alias("t")).select("source", name_key(F.col("t.name")).alias("name"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias("np")).where("name <> ''")
    t = t.groupBy("source", "name").agg(F.sum("np").alias("np"), F.count("*").alias("k")).groupBy("source").agg(F.count("*").alias("n_tools"), F.round(F.sum("np") / F.sum("k"), 4).alias("mean_parameters"))
    return a.join(t, a["source"].eqNullSafe(t["source"]), "left").drop(t["source"]).fillna(0, ["n_tools"])


def top_categories(rows: DataFrame, category: str = "category", k: int = 20) -> DataFrame:
    """The k most frequent categories, ties by name (a top-k report)."""
    return rows.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category).limit(k)


def file_counts(rows: DataFrame) -> DataFrame:
    """Rows of each input file."""
    return rows.select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file")).groupBy("file").agg(F.count("*").alias("n"))
