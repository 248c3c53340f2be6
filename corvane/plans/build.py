"""Build of a frozen revision: pair, validate, deduplicate, group and split, enrich, verify, write, publish.

All stages are lazy DataFrames over one table of records; what several stages read is cut once to the shared folder.
Checks are gathered into one table and raised together, so a failed build names all of its faults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import dedup, pairing, pool, records, reports, split
from corvane.operators.graph import components, dominant_stratum
from corvane.operators.records import name_key
from corvane.session import cut
from corvane.sources import sinks


@dataclass(frozen=True)
class BuildConfig:
    """Parameters of a build."""

    seed: int = 42
    strict_pairs: bool = False  # whether a pair that disagrees ends the build or is left out
    default_category: str = "Khác"


@dataclass
class Revision:
    """Stages of a build as DataFrames."""

    rows: DataFrame  # rid, id, source, language, query, function_calls, tools, has_tool_call, split
    rejected: DataFrame  # id, stage, reason
    pool: DataFrame
    checks: DataFrame  # name, n_bad


def plan(spark: SparkSession, raw: DataFrame, tool_pool: DataFrame, config: BuildConfig | None = None) -> Revision:
    c = config or BuildConfig()
    v = records.validated(raw.where("id is not null"), deep=True)
    en, vi = cut(pairing.one_per_id(v, "en")), cut(pairing.one_per_id(v, "vi"))
    p = pairing.pairs(en, vi)
    checks = pairing.pair_shapes(p)
    agree = F.expr("same_source and same_polarity and same_calls and same_tools")
    p = cut(p.join(checks.select("id", agree.alias("agree")), "id"))
    bad_pair = p.where("not agree").select("id", F.lit("pair").alias("stage"), F.lit("versions disagree").alias("reason"))
    bad_rule = p.where("agree and not (en.ok and vi.ok)").select("id", F.lit("rules").alias("stage"), F.concat_ws("; ", "en.errors", "vi.errors").alias("reason"))
    good = p.where("agree and en.ok and vi.ok")
    key = dedup.canonical_scenario_key(X.query_key(F.col("en.query")), F.col("en.source"), F.col("en.function_calls"), F.col("en.tools"))
    d = cut(dedup.first_wins(good.select("id", "en", "vi", F.col("en.rid").alias("ord"), key.alias("sk")), ["id"], "sk", "ord"))
    dup = d.where("reason is not null").select("id", F.lit("duplicate").alias("stage"), "reason")
    u = d.where("reason is null").select("id", "en", "vi")
    nodes = u.select("id", F.concat(F.lit("en:"), X.query_key(F.col("en.query"))).alias("a"), F.concat(F.lit("vi:"), X.query_key(F.col("vi.query"))).alias("b"), F.col("en.source").alias("source"), (F.size("en.function_calls") > 0).alias("positive"))
    comp = components(nodes, "a", "b")
    g = cut(nodes.join(comp, nodes["a"] == comp["node"]).select("id", F.sha2("root", 256).alias("grp"), "source", "positive"))
    strata = dominant_stratum(g, "grp", "source", "positive").select("grp", F.concat_ws("/", "s0", F.col("s1").cast("string")).alias("stratum"))
    to = split.greedy_group_split(g.groupBy("grp").agg(F.count("*").alias("size")).join(strata, "grp"), seed=c.seed)
    to = g.join(to, "grp").select("id", F.col("split").alias("to"))
    both = u.join(to, "id")
    one = lambda s: both.select(F.col(f"{s}.rid").alias("rid"), "id", F.col(f"{s}.source").alias("source"), F.lit(s).alias("language"), F.col(f"{s}.query").alias("query"), F.col(f"{s}.function_calls").alias("function_calls"), records.canonical_tools(F.col(f"{s}.tools")).alias("tools"), (F.size(f"{s}.function_calls") > 0).alias("has_tool_call"), F.col("to").alias("split"))
    rows = cut(one("en").union(one("vi")))
    cache = tool_pool.where("feature_group is not null").groupBy(name_key(F.col("name")).alias("name")).agg(F.min_by("feature_group", "tool_id").alias("category"))
    used = rows.where("language = 'vi'").select("rid", F.posexplode("tools").alias("pos", "t")).select(F.format_string("%020d.%06d", "rid", "pos").alias("ord"), F.col("t.name").alias("name"), F.col("t.description").alias("description"), F.col("t.parameters").alias("parameters"))
    merged = pool.merge_pool(used, "ord", F.contains(F.col("parameters"), F.lit("type"))).drop("name").withColumnRenamed("key", "name")
    merged = pairing.with_category(merged, cache, c.default_category)
    kinds = {f"{k}/{s}": F.when(F.col("language") == s, x) for s in ("en", "vi") for k, x in (("id", F.col("id")), ("query", F.nullif(X.query_key(F.col("query")), F.lit(""))))}
    leak = dedup.leakage(rows, kinds).select(F.concat(F.lit("leak: "), "kind").alias("name"), F.col("n_leaking").alias("n_bad"))
    sides = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s")).agg(F.count_if((F.col("n") != 2) | (F.col("s") != 1)).alias("n_bad")).select(F.lit("both languages in one split").alias("name"), "n_bad")
    again = records.validated(rows, deep=True).agg(F.count_if(~F.col("ok")).alias("n_bad")).select(F.lit("rules").alias("name"), "n_bad")
    found = leak.union(sides).union(again)
    if c.strict_pairs:
        found = found.union(bad_pair.agg(F.count("*").alias("n_bad")).select(F.lit("pairs").alias("name"), "n_bad"))
    return Revision(rows, bad_pair.union(bad_rule).union(dup), merged, found)


def write(spark: SparkSession, revision: Revision, path: str, overwrite: bool = False, config: BuildConfig | None = None) -> dict:
    """Publish a revision with metadata and a manifest of content hashes; raises if a check fails."""
    faults = [r.asDict() for r in revision.checks.where("n_bad > 0").collect()]
    if faults:
        raise ValueError(f"checks failed: {faults}")

    def build(stage: str) -> None:
        revision.rows.repartition("language", "split").write.partitionBy("language", "split").parquet(f"{stage}/records")
        revision.pool.write.parquet(f"{stage}/tool_pool")
        revision.rejected.write.parquet(f"{stage}/rejected")
        got = spark.read.parquet(f"{stage}/records")
        meta = {
            "counts": [r.asDict() for r in reports.corpus_counts(got).orderBy("dimension", "value").collect()],
            "splits": [r.asDict() for r in got.groupBy("language", "split").count().orderBy("language", "split").collect()],
            "rejected": [r.asDict() for r in spark.read.parquet(f"{stage}/rejected").groupBy("stage").count().orderBy("stage").collect()],
            "ids": [r.asDict() for r in reports.id_digest(got, "id", "language", "split").orderBy("language", "split").collect()],
            "config": (config or BuildConfig()).__dict__,
        }
        sinks.write_json(spark, f"{stage}/metadata.json", meta)
        # the manifest has a row for each file; it is a table, and metadata.json tells that the build came to its end
        sinks.manifest(spark, stage, skip=("manifest.json", ".tmp", "_SUCCESS", ".crc")).withColumn("path", F.regexp_replace("path", "^.*\\.staging/", "")).write.parquet(f"{stage}/manifest")

    sinks.publish(spark, path, build, overwrite)
    return sinks.read_json(spark, f"{path}/metadata.json")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Files whose content no longer has the hash of the manifest, and files that are gone."""
    want = spark.read.parquet(f"{path}/manifest")
    got = sinks.manifest(spark, path).withColumn("path", F.regexp_replace("path", f"^.*{path.rstrip('/').rsplit('/', 1)[-1]}/", "")).select("path", F.col("sha256").alias("now"))
    return want.join(got, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", "sha256", "now")
