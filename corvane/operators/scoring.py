"""Scores of predictions (AGG-11..13, AGG-21..24, ARR-*, SET-04)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.functions.jsonx import canonical, parsed
from corvane.functions.output import parse_output
from corvane.functions.text import error_class
from corvane.operators.records import name_key, names


def call_key(calls: Column) -> Column:
    """Calls as comparable text: name and canonical arguments, in order."""
    return F.transform(F.coalesce(calls, F.expr("array()")), lambda c: F.concat(F.coalesce(F.trim(c["name"]), F.lit("")), F.lit("\x1f"), F.coalesce(F.to_json(parsed(c["arguments"])), F.lit("{}"))))


def scored(predictions: DataFrame, parser: str = "shared") -> DataFrame:
    """predictions with calls, errors and the flags is_pos, names_ok, exact, exact_any_order, clean, neg_ok, failed."""
    p = predictions.withColumn("out", parse_output(F.col("raw_output"), parser)).select("*", "out.calls", "out.errors").drop("out")
    gold, got = call_key(F.col("gold")), call_key(F.col("calls"))
    n_gold = F.coalesce(F.size(F.coalesce("gold", F.expr("array()"))), F.lit(0))
    p = p.withColumn("is_pos", n_gold > 0)
    p = p.withColumn("names_ok", F.coalesce(names(F.col("gold")) == names(F.col("calls")), F.lit(False)) & F.col("is_pos"))
    p = p.withColumn("set_ok", F.coalesce(F.array_sort(F.array_distinct(names(F.col("gold")))) == F.array_sort(F.array_distinct(names(F.col("calls")))), F.lit(False)) & F.col("is_pos"))
    p = p.withColumn("exact", gold == got).withColumn("exact_any_order", F.array_sort(gold) == F.array_sort(got))
    p = p.withColumn("failed", F.size("errors") > 0)
    return p.withColumn("clean", F.col("exact") & ~F.col("failed")).withColumn("neg_ok", ~F.col("is_pos") & (F.size("calls") == 0) & ~F.col("failed"))


def metrics(s: DataFrame, *by: str) -> DataFrame:
    """Counts and percentages for each group; accuracies over an empty set are null. A malformed output on a row without
    gold calls counts as exact, as in the published figures; clean_pct leaves it out."""
    pct = lambda n, d: F.round(100 * n / F.nullif(d, F.lit(0)), 2)
    cnt = lambda c: F.count_if(c if isinstance(c, Column) else F.col(c))
    a = s.groupBy(*by).agg(F.count("*").alias("n"), cnt("is_pos").alias("n_pos"), cnt(~F.col("is_pos")).alias("n_neg"), cnt("names_ok").alias("k1"), cnt("set_ok").alias("k2"), cnt("exact").alias("k3"), cnt("exact_any_order").alias("k4"), cnt("clean").alias("k5"), cnt("neg_ok").alias("k6"), cnt("failed").alias("k7"))
    c = F.col
    return a.select(*by, "n", "n_pos", "n_neg", pct(c("k1"), c("n_pos")).alias("tool_pct"), pct(c("k2"), c("n_pos")).alias("tool_set_pct"), pct(c("k3"), c("n")).alias("exact_pct"), pct(c("k4"), c("n")).alias("exact_any_order_pct"), pct(c("k5"), c("n")).alias("clean_pct"), pct(c("k6"), c("n_neg")).alias("non_call_pct"), pct(c("k7"), c("n")).alias("syntax_error_pct"))


def argument_errors(predictions: DataFrame) -> DataFrame:
    """(pred_id, run, nth, name, key, gold, predicted, cls) of each top-level gold argument: cls is null if its value is
    predicted, else W, T, P or I (STR-26).

    The n-th gold call of a name is compared with the n-th parsed call of that name; without one all of its arguments
    are missing. Values are equal as JSON, as in the scores; one of the same text but another type is P."""
    args = lambda c: F.try_variant_get(parsed(c), "$", "map<string, variant>")
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))

    def calls(df: DataFrame, c: str) -> DataFrame:
        ns = names(F.col(c))
        nth = lambda x, i: F.size(F.filter(F.slice(ns, F.lit(1), i + 1), lambda n: n.eqNullSafe(name_key(x["name"]))))
        return df.select("pred_id", "run", "query", F.explode(F.transform(c, lambda x, i: F.struct(name_key(x["name"]).alias("name"), nth(x, i).alias("nth"), x["arguments"].alias("args")))).alias("c")).select("pred_id", "run", "query", "c.*")

    one = lambda df, c, v: calls(df, c).select("pred_id", "run", "query", "name", "nth", F.explode(args(F.col("args"))).alias("key", "v")).select("pred_id", "run", "query", "name", "nth", "key", F.to_json("v").alias(f"{v}_json"), text(F.col("v")).alias(v))
    p = predictions.select("pred_id", "run", "query", "gold", parse_output(F.col("raw_output"))["calls"].alias("calls"))
    g, o = one(p, "gold", "gold"), one(p, "calls", "predicted").drop("run", "query")
    on = F.expr("g.pred_id = o.pred_id and g.name <=> o.name and g.nth = o.nth and g.key = o.key")
    j = g.alias("g").join(o.alias("o"), on, "left").select("g.*", "predicted", "predicted_json")
    k = F.when(F.col("gold_json") == F.col("predicted_json"), None).otherwise(F.coalesce(error_class(F.col("gold"), F.col("predicted"), F.coalesce("query", F.lit(""))), F.lit("P")))
    return j.select("pred_id", "run", "nth", "name", "key", "gold", "predicted", k.alias("cls"))


def latency(predictions: DataFrame, *by: str) -> DataFrame:
    """Per-sample latency: mean, exact P50 and P95 with linear interpolation."""
    ms = F.col("batch_latency_ms") / F.nullif(F.col("batch_size"), F.lit(0))
    return predictions.withColumn("ms", ms).groupBy(*by).agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(F.percentile("ms", 0.5), 4).alias("p50_ms"), F.round(F.percentile("ms", 0.95), 4).alias("p95_ms"))


def confusion_scores(pairs: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn, precision, recall, f1) from (gold, predicted); 'no call' is a class of its own (AGG-22)."""
    c = pairs.groupBy("gold", "predicted").count()
    g = c.select(F.col("gold").alias("cls"), F.when(F.col("gold") == F.col("predicted"), F.col("count")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("gold") != F.col("predicted"), F.col("count")).otherwise(0).alias("fn"))
    p = c.where("gold <> predicted").select(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("count").alias("fp"), F.lit(0).cast("long").alias("fn"))
    a = g.union(p).groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    pr, rc = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    z = lambda x, n: F.round(F.coalesce(x, F.lit(0.0)), 6).alias(n)
    return a.select("cls", "tp", "fp", "fn", z(pr, "precision"), z(rc, "recall"), z(f1, "f1"))


def macro_f1(scores: DataFrame) -> DataFrame:
    w = F.col("tp") + F.col("fn")
    return scores.agg(F.count("*").alias("n_classes"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * w) / F.sum(w), 6).alias("weighted_f1"))


def gap(metrics_by: DataFrame, key: str, a: str, b: str, columns: list[str]) -> DataFrame:
    """One row: for each column its value at key = a minus that at key = b (AGG-21)."""
    pick = lambda k, c: F.max(F.when(F.col(key) == k, F.col(c)))
    return metrics_by.agg(*[F.round(pick(a, c) - pick(b, c), 4).alias(f"{c}_gap") for c in columns])


_PRIME = (1 << 31) - 1


def poisson_steps(n: int = 8) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... under a Poisson law of mean 1."""
    out, p, c = [], 0.36787944117144233, 0.0
    for k in range(n):
        c += p
        out.append(c)
        p /= k + 1
    return out


def bootstrap(values: DataFrame, key: str, value: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """One row: mean and the 95 % interval of resampled means (AGG-24).

    Poisson bootstrap: round i gives a row the weight that (x * (i * 48271 + seed) + i) mod (2^31 - 1) falls into, where x
    is 28 bits of the MD5 of its key. A batch is one matrix of weights, and only ``rounds`` pairs of sums leave a task."""
    steps = np.array(poisson_steps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = np.arange(1, rounds + 1, dtype=np.int64)
        factor = (i * 48271 + seed) % _PRIME
        total, weighted = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            x, v = b.column("x").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                u = (x[at : at + 4096, None] * factor + i) % _PRIME / _PRIME
                w = np.searchsorted(steps, u, side="right")
                total += w.sum(axis=0)
                weighted += (w * v[at : at + 4096, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total), pa.array(weighted)], names=["round", "w", "s"])

    x = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long")
    r = values.where(F.col(value).isNotNull()).select(x.alias("x"), F.col(value).cast("double").alias("v")).mapInArrow(run, "round long, w double, s double")
    m = r.groupBy("round").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ci = m.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))
    return values.agg(F.round(F.avg(F.col(value).cast("double")), 6).alias("mean")).join(ci, F.lit(True))  # one row each


def failure_streaks(rows: DataFrame, part: str, order: str, failed: Column, least: int = 2) -> DataFrame:
    """(part, first, last, n): runs of at least ``least`` failures in a row (WIN-06), as gaps and islands."""
    by = W.partitionBy(part).orderBy(order)
    r = rows.withColumn("bad", F.coalesce(failed, F.lit(False))).withColumn("k", F.row_number().over(by))
    i = F.col("k") - F.row_number().over(W.partitionBy(part, "bad").orderBy(order))
    return r.withColumn("island", i).where("bad").groupBy(part, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")
