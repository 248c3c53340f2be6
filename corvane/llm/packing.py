"""Filling fixed-capacity containers with texts (problem 8).

Lengths are tokens of a public tokenizer. Minimum bin slack: a container starts with the longest length left; a bitset
of reachable sums over all lengths left (one shift and one OR for each, as whole-word operations on integers of CAPACITY
bits) finds the fullest combination, which is taken as often as the counts allow. That works on the histogram of lengths,
which has at most CAPACITY rows whatever the size of the corpus; the texts themselves are only ranked within their length
and looked up in the plan. A text longer than CAPACITY is cut into full containers and a rest.

Cases: null and empty texts have no tokens and take no room (no row); equal texts are items of their own; special-token
strings count as ordinary text; an empty table gives no rows; ties go by doc_id and part.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corvane.session import cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
RANKED = 200_000  # items that are ranked in one task, about
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a rank file."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each non-empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> '' and doc_id is not null").mapInArrow(run, "doc_id long, n_tokens long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths (descending) that fills room best, by a bitset of reachable sums."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for w in lengths:
        if w > room:
            continue
        left, part = min(counts[w], room // w), 1
        while left:
            part = min(part, left)
            new = reach | reach << w * part & mask
            if new != reach:
                steps.append((w, part, reach))
                reach = new
            left -= part
            part *= 2
        if reach >> room:
            break
    best, take = reach.bit_length() - 1, {}
    for w, part, before in reversed(steps):
        if not before >> best & 1:
            best -= w * part
            take[w] = take.get(w, 0) + part
    return take


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, how many containers have it) that together hold the histogram of lengths."""
    counts = dict(histogram)
    lengths = sorted(counts, reverse=True)
    plan = []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        take = fullest(lengths, counts, capacity - top)
        counts[top] += 1
        take[top] = take.get(top, 0) + 1
        times = min(counts[w] // n for w, n in take.items())
        for w, n in take.items():
            counts[w] -= n * times
        plan.append((take, times))
        lengths = [w for w in lengths if counts[w]]
    return plan


def pack(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, part, start_token, n_tokens, container): the container of each text or part of a long one."""
    spark = documents.sparkSession
    n = cut(token_counts(documents, path))
    parts = F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / CAPACITY).cast("int"))
    items = n.select("doc_id", "n_tokens", F.explode(parts).alias("part")).select("doc_id", "part", F.least(F.lit(CAPACITY), F.col("n_tokens") - F.col("part") * CAPACITY).cast("int").alias("size"))
    # twice the same doc_id: both rows are items
    total = n.count()
    salts = max(1, total // RANKED)
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)))
    counted = cut(items.groupBy("size", "salt").count())  # at most CAPACITY * salts rows
    histogram = {r[0]: r[1] for r in counted.groupBy("size").agg(F.sum("count")).collect()}  # at most CAPACITY rows
    rows, container, used = [], 0, dict.fromkeys(histogram, 0)
    for take, times in minimum_slack(histogram):
        for w, k in take.items():
            rows.append((w, used[w], k, container))
            used[w] += k * times
        container += times
    rows.sort()
    by: dict[int, list] = {}
    for w, at, k, c in rows:
        by.setdefault(w, []).append((at, k, c))
    share = spark.sparkContext.broadcast({w: ([a for a, _, _ in v], v) for w, v in by.items()})
    before = F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("size", "salt", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "part")) - 1
    items = items.withColumn("rank", rank).join(offsets, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = share.value
        for b in batches:
            out = []
            for w, r in zip(b.column("size").to_pylist(), b.column("rank").to_pylist()):
                starts, v = plan[w]
                at, k, c = v[bisect_right(starts, r) - 1]
                out.append(c + (r - at) // k)
            start = pa.array([p * CAPACITY for p in b.column("part").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), start, b.column("size"), pa.array(out, pa.int64())], names=["doc_id", "part", "start_token", "n_tokens", "container"])

    return items.select("doc_id", "part", "size", "rank").mapInArrow(place, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start_token", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("container", T.LongType())]))


def containers(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(container, n_items, n_tokens, slack) of each container."""
    return pack(documents, path).groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), (F.lit(CAPACITY) - F.sum("n_tokens")).alias("slack"))
