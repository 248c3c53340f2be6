"""Broken prompt and response pairs (problem 1).

Copies: the query is a zstandard dictionary for each answer value; a value that adds next to nothing to it is compared
word by word. Cut-off objects: a terminal-context model, the state (open brackets, open string) in which a text ends.
Refusals: dictionaries of cues per language that have to meet in one sentence (``refusals``); words that the query itself
dictates are none. Other languages: the naive Bayes model of ``langid``.

Cases: only records with has_tool_call = true and failed rows with an error are looked at; a pair may have several
defects and gets one row for each; null or empty calls, blank names and null, blank or 'null' arguments count as empty;
badly written but complete objects are read as far as they can be; texts of any length are read whole.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.langid import LANGS, scores, text_segments, without_accents
from corvane.llm.refusals import refusal_column, refuses
from corvane.llm.textform import consistent, consistent_udf, strict_json, strings, words

SENTENCE_WORDS, SHORT_SENTENCE, LANGUAGE_MARGIN, PIECE = 4, 2, 6.0, 50_000
DICTATED = 0.6  # a value with this share of its words in the query is content that was asked for, no refusal
# What errors say of a model's answer with a defect, lower case, without accents; all else are failures of
# other kinds (network, quota, server, settings).
ERRORS = {
    "truncated": r"unterminated|truncat|\bcut (?:off|short)\b|\btext ends\b|\bends (?:abruptly|too early)|stops in the middle|\bnever (?:reached|closed)\b|finish_reason\W{1,3}length|unexpected end of (?:json|input|text|output)|incomplete (?:json|object|output|answer)|\bbi cat\b",
    "copy": r"\bis the source\b|\becho|\bequals? (?:the )?(?:source|input|query|prompt)|\bsame as (?:the )?(?:source|input|query|prompt)|\bidentical to (?:the )?(?:source|input|query|prompt)|no change between|\brepeat(?:s|ed|ing)? the (?:prompt|input|source|query)|trung khop (?:hoan toan )?voi|giong het cau goc",
    "other_language": r"target language mismatch|wrong language|text looks like (?!vi\b)|detected \w+ but (?:wanted|expected|needed)|came back in \w+ script|(?:reply|answer|output) is in (?!vietnamese)\w+|bang tieng \S+ chu khong phai",
    "empty": r"emptyoutput|\bempty (?:output|answer|completion|content|response text)\b|(?:content|answer|output) is (?:none|null|empty|blank)\b|nothing but (?:whitespace|blanks)|(?:completion|answer|output)\b.{0,20} has length 0\b|tra ve rong|nothing left after",
    "refusal": r"policystop|\btu choi (?:dich|tra loi|thuc hien)",
}


def plain_text(form: str) -> str:
    """Lower case, without accents, with straight apostrophes."""
    low = form.lower()
    return low if low.isascii() else without_accents(low.replace("’", "'"))


def is_refusal(form: str) -> bool:
    """form: a text in consistent form."""
    return refuses(plain_text(form))


def is_sentence(form: str, n_words: int) -> bool:
    """At least SENTENCE_WORDS words, or SHORT_SENTENCE words and an end mark."""
    return n_words >= SENTENCE_WORDS or n_words >= SHORT_SENTENCE and form.rstrip()[-1:] in (".", "!", "?", "…")


def ends_early(text: str) -> bool:
    """Whether the object or array that text holds breaks off: brackets or a string are open where it ends.

    A single quote counts as a quote only where a key or value may begin, so badly written text is followed too."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return False
    depth, quote, skip, before = 0, "", False, ""
    for c in text[at:]:
        if quote:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == quote:
                quote = ""
                before = c
            continue
        if c == '"' or (c == "'" and before in "{[,:("):
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                return False
        if not c.isspace():
            before = c
    return depth > 0 or bool(quote)


def read_arguments(text: str) -> tuple[object, bool]:
    """(value, cut off): the decoded arguments, None if they can't be read, and whether they break off."""
    t = text.strip()
    if t[:1] == '"':
        try:
            inner = strict_json(t)
        except (ValueError, RecursionError):
            inner = t[1:].replace('\\"', '"').replace("\\\\", "\\")
            if t[-1:] == '"' and not t.endswith('\\"'):
                inner = inner[:-1]
        if not isinstance(inner, str):
            return inner, False
        t = inner.strip()
    try:
        return strict_json(t), False
    except (ValueError, RecursionError):
        pass
    if ends_early(t):
        return None, True
    try:
        return ast.literal_eval(t), False
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        pass
    try:
        return json.loads(re.sub(r",\s*([}\]])", r"\1", t)), False
    except (ValueError, RecursionError):
        return None, False


class Prompt:
    """The words of a query as zstandard dictionaries, one for each PIECE bytes of it."""

    def __init__(self, line: bytes):
        self.size = len(line)
        self.frames = []
        for i in range(0, len(line), PIECE):
            d = zstandard.ZstdCompressionDict(line[i : i + PIECE], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.frames.append(zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False))

    def adds_nothing(self, text: bytes) -> bool:
        """Whether text costs next to nothing beside the query: true of every copy, whatever its length."""
        pieces = zip(self.frames, range(0, self.size, PIECE))
        return len(text) <= self.size and all(len(f.compress(part := text[i : i + PIECE])) <= 40 + len(part) // 16 for f, i in pieces)


def answer_defects(query: str | None, calls: list[dict] | None) -> tuple[set[str], list[str]]:
    """The defects that need no language model, and the sentences among the values that are no refusals."""
    out: set[str] = set()
    foreign: list[str] = []
    calls = [c for c in calls or [] if c]
    full = [c for c in calls if (c["name"] or "").strip() and (c["arguments"] or "").strip() not in ("", "null")]
    if not full:
        out.add("empty")
    own = words(query)
    line, asked = " ".join(own).encode(), set(own)
    frame = None
    for c in calls:
        if not c["arguments"]:
            continue
        value, cut = read_arguments(c["arguments"])
        if cut:
            out.add("truncated")
        for s in strings(value):
            form = consistent(s)
            ws = words(form)
            text = " ".join(ws).encode()
            if ws and 2 * len(text) >= len(line):
                if frame is None:
                    frame = Prompt(line)
                if frame.adds_nothing(text) and ws == own:
                    out.add("copy")
                    continue
            if is_refusal(form) and sum(w in asked for w in ws) < DICTATED * len(ws):
                out.add("refusal")
            elif is_sentence(form, len(ws)):
                foreign.append(form)
    return out, foreign


def record_defects(spark: SparkSession, records: DataFrame, model: np.ndarray) -> DataFrame:
    """(rid, defect) of the records with has_tool_call = true."""
    share = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                rid, query = b.column("rid").to_pylist(), b.column("query").to_pylist()
                found, held, texts = [], [], []
                for i, (q, c) in enumerate(zip(query, b.column("function_calls").to_pylist())):
                    d, foreign = answer_defects(q, c)
                    found += [(rid[i], x) for x in sorted(d)]
                    if q and q.strip():
                        texts += foreign
                        held += [i] * len(foreign)
                sc = scores(texts, m)
                asked = sorted(set(held))
                spoken = dict(zip(asked, text_segments([query[i] for i in asked], m)))
                odd = set()
                for i, x in zip(held, sc):
                    own = {k for k, _ in spoken[i]}
                    if own and int(x.argmax()) not in own and x.max() - max(x[k] for k in own) > LANGUAGE_MARGIN:
                        odd.add(rid[i])
                found += [(r, "other_language") for r in odd]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], names=["rid", "defect"])

    return records.where("has_tool_call").select("rid", "query", "function_calls").mapInArrow(run, "rid long, defect string")


def error_defect(error: Column) -> Column:
    """The defect that an error names, null for other failures; the dictionaries are matched in the JVM."""
    marks = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđäöüñçё"
    bare = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyydaouncе"
    composed = F.regexp_replace(consistent_udf(error), "’", "'")
    plain = F.translate(F.lower(composed), marks, bare)
    d = None
    for k, p in ERRORS.items():
        d = F.when(plain.rlike(p), k) if d is None else d.when(plain.rlike(p), k)
    return d.when(refusal_column(plain), "refusal")


def failed_defects(failed: DataFrame) -> DataFrame:
    """(fail_id, defect) of the failed rows whose error names a defect of the answer."""
    return failed.select("fail_id", error_defect(F.col("error")).alias("defect")).where("defect is not null and fail_id is not null")


def found(spark: SparkSession, records: DataFrame, failed: DataFrame, model: np.ndarray) -> DataFrame:
    """(kind, row_key, defect) of both tables."""
    r = record_defects(spark, records.where("rid is not null"), model).select(F.lit("record").alias("kind"), F.col("rid").alias("row_key"), "defect")
    f = failed_defects(failed).select(F.lit("failed").alias("kind"), F.col("fail_id").alias("row_key"), "defect")
    return r.union(f)
