"""String operators: keys, predicates, dialogue turns, call blocks, cues, spans, value normalisation.

Column builders stay in the JVM; the Arrow functions are those for which Spark has no built-in (Unicode normal forms,
case folding, brace-balanced scans). Null stays null unless stated otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- keys (STR-01, STR-02) -------------------------------------------------------------------------------------------


def ascii_key(c: Column) -> Column:
    """Lower case, runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " ")))


def _folded(form: str):
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: " ".join(unicodedata.normalize(form, x).casefold().split()), na_action="ignore")

    return f


_nfkc = F.pandas_udf(_folded("NFKC"), T.StringType())
_nfc = F.pandas_udf(_folded("NFC"), T.StringType())


def query_key(c: Column, form: str = "NFKC") -> Column:
    """Unicode normal form, case folded, white space squeezed. Plain ASCII never leaves the JVM."""
    udf = {"NFKC": _nfkc, "NFC": _nfc}[form]
    return F.when(c.rlike(r"^[\x20-\x7E\t\n\r]*$"), ascii_key(c)).otherwise(udf(F.when(~c.rlike(r"^[\x20-\x7E\t\n\r]*$"), c)))


# ---- predicates (PRD-01) ----------------------------------------------------------------------------------------------


def is_snake_case(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z][a-z0-9_]*\z"), F.lit(False))


# ---- dialogue text (STR-03..06, STR-16) ------------------------------------------------------------------------------

# The markers that open a turn, in English and Vietnamese.
USER = ("USER", "NGƯỜI DÙNG", "KHÁCH HÀNG")
ASSISTANT = ("ASSISTANT", "TRỢ LÝ", "HỖ TRỢ", "A")
FUNCTION = ("FUNCTION RESPONSE", "PHẢN HỒI HÀM")
END = "<|endoftext|>"
_MARK = "(?iu)(?:^|(?<=\n))[ \\t]*(?=(?:" + "|".join(USER + ASSISTANT + FUNCTION) + ")[ \\t]*:)"


def squeeze_blank_lines(c: Column) -> Column:
    """Without end tokens, at most one blank line in a row, no white space at the ends."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(END), F.lit("")), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def turns(chat: Column) -> Column:
    """ARRAY<STRUCT<role, content>>: the text cut in front of each marker at the start of a line; text before the first
    marker is left out."""

    def one(s: Column) -> Column:
        head = F.upper(F.trim(F.regexp_extract(s, r"^\s*([^:]*):", 1)))
        role = F.when(head.isin(*USER), "user").when(head.isin(*ASSISTANT), "assistant").when(head.isin(*FUNCTION), "function")
        return F.struct(role.alias("role"), squeeze_blank_lines(F.regexp_replace(s, r"^\s*[^:]*:", "")).alias("content"))

    return F.filter(F.transform(F.split(chat, _MARK), one), lambda t: t["role"].isNotNull())


def call_blocks(c: Column) -> Column:
    """The texts of the call blocks of an assistant turn."""
    return F.regexp_extract_all(c, F.lit(r"(?s)<functioncall>\s*(.+?)\s*(?=<\|endoftext\|>|<functioncall>|\n\n|$)"), F.lit(1))


def parse_calls(blocks: Column) -> Column:
    """ARRAY<STRUCT<name, arguments>> of an array of call blocks: strict JSON first, then tolerant patterns for single-
    or double-quoted arguments; blocks without a snake_case name are left out; arguments that can't be read are '{}'.

    One transform for each step, so that no block is parsed more than once."""
    s = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.try_parse_json(b).alias("v")))
    named = lambda b: F.nullif(F.regexp_extract(b, r"[\"']name[\"']\s*:\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    s = F.transform(s, lambda x: F.struct(x["b"].alias("b"), x["v"].alias("v"), F.coalesce(F.try_variant_get(x["v"], "$.name", "string"), named(x["b"])).alias("name")))
    s = F.filter(s, lambda x: is_snake_case(x["name"]))
    quoted = lambda b: F.coalesce(F.nullif(F.regexp_extract(b, r"(?s)[\"']arguments[\"']\s*:\s*'(.*)'\s*\}\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(b, r"(?s)[\"']arguments[\"']\s*:\s*(\{.*\})\s*\}\s*$", 1), F.lit("")))
    inner = lambda x: F.coalesce(F.try_parse_json(F.try_variant_get(x["v"], "$.arguments", "string")), F.try_variant_get(x["v"], "$.arguments", "variant"), F.try_parse_json(quoted(x["b"])))
    s = F.transform(s, lambda x: F.struct(x["name"].alias("name"), F.to_json(inner(x)).alias("t")))
    return F.transform(s, lambda x: F.struct(x["name"].alias("name"), F.when(x["t"].startswith("{"), x["t"]).otherwise("{}").alias("arguments")))


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text (STR-07), minding strings and escapes."""
    if not text:
        return None
    start = text.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def first_object_udf(s: pd.Series) -> pd.Series:
    return s.map(first_object)


def outer_object(c: Column) -> Column:
    """From the first { to the last } (STR-08)."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def without_fence(c: Column) -> Column:
    """Without lines that open or close a code fence (STR-09)."""
    return F.trim(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~F.ltrim(x).startswith("```")), "\n"))


# ---- small ones (STR-13..26) ------------------------------------------------------------------------------------------


def argument_keys(c: Column) -> Column:
    """Names before a colon inside quotes."""
    return F.regexp_extract_all(c, F.lit(r'"([A-Za-z_][A-Za-z0-9_]*)"\s*:'), F.lit(1))


def error_prefix(c: Column) -> Column:
    """The text before the first colon."""
    return F.trim(F.substring_index(c, ":", 1))


def record_id(source: Column, index: Column) -> Column:
    return F.format_string("%s_%05d", source, index)


def span_of(value: Column, query: Column) -> Column:
    """STRUCT<start, end> of the first verbatim occurrence, in code points; null if there is none."""
    at = F.call_function("locate", value, query) - 1
    return F.when((at >= 0) & (F.length(value) > 0), F.struct(at.alias("start"), (at + F.length(value)).alias("end")))


def iso_utc(c: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC, in sessions of any time zone (DAT-01)."""
    return F.concat(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


# Words that answer a yes/no parameter, as patterns; \\s stands for a blank that has to follow.
YES_CUES = (r"có\s", r"muốn\s", r"cần\s", r"nên\s", r"được\s", "đồng ý", "chấp nhận", "cầu", "yes", "true", "đúng")
NO_CUES = (r"không\s", r"chưa\s", "đừng", "cấm", r"không\s+được", r"không\s+muốn", r"không\s+cần", "no", "false", "sai", "từ chối")


def cue_pattern(cues: tuple[str, ...]) -> str:
    """One pattern for whole words of any script, in syntax that Java and RE2 share."""
    blank, edge = r"[\s\p{Z}]", r"[^\p{L}\p{M}\p{N}_]"
    one = [c[:-2].replace(r"\s", blank) + blank if c.endswith(r"\s") else c.replace(r"\s", blank) + f"(?:{edge}|$)" for c in cues]
    return f"(?i)(?:^|{edge})(?:" + "|".join(one) + ")"


def boolean_cue(c: Column) -> Column:
    """1 if a word of refusal occurs, else 0 if one of consent does, else null; whole words, case ignored (STR-18)."""
    has = lambda cues: c.rlike("(?u)" + cue_pattern(cues))
    return F.when(has(NO_CUES), 1).when(has(YES_CUES), 0)


def schema_question(name: Column, desc: Column, kind: Column, enum: Column) -> Column:
    """The text that asks for a parameter (STR-19)."""
    return F.concat_ws(" ", F.concat(F.lit("Param="), name), F.concat(F.lit("Desc="), F.coalesce(desc, F.lit(""))), F.concat(F.lit("Type="), kind), F.when(F.size(enum) > 0, F.concat(F.lit("Enum="), F.array_join(enum, "|"))))


def category_in(reply: Column, categories: list[str], default: str) -> Column:
    """The first category that the reply contains, else the reply, the default if it is blank (STR-21)."""
    hit = F.filter(F.array(*map(F.lit, categories)), lambda x: F.contains(reply, x))
    return F.coalesce(F.get(hit, F.lit(0)), F.nullif(F.trim(reply), F.lit("")), F.lit(default))


_UNITS = {"nghìn": 1_000, "ngàn": 1_000, "trăm": 100, "triệu": 1_000_000, "tỷ": 1_000_000_000, "tỉ": 1_000_000_000}
_AMOUNT = re.compile(r"^(nửa|rưỡi|\d+(?:[.,]\d+)?)\s*(nghìn|ngàn|trăm|triệu|tỷ|tỉ)(\s+rưỡi)?$")
_DATE = re.compile(r"^(?:ngày\s+)?(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$")


def vi_value(s: str | None, century: int = 2000) -> str | None:
    """Amounts in words as digits, dates with a year as ISO (STR-24); other values in NFC, trimmed."""
    if s is None:
        return None
    t = unicodedata.normalize("NFC", s).strip()
    low = t.lower()
    if m := _AMOUNT.match(low):
        n = 0.5 if m[1] in ("nửa", "rưỡi") else float(m[1].replace(",", "."))
        n = (n + (0.5 if m[3] else 0)) * _UNITS[m[2]]
        return str(int(n)) if n == int(n) else str(n)
    if m := _DATE.match(low):
        d, mo, y = int(m[1]), int(m[2]), int(m[3])
        y += century if y < 100 else 0
        if 1 <= mo <= 12 and 1 <= d <= 31:
            return f"{y:04d}-{mo:02d}-{d:02d}"
    return t


@F.pandas_udf(T.StringType())
def vi_value_udf(s: pd.Series) -> pd.Series:
    return s.map(vi_value, na_action="ignore")


def strict_key(c: Column) -> Column:
    """Compare key of the strict kind: NFC only."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_nfc_only(c))


# Words for truth values.
TRUTH = {"true": ("true", "yes", "có", "đúng"), "false": ("false", "no", "không", "sai")}


def normalized_key(c: Column) -> Column:
    """Compare key of the normalized kind (STR-25): NFC, white space squeezed, case folded; truth values, numbers and
    dates with a day, month and year in one spelling each."""
    t = query_key(c, "NFC")
    number = F.regexp_replace(t, ",", ".").cast("double")
    day = F.regexp_extract(t, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 1)
    date = F.format_string("%s-%s-%s", F.regexp_extract(t, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 3), F.lpad(F.regexp_extract(t, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 2), 2, "0"), F.lpad(day, 2, "0"))
    truth = [F.when(t.isin(*words), F.lit(k)) for k, words in TRUTH.items()]
    return F.coalesce(*truth, F.when(t.rlike(r"^-?\d{1,15}([.,]\d{1,6})?$"), F.call_function("format_number", number, F.lit("0.######"))), F.when(day != "", date), t)


@F.pandas_udf(T.StringType())
def _nfc_only(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def error_class(gold: Column, predicted: Column, query: Column) -> Column:
    """Null if equal; I: missing; P: one contains the other; T: gold is not in the query as it is; W: it is, but the
    prediction is another (STR-26)."""
    return (
        F.when(gold.eqNullSafe(predicted), None)
        .when(predicted.isNull() | (predicted == ""), "I")
        .when(F.contains(gold, predicted) | F.contains(predicted, gold), "P")
        .when(~F.contains(query, gold), "T")
        .otherwise("W")
    )
