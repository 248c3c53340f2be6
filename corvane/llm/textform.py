"""The consistent form of a text, its words, and the Arrow functions over them.

Consistent form: accents composed (NFC); ASCII instead of full-width forms; no invisible characters; U+0020 instead of
every blank that is no line break; the letters of a word in one script, and a word of a Latin-script sentence in Latin
letters. Case and the number of blanks stay. Null stays null, '' stays ''. Text of any length is handled whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters of Cyrillic and Greek and the Latin letters they resemble.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXaeopcyxsijhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυ", "ABEZHIKMNOPTYXoavipu"))
TO_LATIN = {**CYRILLIC, **GREEK}
TO_CYRILLIC = dict(zip("ABEKMHOPCTYXaeopcyx", "АВЕКМНОРСТУХаеорсух"))
GREEK_TO_CYRILLIC = {g: TO_CYRILLIC[x] for g, x in GREEK.items() if x in TO_CYRILLIC}

# Code point ranges, both ends included.
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
CONTROL = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F)]
BLANK = [(0x09, 0x09), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
FULL_WIDTH = [(0xFF01, 0xFF5E)]
_NONLATIN = re.compile("[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
_PLAIN = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in INVISIBLE + CONTROL + BLANK + FULL_WIDTH) + "]")
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]")
_SENTENCE = re.compile(r"[^.!?…\n\r]+")
_WORD = re.compile(r"[^\W_]+")
# Blocks that common text is written in; what lies outside them always counts as suspect.
_COMMON = [(0x20, 0x7E), (0x0A, 0x0D), (0xA1, 0x24F), (0x1E00, 0x1EFF), (0x2010, 0x205E), (0x20A0, 0x20BF), (0x2190, 0x21FF), (0x3001, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1FAFF)]


def _own_form(c: int) -> bool:
    """Whether a code point stays as it is, whatever stands beside it: not in the tables, stable under NFC, of no script
    that has look-alikes."""
    x = chr(c)
    return not (_PLAIN.match(x) or _NONLATIN.match(x) or unicodedata.combining(x) or unicodedata.category(x)[0] in "MC" or not unicodedata.is_normalized("NFC", x))


def _suspect() -> str:
    ranges: list[list[int]] = []
    for c in (c for a, b in _COMMON for c in range(a, b + 1)):
        if c in (0x0A, 0x0D) or _own_form(c):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges if b - a > 3 or b < 0x100) + "]"


#: Java pattern of every text whose consistent form may differ from it; texts without a match are their own form.
SUSPECT = _suspect()


_TABLE: dict[int, int | None] = {c: None for a, b in INVISIBLE + CONTROL for c in range(a, b + 1)}
_TABLE |= {c: 0x20 for a, b in BLANK for c in range(a, b + 1)} | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


def _word(w: str, latin_sentence: bool) -> str:
    other = [c for c in w if _NONLATIN.match(c)]
    if not other:
        return w
    latin = [c for c in w if _LATIN.match(c)]
    greek = [c for c in other if c not in CYRILLIC and not "\u0400" <= c <= "\u052f"]
    if all(c in TO_LATIN for c in other):
        if not latin and (not greek or len(greek) == len(other)):
            return "".join(TO_LATIN.get(c, c) for c in w) if latin_sentence else w
        if not latin_sentence and len(greek) < len(other) and all(c in TO_CYRILLIC for c in latin) and all(c in GREEK_TO_CYRILLIC for c in greek):
            return "".join(TO_CYRILLIC.get(c) or GREEK_TO_CYRILLIC.get(c, c) for c in w)
        return "".join(TO_LATIN.get(c, c) for c in w)
    if len(greek) < len(other) and (latin or greek) and all(c in TO_CYRILLIC for c in latin) and all(c in GREEK_TO_CYRILLIC for c in greek):
        return "".join(TO_CYRILLIC.get(c) or GREEK_TO_CYRILLIC.get(c, c) for c in w)
    return w


def _scripts(s: str) -> str:
    def sentence(m: re.Match) -> str:
        t = m.group()
        other = _NONLATIN.findall(t)
        if not other:
            return t
        latin = bool(_LATIN.search(t)) and all(c in TO_LATIN for c in other)
        return _WORD.sub(lambda x: _word(x.group(), latin), t)

    return _SENTENCE.sub(sentence, s)


def consistent(s: str | None) -> str | None:
    """The consistent form of s."""
    if s is None or s.isascii() and not _PLAIN.search(s):
        return s
    if _PLAIN.search(s):
        s = s.translate(_TABLE)
    if not unicodedata.is_normalized("NFC", s):
        s = unicodedata.normalize("NFC", s)
    if _NONLATIN.search(s):
        t = _scripts(s) if _LATIN.search(s) else _WORD.sub(lambda x: _word(x.group(), False), s)
        if t != s:  # a mark after a letter that was replaced may compose with the new one
            s = unicodedata.normalize("NFC", t)
    return s


def words(s: str | None) -> list[str]:
    """Maximal runs of letters and digits in the lower-cased consistent form; [] for null."""
    return _WORD.findall(consistent(s).lower()) if s else []


def strict_json(text: str):
    """Strict JSON: no NaN or Infinity. ValueError otherwise."""

    def bad(x: str):
        raise ValueError(x)

    return json.loads(text, parse_constant=bad)


def decoded(text: str | None):
    """The value of JSON text that may be encoded once more as a JSON string; None if it can't be read."""
    if not text:
        return None
    try:
        v = strict_json(text)
        return strict_json(v) if isinstance(v, str) else v
    except (ValueError, RecursionError):
        return None


def strings(v) -> list[str]:
    """All string values (not keys) in a decoded JSON value, in order."""
    out, stack = [], [v]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return out


@F.pandas_udf(T.StringType())
def consistent_udf(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_udf(s: pd.Series) -> pd.Series:
    return s.map(words)


_FORM = T.StructType([T.StructField("words", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("b0", T.LongType()), T.StructField("b1", T.LongType())])


def _word_rows(texts: pd.Series, ordered: bool) -> pd.DataFrame:
    bit: dict[str, int] = {}
    rows = []
    for t in texts:
        ws = words(t)
        own = set(ws)
        m = 0
        for w in own:
            k = bit.get(w)
            if k is None:
                k = bit[w] = 1 << xxhash.xxh32_intdigest(w) % 128
            m ^= k
        rows.append((" ".join(ws if ordered else sorted(own)), len(own), (m & (1 << 64) - 1) - (m >> 63 & 1) * (1 << 64), (m >> 64) - (m >> 127) * (1 << 64)))
    return pd.DataFrame(rows, columns=["words", "n", "b0", "b1"])


@F.pandas_udf(_FORM)
def word_line_udf(s: pd.Series) -> pd.DataFrame:
    """The words joined by single spaces, the number n of distinct ones, and their parity bitmap of 128 bits."""
    return _word_rows(s, True)


@F.pandas_udf(_FORM)
def word_set_udf(s: pd.Series) -> pd.DataFrame:
    """The distinct words, sorted and joined by single spaces, their number n, and their parity bitmap of 128 bits."""
    return _word_rows(s, False)


def may_reach(similarity: float, n: tuple[Column, Column], *bits: tuple[Column, Column]) -> Column:
    """False only for pairs below the similarity: two sets whose parity bitmaps differ in x bits differ in at least x
    words, so they have at most (n + n' - x) / 2 words in common. Any part of the bitmaps will do."""
    x = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in bits), F.lit(0))
    return (n[0] + n[1] - x) * (1 + similarity) >= 2 * similarity * (n[0] + n[1]) - 1e-6
