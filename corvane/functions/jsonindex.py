"""Vectorised structural index of JSON texts.

A batch of texts is one byte array. Bitmaps mark escaped bytes, quotes (their running parity tells what lies inside a
string) and brackets, colons and commas outside strings; a prefix sum over the brackets is the nesting depth. Member
names, values and array elements are then spans between those marks, and each value points to the value that holds it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np


@dataclass
class Index:
    """One entry per value. parent: index of the holding value, -1 for a whole text. name: member name, None for others.

    pos: place in an array or -1; kind: first byte of the value; text: which input text; depth: 0 for a whole text.
    start, end: byte span of the value in data."""

    parent: np.ndarray
    name: list[str | None]
    pos: np.ndarray
    kind: np.ndarray
    text: np.ndarray
    depth: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes

    def raw(self, i: int) -> str:
        """The JSON text of value i."""
        return self.data[int(self.start[i]) : int(self.end[i])].decode("utf-8", "surrogatepass")


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def strict_without_recursion(text: str) -> bool:
    """Strict JSON at any depth: a walk over tokens with a stack of open brackets."""
    stack: list[str] = []
    want = "value"  # value, first (of an array), key, first key, colon, next
    at = 0
    while m := _TOKEN.match(text, at):
        at = m.end()
        mark = m[1] or ""
        if want in ("value", "first") and mark in ("", "{", "["):
            if mark:
                stack.append(mark)
                want = "first key" if mark == "{" else "first"
            else:
                want = "next"
        elif want == "first" and mark == "]" or want == "first key" and mark == "}" or want == "next" and stack and mark == {"{": "}", "[": "]"}[stack[-1]]:
            stack.pop()
            want = "next"
        elif want in ("key", "first key") and m[2]:
            want = "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "next" and stack and mark == ",":
            want = "key" if stack[-1] == "{" else "value"
        else:
            return False
    return want == "next" and not stack and not text[at:].strip(" \t\n\r")


def _valid(text: str) -> bool:
    def bad(x: str):
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=bad, parse_int=float)  # float: digits without end are valid too
    except ValueError:
        return False
    except RecursionError:
        return strict_without_recursion(text)
    return True


def unwrap(text: str | None) -> str | None:
    """Strict JSON text of an object or array, taken out of a JSON string if it was encoded twice; None for all else."""
    if not text:
        return None
    t = text.strip(" \t\r\n")
    if t[:1] == '"':
        try:
            t = json.loads(t)
        except ValueError:
            return None
        t = t.strip(" \t\r\n")
    return t if t[:1] in ("{", "[") and _valid(t) else None


def index(texts: list[str]) -> Index:
    """The structural index of texts that ``unwrap`` let through."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts)
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    at = np.arange(n, dtype=np.int64)
    begin = np.zeros(len(parts), np.int64)
    np.cumsum([len(p) + 1 for p in parts[:-1]], out=begin[1:]) if len(parts) > 1 else None
    # bitmap of escaped bytes: an odd run of backslashes before them
    slash = b == 92
    if slash.any():
        last = np.maximum.accumulate(np.where(slash, -1, at))
        escaped = np.zeros(n, bool)
        escaped[1:] = ((at - last)[:-1] & 1).astype(bool) & slash[:-1]
    else:
        escaped = np.zeros(n, bool)
    quote = (b == 34) & ~escaped
    inside = (np.cumsum(quote, dtype=np.int64) & 1).astype(bool) | quote
    q = np.flatnonzero(quote)
    q_open, q_close = q[0::2], q[1::2]
    out = ~inside
    opens = ((b == 123) | (b == 91)) & out
    closes = ((b == 125) | (b == 93)) & out
    depth = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32), dtype=np.int64)
    o, colon, comma = np.flatnonzero(opens), np.flatnonzero((b == 58) & out), np.flatnonzero((b == 44) & out)
    solid = np.flatnonzero(~(out & ((b == 32) | (b == 9) | (b == 10) | (b == 13))))

    def after(p: np.ndarray) -> np.ndarray:
        """The first byte after p that is no white space."""
        return solid[np.minimum(np.searchsorted(solid, p + 1), len(solid) - 1)]

    # the container of each mark: the last bracket opened before it at its depth
    marks = np.concatenate([o, colon, comma])
    kinds = np.repeat(np.array([0, 1, 2]), [len(o), len(colon), len(comma)])
    order = np.lexsort((marks, depth[marks]))
    within = np.empty(len(marks), np.int64)
    if len(marks):
        within[order] = marks[order][np.maximum.accumulate(np.where(kinds[order] == 0, np.arange(len(marks)), 0))]
    in_colon, in_comma = within[len(o) : len(o) + len(colon)], within[len(o) + len(colon) :]
    # values: whole texts, members (after a colon), array elements (after '[' or a comma in an array)
    first = after(o)
    arr = o[(b[o] == 91) & (b[first] != 93)]
    sep = comma[b[in_comma] == 91] if len(comma) else comma
    sep_in = in_comma[b[in_comma] == 91] if len(comma) else in_comma
    start = np.concatenate([begin, after(colon), after(arr), after(sep)])
    hold = np.concatenate([np.full(len(begin), -1), in_colon, arr, sep_in]).astype(np.int64)
    member = np.full(len(start), -1, np.int64)
    member[len(begin) : len(begin) + len(colon)] = np.searchsorted(q_close, colon) - 1
    order = np.argsort(start, kind="stable")
    start, hold, member = start[order], hold[order], member[order]
    parent = np.where(hold < 0, -1, np.searchsorted(start, hold))
    text = np.searchsorted(begin, start, side="right") - 1
    is_el = (member < 0) & (parent >= 0)
    pos = np.full(len(start), -1, np.int64)
    e = np.flatnonzero(is_el)
    if len(e):
        by = e[np.argsort(parent[e], kind="stable")]
        p = parent[by]
        new = np.r_[True, p[1:] != p[:-1]]
        pos[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    level = depth[start] - opens[start]
    name: list[str | None] = [None] * len(start)
    mm = np.flatnonzero(member >= 0)
    lo, hi = q_open[member[mm]] + 1, q_close[member[mm]]
    for i, x, y in zip(mm.tolist(), lo.tolist(), hi.tolist()):
        s = data[x:y]
        name[i] = json.loads(b'"' + s + b'"') if b"\\" in s else s.decode("utf-8", "surrogatepass")
    return Index(parent, name, pos, b[start], text, level, start, _ends(b, start, opens, closes, depth, comma, q_open, q_close), data)


def _ends(b, start, opens, closes, depth, comma, q_open, q_close) -> np.ndarray:
    """The place after each value: its closing bracket or quote, else the next mark or blank."""
    end = np.zeros(len(start), np.int64)
    marks = np.flatnonzero(opens | closes)
    # within a level brackets open and close in turn
    order = np.lexsort((marks, depth[marks] + closes[marks]))
    first, last = marks[order][0::2], marks[order][1::2]
    by = np.argsort(first, kind="stable")
    first, last = first[by], last[by]
    kind = b[start]
    box, quoted = (kind == 123) | (kind == 91), kind == 34
    end[box] = last[np.searchsorted(first, start[box])] + 1
    end[quoted] = q_close[np.searchsorted(q_open, start[quoted])] + 1
    stop = np.unique(np.r_[np.flatnonzero(closes), comma, np.flatnonzero((b == 32) | (b == 9) | (b == 10) | (b == 13)), len(b)])
    bare = ~box & ~quoted
    end[bare] = stop[np.searchsorted(stop, start[bare])]
    return end
