"""Deeply nested records as flat, linked tables (problem 6).

tools, parameters, calls and arguments become tables in which every row names its parent. JSON text is read through the
structural index of ``functions.jsonindex``; a text that repeats within a batch, or was met before by the same worker,
is indexed once.

Cases: null or empty arrays, null or blank JSON and JSON that is not strict give no rows; a text that was encoded twice
is decoded; a repeated member name gives one row, its first place in arguments, but a name with a dot and a nested one are two; a JSON Schema is told by its top-level "type": "object", every other
object is the flat form, in which each top-level key is a parameter. Columns besides rid, tools and function_calls are
ignored.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.jsonindex import index, unwrap

_KEPT = 20_000  # texts whose rows a worker keeps
PATHS = "kind string, rid long, pos int, parent_path string, path string"


def _text_is(ix, i: int, word: bytes) -> bool:
    s = int(ix.start[i])
    return ix.data[s : s + len(word) + 2] == b'"' + word + b'"'


class _Bases:
    """The path under which the members of a value lie, built only where a member is met: elements of arrays within
    arrays have none of their own, so a deep text costs no more than the paths that it gives."""

    def __init__(self, ix, step):
        self.ix, self.step, self.known = ix, step, {}

    def of(self, i: int) -> str:
        tail, at = [], i
        while at >= 0 and at not in self.known and self.ix.name[at] is None:
            tail.append(at)
            at = self.parent[at]
        out = (self.known.get(at, "") if at >= 0 else "") + "".join(self.step(x) for x in reversed(tail))
        self.known[i] = out
        return out

    @property
    def parent(self) -> list[int]:
        if "_parent" not in self.__dict__:
            self._parent = self.ix.parent.tolist()
        return self._parent


@dataclass
class Param:
    """A parameter: its place in the index, the schema that declares it, and whether that is the flat form."""

    at: int
    schema: int
    flat: bool
    up: str
    path: str


def params(ix) -> list[Param]:
    """The parameters of all schema texts of an index, in text order; a repeated name counts once."""
    # roles: 1 schema, 2 its properties, 3 flat root, 4 an array of schemas under "items", 0 nothing
    role, base = np.zeros(len(ix.parent), np.int8), [("", 0)] * len(ix.parent)  # path of the parameter, arrays below it
    holder = [-1] * len(ix.parent)
    schema_roots = {int(ix.parent[i]) for i in np.flatnonzero(ix.depth == 1).tolist() if ix.name[i] == "type" and _text_is(ix, i, b"object")}
    parent, text, kind, name = ix.parent.tolist(), ix.text.tolist(), ix.kind.tolist(), ix.name
    out: list[Param] = []
    met: set[tuple[int, str, str]] = set()
    for i, p in enumerate(parent):  # values are in text order, so a parent comes before what it holds
        obj = kind[i] == 123
        if p < 0:
            role[i] = (1 if i in schema_roots else 3) if obj else 0
            continue
        r = role[p]
        if r == 0:
            continue
        if r == 4:
            if obj:
                role[i], base[i] = 1, base[p]
        elif r == 1 and name[i] is not None:
            if name[i] == "properties" and obj:
                role[i], base[i], holder[i] = 2, base[p], p
            elif name[i] == "items" and base[p][0]:  # a whole text has no array of its own
                role[i], base[i] = (1 if obj else 4 if kind[i] == 91 else 0), (base[p][0], base[p][1] + 1)
        elif r in (2, 3) and name[i] is not None:
            up = base[p][0] + "[]" * base[p][1]
            path = f"{up}.{name[i]}" if up else name[i]
            base[i], role[i] = (path, 0), 1 if obj else 0
            if (text[i], up, path) not in met:
                met.add((text[i], up, path))
                out.append(Param(i, p if r == 3 else holder[p], r == 3, up, path))
    return out


def param_paths(texts: list[str]) -> list[list[tuple[str, str]]]:
    """(parent_path, path) of each parameter of each schema text."""
    ix = index(texts)
    out: list[list[tuple[str, str]]] = [[] for _ in texts]
    for x in params(ix):
        out[int(ix.text[x.at])].append((x.up, x.path))
    return out


def arg_paths(texts: list[str]) -> list[list[tuple[str, str]]]:
    """(parent_path, path) of each key of each arguments text."""
    ix = index(texts)
    out: list[dict[tuple[str, str], None]] = [{} for _ in texts]
    base = _Bases(ix, lambda i: f"[{pos[i]}]" if pos[i] >= 0 else "")
    text, pos, name = ix.text.tolist(), ix.pos.tolist(), ix.name
    for i, p in enumerate(ix.parent.tolist()):
        if name[i] is not None:
            up = base.of(p)
            base.known[i] = f"{up}.{name[i]}" if up else name[i]
            out[text[i]][up, base.known[i]] = None
    return [list(o) for o in out]


_KINDS = {123: "object", 91: "array", 34: "string", 116: "boolean", 102: "boolean", 110: "null"}


def _scalar(ix, i: int) -> str | None:
    """The text of a string, the JSON text of a number or truth value, null for null and for what holds other values."""
    k = int(ix.kind[i])
    if k in (123, 91, 110):
        return None
    return json.loads(ix.raw(i)) if k == 34 else ix.raw(i)


def _compact(ix, i: int) -> str:
    """The JSON text of value i without white space between its parts."""
    if int(ix.kind[i]) not in (123, 91, 34):
        return ix.raw(i)
    try:
        return json.dumps(json.loads(ix.raw(i)), ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return ix.raw(i)


def arg_values(texts: list[str]) -> list[list[tuple]]:
    """(parent_path, path, name, at, type, value) of each key and each array element of each arguments text; at is the
    place of an element in its array."""
    ix = index(texts)
    out: list[list[tuple]] = [[] for _ in texts]
    base = _Bases(ix, lambda i: f"[{pos[i]}]" if pos[i] >= 0 else "")
    met: set[tuple] = set()
    text, pos, name = ix.text.tolist(), ix.pos.tolist(), ix.name
    for i, p in enumerate(ix.parent.tolist()):
        if p < 0:
            continue
        up = base.of(p)
        path = (f"{up}.{name[i]}" if up else name[i]) if name[i] is not None else f"{up}[{pos[i]}]"
        base.known[i] = path
        if (text[i], up, path) not in met:
            met.add((text[i], up, path))
            out[text[i]].append((up, path, name[i], pos[i] if pos[i] >= 0 else None, _KINDS.get(int(ix.kind[i]), "number"), _scalar(ix, i)))
    return out


def param_values(texts: list[str]) -> list[list[tuple]]:
    """(parent_path, path, name, type, required, default, description, enum) of each parameter. type is as
    written, default and enum are JSON text without white space between parts; a JSON Schema requires what it lists, the flat form what neither its
    type calls optional nor has a default."""
    ix = index(texts)
    out: list[list[tuple]] = [[] for _ in texts]
    under: dict[int, dict[str, int]] = {}
    listed: dict[int, set[str]] = {}
    parent, name = ix.parent.tolist(), ix.name
    found = params(ix)
    wanted = {x.at for x in found} | {x.schema for x in found}
    for i, p in enumerate(parent):
        if p in wanted and name[i] is not None:
            under.setdefault(p, {}).setdefault(name[i], i)
    lists = {m["required"]: s for s, m in under.items() if "required" in m}
    for i, p in enumerate(parent):
        if p in lists and ix.kind[i] == 34:
            listed.setdefault(lists[p], set()).add(_scalar(ix, i))
    for x in found:
        m = under.get(x.at, {})
        text = lambda k: _scalar(ix, m[k]) if k in m and ix.kind[m[k]] == 34 else None  # noqa: B023, E731
        raw = lambda k: _compact(ix, m[k]) if k in m else None  # noqa: B023, E731
        kind = text("type") if text("type") is not None else raw("type")
        need = not ("default" in m or re.search(r",\s*optional\s*$", kind or "", re.I)) if x.flat else name[x.at] in listed.get(x.schema, ())
        out[int(ix.text[x.at])].append((x.up, x.path, name[x.at], kind, need, raw("default"), text("description"), raw("enum")))
    return out


def _rows(kind: str, paths, kept: OrderedDict, rid: np.ndarray, pos: np.ndarray, text: pa.Array) -> pa.RecordBatch:
    d = text.dictionary_encode()
    uniq = d.dictionary.to_pylist()
    new = [(t, u) for t in uniq if t not in kept and (u := unwrap(t)) is not None]
    for (t, _), rows in zip(new, paths([u for _, u in new]) if new else []):
        kept[t] = rows
    found = [kept.get(t, ()) for t in uniq]
    for t in uniq:
        if t in kept:
            kept.move_to_end(t)
    while len(kept) > _KEPT:
        kept.popitem(last=False)
    size = np.array([len(f) for f in found], np.int64)
    first = np.r_[0, np.cumsum(size)]
    code = d.indices.to_numpy(zero_copy_only=False)
    per = size[code] if len(code) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(code)), per)
    off = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    take = pa.array(first[code[row]] + off)
    up = pa.array([a for f in found for a, _ in f], pa.string())
    path = pa.array([b for f in found for _, b in f], pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.string()).take(pa.array(np.zeros(len(row), np.int64))), pa.array(rid[row], pa.int64()), pa.array(pos[row], pa.int32()), up.take(take), path.take(take)],
        names=["kind", "rid", "pos", "parent_path", "path"],
    )


def _linked(kind: str, paths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict = OrderedDict()
        for b in batches:
            for i in range(0, b.num_rows, 4000):
                s = b.slice(i, 4000)
                yield _rows(kind, paths, kept, s.column("rid").to_numpy(zero_copy_only=False), s.column("pos").to_numpy(zero_copy_only=False), s.column("text"))

    return run


def linked_paths(records: DataFrame) -> DataFrame:
    """(kind, rid, pos, parent_path, path) of every parameter and argument."""
    p = records.select("rid", F.posexplode("tools").alias("pos", "x")).select("rid", "pos", F.col("x.parameters").alias("text")).where("text is not null and rid is not null")
    a = records.select("rid", F.posexplode("function_calls").alias("pos", "x")).select("rid", "pos", F.col("x.arguments").alias("text")).where("text is not null and rid is not null")
    return p.mapInArrow(_linked("param", param_paths), PATHS).union(a.mapInArrow(_linked("arg", arg_paths), PATHS))


ARGS = "rid long, pos int, parent_path string, path string, name string, at int, type string, value string"
PARAMS = "rid long, pos int, parent_path string, path string, name string, type string, required boolean, default string, description string, enum string"


def _valued(values, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict = OrderedDict()
        for big in batches:
            for i in range(0, big.num_rows, 4000):
                b = big.slice(i, 4000)
                texts = b.column("text").to_pylist()
                new = [(t, u) for t in dict.fromkeys(texts) if t not in kept and (u := unwrap(t)) is not None]
                for (t, _), rows in zip(new, values([u for _, u in new]) if new else []):
                    kept[t] = rows
                out = [(r, p, *x) for r, p, t in zip(b.column("rid").to_pylist(), b.column("pos").to_pylist(), texts) for x in kept.get(t, ())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)
                while len(kept) > _KEPT:
                    kept.popitem(last=False)

    return run


def _texts(records: DataFrame, field: str, text: str) -> DataFrame:
    return records.where("rid is not null").select("rid", F.posexplode(field).alias("pos", "x")).select("rid", "pos", F.col(f"x.{text}").alias("text")).where("text is not null")


def argument_rows(records: DataFrame) -> DataFrame:
    """(rid, pos, parent_path, path, name, at, type, value): one row for each key and each array element of the decoded
    arguments of the call at place pos; its parent is the row of parent_path, or the call (rid, pos) at the top."""
    schema = pa.schema([("rid", pa.int64()), ("pos", pa.int32()), ("parent_path", pa.string()), ("path", pa.string()), ("name", pa.string()), ("at", pa.int32()), ("type", pa.string()), ("value", pa.string())])
    return _texts(records, "function_calls", "arguments").mapInArrow(_valued(arg_values, schema), ARGS)


def parameter_rows(records: DataFrame) -> DataFrame:
    """(rid, pos, parent_path, path, name, type, required, default, description, enum): one row for each parameter of the
    tool at place pos; its parent is the row of parent_path (without its "[]"), or the tool (rid, pos) at the top."""
    text = ("parent_path", "path", "name", "type", "required", "default", "description", "enum")
    schema = pa.schema([("rid", pa.int64()), ("pos", pa.int32()), *((c, pa.bool_() if c == "required" else pa.string()) for c in text)])
    return _texts(records, "tools", "parameters").mapInArrow(_valued(param_values, schema), PARAMS)


def tool_rows(records: DataFrame) -> DataFrame:
    """(rid, pos, name, description, feature_group): one row for each tool; its parent is the record rid."""
    return records.select("rid", F.posexplode("tools").alias("pos", "x")).select("rid", "pos", "x.name", "x.description", "x.feature_group")


def call_rows(records: DataFrame) -> DataFrame:
    """(rid, pos, name): one row for each call; its parent is the record rid."""
    return records.select("rid", F.posexplode("function_calls").alias("pos", "x")).select("rid", "pos", "x.name")
