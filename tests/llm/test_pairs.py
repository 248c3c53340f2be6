"""Near copies (problem 5), cross-split overlaps (problem 3) and group splits (problem 7) against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import crosssplit, nearcopies, splits
from corvane.llm.textform import words
from tests.fixtures import ordered, records, rows, tool


def clean(s):
    return (s or "").strip().lower()


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def made(seed, n=140):
    rnd = random.Random(seed)
    names = ["".join(rnd.choice("bdfgklmnrst") + rnd.choice("aeio") for _ in range(3)) for _ in range(150)]
    base = [" ".join(rnd.sample(names, 16)) + " for the table at" for _ in range(25)]
    out = []
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 5)):
            k = rnd.randrange(len(w))
            kind = rnd.randrange(3)
            if kind == 0:
                w[k] = rnd.choice(names)
            elif kind == 1:
                w.insert(k, rnd.choice(names))
            else:
                w = w[k:] + w[:k]
        q = " ".join(w)
        q = rnd.choice([q, q.upper(), q.replace(" ", "  "), q.replace("a", "а", 1), q])
        own = rnd.sample(["t1", "T2 ", "t3", "t4"], rnd.randint(0, 3))
        calls = rnd.choice([None, [], [("F", "{}")], [("f ", "{}")], [("f", "{}"), ("g", "{}")], [(" ", "{}")]])
        out.append({"rid": i, "id": rnd.choice([f"x_{i % 40}", None]), "source": rnd.choice(["a", "b", None]), "split": rnd.choice(["train", "train", "val", "test", None]), "query": rnd.choice([q, q, q, None, " "]) if i % 9 == 0 else q, "tools": rnd.choice([[tool(t) for t in own], None]) if i % 11 == 0 else [tool(t) for t in own], "function_calls": calls})
    return out


def brute5(data):
    w, t = [set(words(x["query"])) for x in data], [{clean(y[0]) for y in x["tools"] or []} for x in data]
    return sorted((data[i]["rid"], data[j]["rid"]) for i in range(len(data)) for j in range(i + 1, len(data)) if jac(w[i], w[j]) >= 0.75 and jac(t[i], t[j]) >= 0.5)


def brute3(data):
    side = {"train": "t", "val": "e", "test": "e"}
    w = [set(words(x["query"])) for x in data]
    c = [[clean(y[0]) for y in x["function_calls"] or [] if clean(y[0])] for x in data]
    out = []
    for i, x in enumerate(data):
        for j in range(i + 1, len(data)):
            y = data[j]
            if {side.get(x["split"]), side.get(y["split"])} == {"t", "e"} and (x["id"] is not None and x["id"] == y["id"] or jac(w[i], w[j]) >= 0.75 and c[i] == c[j]):
                out.append((x["rid"], y["rid"]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_like_brute_force(spark, seed):
    data = made(seed)
    got = rows(nearcopies.pairs(records(spark, data)))
    want = brute5(data)
    assert want and set(got) <= set(want) and len(got) == len(set(got)) and len(got) >= 0.999 * len(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_cross_split_pairs_like_brute_force(spark, seed):
    data = made(seed)
    want = brute3(data)
    assert want and rows(crosssplit.pairs(records(spark, data))) == want


def test_groups_of_near_copies(spark):
    q = "one two three four five six seven eight nine ten eleven twelve"
    data = [{"rid": i, "query": q + x, "tools": [tool("t")]} for i, x in enumerate(["", "", " thirteen", " thirteen fourteen", " a b c d e f g h"])] + [{"rid": 9, "query": q, "tools": [tool("u")]}]
    got = {r["rid"]: (r["cid"], r["grp"], r["n_links"]) for r in nearcopies.near_groups(records(spark, data)).collect()}
    assert got[0] == got[1] == (0, 0, 2) and got[2][:2] == (2, 0) and got[3][1] == 0 and got[4] == (4, 4, 0) and got[9] == (9, 9, 0)


def test_signatures_do_not_depend_on_batches():
    circle = nearcopies._second_permutation()
    t = [" ".join(f"w{i}" for i in range(j, j + 20)) for j in range(300)] + [" ".join(f"v{i}" for i in range(200_000))]
    a = nearcopies.signatures(t, circle)
    assert (a[7] == nearcopies.signatures([t[7]], circle)[0]).all()
    assert (a[0] == a[1]).mean() > 0.75
    assert (a[-1] == nearcopies.signatures([t[-1]], circle)[0]).all()


def test_circulant_estimate_of_similarity():
    circle = nearcopies._second_permutation()
    rnd = random.Random(1)
    for share in (0.5, 0.75, 0.9):
        est = []
        for k in range(40):
            common = [f"c{k}x{i}" for i in range(int(40 * share))]
            rest = [f"r{k}x{rnd.random()}" for _ in range(40 - len(common))]
            s = nearcopies.signatures([" ".join(common), " ".join(common + rest)], circle)
            est.append((s[0] == s[1]).mean())
        assert abs(np.mean(est) - share) < 0.03


def test_seeds_are_lossless():
    rnd = random.Random(8)
    counts = np.random.default_rng(8).integers(0, 5, crosssplit.SKETCH).astype(np.int32)
    for _ in range(200):
        a = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(1, 40))]
        b = list(a)
        while True:
            c = b[:]
            rnd.shuffle(c) if rnd.random() < 0.5 else c.insert(rnd.randrange(len(c) + 1), f"n{rnd.random()}")
            if jac(set(a), set(c)) < 0.75 or len(c) > 60:
                break
            b = c
            if rnd.random() < 0.3:
                break
        offsets, h = crosssplit.select_seeds(pa.array([" ".join(a), "", " ".join(b)]), counts)
        x, y = set(h[: offsets[1]].tolist()), set(h[offsets[2] :].tolist())
        n = len(set(a))
        assert len(x) == n - -(-n * 3 // 4) + 1
        assert jac(set(a), set(b)) < 0.75 or x & y


def test_chains():
    a = "a b c d e f g h".split()
    assert crosssplit.chain_cover(a, a)[:2] == (1.0, 1.0)
    x, y, n = crosssplit.chain_cover(a, "e f g h a b c d".split())
    assert (x, y, n) == (0.5, 0.5, 4)
    assert crosssplit.chain_cover(a, ["z"]) == (0.0, 0.0, 0)
    long = [f"w{i}" for i in range(5000)]
    assert crosssplit.chain_cover(long, long[100:])[1] == 1.0


def test_report(spark):
    q = "one two three four five six seven eight"
    data = [{"rid": 1, "id": "a", "split": "train", "source": "s", "query": q}, {"rid": 2, "id": "b", "split": "val", "source": "s", "query": q + " nine"}, {"rid": 3, "id": "a", "split": "test", "source": "s", "query": "other words"}]
    assert rows(crosssplit.report(records(spark, data))) == [("test", "s", 1, 1, 0, None), ("val", "s", 1, 0, 1, 0.8889)]


def test_coverage_and_pair_counts(spark):
    q = "one two three four five six seven eight"
    data = [{"rid": i, "id": "a", "split": "train", "source": "s" if i < 3 else None, "query": q} for i in range(4)]
    data += [{"rid": 10, "id": "b", "split": "val", "source": "s", "query": q + " nine"}, {"rid": 11, "id": "a", "split": "val", "source": "s", "query": "other"}]
    r = records(spark, data)
    assert rows(crosssplit.coverage(r)) == [(10, "val", "s", 4, 0.8889)]
    assert rows(crosssplit.pair_counts(r)) == [("val", "s", "s", 1, 3, 3), ("val", "s", None, 1, 1, 1)]


def test_hot_keys_are_cut_into_blocks(spark, monkeypatch):
    from corvane.llm import hotkeys

    monkeypatch.setattr(hotkeys, "SIDE", 3)
    data = [(i, k, i % 3 == 0) for k in ("hot", "warm") for i in range(20 if k == "hot" else 2)] + [(99, "lone", True)]
    df = spark.createDataFrame(data, "rid long, key string, left boolean")
    got = rows(hotkeys.within(df, "key", "rid").select("a.key", "a.rid", "b.rid"))
    assert got == sorted((k, i, j) for k, n in (("hot", 20), ("warm", 2)) for i in range(n) for j in range(i + 1, n))
    got = rows(hotkeys.between(df, "left", "not left", "key", "rid").select("a.key", "a.rid", "b.rid"))
    assert got == sorted((k, i, j) for k, n in (("hot", 20), ("warm", 2)) for i in range(n) for j in range(n) if i % 3 == 0 and j % 3)


@pytest.mark.parametrize("f", [nearcopies.pairs, crosssplit.pairs, splits.groups, nearcopies.near_groups, crosssplit.coverage, crosssplit.pair_counts, crosssplit.report, splits.balanced_splits])
def test_empty_table(spark, f):
    assert f(records(spark, [])).count() == 0


def test_very_long_query(spark):
    q = " ".join(f"w{i}" for i in range(30_000))
    data = [{"rid": 1, "id": "a", "split": "train", "query": q, "tools": [tool("t")]}, {"rid": 2, "id": "b", "split": "test", "query": q + " end", "tools": [tool("t")]}]
    r = records(spark, data)
    assert rows(nearcopies.pairs(r)) == rows(crosssplit.pairs(r)) == [(1, 2)]


# ---- group splits -----------------------------------------------------------------------------------------------------


def test_group_tools_like_union_find(spark):
    data = made(6)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x in data:
        t = sorted({clean(y[0]) for y in x["tools"] or []} - {""})
        for y in t:
            a, b = find((str(x["source"]), t[0])), find((str(x["source"]), y))
            up[max(a, b)] = min(a, b)
    want = ordered(((x["rid"], x["source"], find((str(x["source"]), clean(x["tools"][0][0])))[1]) for x in data if x["tools"]))
    assert rows(splits.groups(records(spark, data))) == want


def test_group_tool_cases(spark):
    data = [{"rid": 1, "source": "s", "tools": [tool(" B\t"), tool(None), tool("  ")]}, {"rid": 2, "source": "s", "tools": [tool("b"), tool("C"), tool("a")]}, {"rid": 3, "source": None, "tools": [tool("c")]}, {"rid": 4, "source": "s", "tools": [tool(" ")]}, {"rid": 5, "source": "s"}]
    assert rows(splits.groups(records(spark, data))) == [(1, "s", "a"), (2, "s", "a"), (3, None, "c")]


@pytest.mark.parametrize("block", [4096, 120])
def test_balance_and_whole_groups(spark, block):
    rnd = random.Random(4)
    data = [{"rid": i, "source": "s", "tools": [tool(f"t{int(rnd.paretovariate(0.6)) % 400}")]} for i in range(3000)]
    got = splits.balanced_splits(records(spark, data), 30, block).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["group_tool"], set()).add(r["part"])
    assert len(got) == 3000 and all(len(p) == 1 for p in parts.values())
    n = {p: sum(r["part"] == p for r in got) for p in splits.SHARES}
    assert abs(n["test"] - 300) < 75 and abs(n["validation"] - 300) < 75


def test_few_groups_are_differenced_too(spark):
    weights = np.array([155, 136, 87, 84, 64, 61, 60, 54, 54, 47, 47, 45, *range(1, 24)], np.float64)
    loads = [weights[b].sum() for b in splits.differencing(weights, 10)]  # fewer bins than groups: extremes are combined
    assert max(loads) <= weights.max() and min(loads) >= 0.5 * weights.max()
    part, _ = splits.nearest_split(weights)
    got = {s: sum(w for w, p in zip(weights, part) if p == s) / weights.sum() for s in splits.SHARES}
    assert all(abs(got[s] - v) < 0.01 for s, v in splits.SHARES.items())
    data = [{"rid": i * 100 + j, "source": "s", "tools": [tool(f"t{i}")]} for i, w in enumerate(weights) for j in range(int(w) // 2)]
    n = {r["part"]: r["share"] for r in splits.split_shares(records(spark, data)).collect()}
    assert all(abs(n[s] - v) < 0.02 for s, v in splits.SHARES.items())


def test_differencing_is_balanced():
    w = np.random.default_rng(1).integers(1, 100, 500)
    bins = splits.differencing(w, 20)
    assert sorted(i for b in bins for i in b) == list(range(500))
    loads = [w[b].sum() for b in bins]
    assert max(loads) - min(loads) <= 2
    assert splits.differencing(np.array([], np.int64), 3) == [[], [], []]
