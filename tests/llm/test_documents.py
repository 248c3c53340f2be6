"""Packing (problem 8), leaks (problem 9) and shared spans (problem 10) against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import bounded, leaks, packing, sharedspans
from corvane.llm.textform import words
from tests.fixtures import documents, items, rows

# ---- packing ----------------------------------------------------------------------------------------------------------


def test_fullest_like_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(4)}
        room = rnd.randint(0, 30)
        take = packing.fullest(sorted(counts, reverse=True), counts, room)
        sums = {0}
        for w, n in counts.items():
            sums = {s + w * k for s in sums for k in range(n + 1)}
        assert sum(w * k for w, k in take.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[w] for w, k in take.items())


def test_plan_holds_every_item():
    rnd = random.Random(1)
    h = {}
    for _ in range(5000):
        w = min(2048, max(1, int(rnd.lognormvariate(5.6, 0.8))))
        h[w] = h.get(w, 0) + 1
    plan = packing.minimum_slack(h)
    got = {}
    for take, times in plan:
        assert sum(w * k for w, k in take.items()) <= 2048
        for w, k in take.items():
            got[w] = got.get(w, 0) + k * times
    assert got == h
    assert sum(t for _, t in plan) <= -(-sum(w * n for w, n in h.items()) // 2048) + 2
    assert packing.minimum_slack({}) == []


@pytest.mark.parametrize("ranked", [200_000, 5])
def test_pack(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(rnd.choice([1, 5, 200, 900, 900, 6000]))) for _ in range(40)]
    d = documents(spark, [{"doc_id": i, "text": t} for i, t in enumerate(texts)] + [{"doc_id": 100, "text": None}, {"doc_id": 101, "text": ""}, {"doc_id": None, "text": "x"}, {"doc_id": 0, "text": texts[0]}, {"doc_id": 102, "text": "<|endoftext|>"}])
    got = packing.pack(d).collect()
    enc = packing.encoder(packing.TOKENIZER)
    want = {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    want[0] *= 2
    want[102] = len(enc.encode_ordinary("<|endoftext|>"))
    size, load = {}, {}
    for r in got:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
        load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        assert r["n_tokens"] == 2048 or r["part"] == max(x["part"] for x in got if x["doc_id"] == r["doc_id"])
    assert size == want and max(load.values()) <= 2048
    assert len(load) <= -(-sum(want.values()) // 2048) + 1
    assert sorted(load) == list(range(len(load)))


def test_pack_empty(spark):
    assert packing.pack(documents(spark, [])).count() == 0 and packing.containers(documents(spark, [{"doc_id": 1}])).count() == 0


# ---- leaks ------------------------------------------------------------------------------------------------------------


def test_suffix_array_and_index():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        t = np.r_[rnd.integers(1, 4, n), 0]
        fm = leaks.FMIndex(t)
        s = (t + 1).tolist() + [0]
        assert leaks.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for m in (1, 2, 3):
            ph = rnd.integers(1, 6, (20, m))
            lo, hi = fm.search(ph)
            for p, x, y in zip(ph.tolist(), lo, hi):
                at = [i for i in range(n - m + 1) if t[i : i + m].tolist() == p]
                assert y - x == len(at)
                assert sorted(fm.locate(np.arange(x, y)).tolist()) == at


def test_wavelet():
    rnd = np.random.default_rng(3)
    seq = rnd.integers(0, 9, 100)
    w = leaks.Wavelet(seq, 8)
    at = rnd.integers(0, 101, 60)
    sym = rnd.integers(0, 9, 60)
    assert w.rank(sym, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(sym, at)]
    s, r = w.access(np.arange(100))
    assert s.tolist() == seq.tolist() and r.tolist() == [int((seq[:i] == seq[i]).sum()) for i in range(100)]


def brute9(docs, its):
    out = set()
    for i, t in its:
        w = words(t)
        g = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for d, u in docs:
            v = words(u)
            if any(tuple(v[k : k + 12]) in g for k in range(len(v) - 11)):
                out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("block", [20_000, 7])
def test_leaks_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK", block)
    monkeypatch.setattr(leaks, "BLOCK_POINTS", block * 40)
    monkeypatch.setattr(leaks, "SHARD_POINTS", 3000)
    rnd = random.Random(5)
    voc = [f"w{i}" for i in range(12)]
    its = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.choice([5, 12, 30])))) for i in range(20)] + [(50, None), (51, "")]
    docs = []
    for d in range(60):
        w = [rnd.choice(voc + ["other", "words"]) for _ in range(40)]
        if d % 3 == 0:
            src = words(rnd.choice(its)[1])
            k = rnd.choice([11, 12, 20])
            w[10:10] = src[:k]
        docs.append((d, rnd.choice([" ".join(w), ", ".join(w).upper(), " ".join(w).replace("w1", "w​1")])))
    docs += [(90, None), (91, ""), (92, its[0][1]), (92, its[0][1]), (93, "pad " * 30_000 + its[2][1])]
    d, it = documents(spark, [{"doc_id": a, "text": t} for a, t in docs]), items(spark, [{"item_id": a, "text": t} for a, t in its])
    want = brute9(docs, its)
    assert want and rows(leaks.leaks(d, it)) == want
    spans = leaks.removal_spans(d, it).collect()
    assert {s["doc_id"] for s in spans} == {x for x, _ in want} and all(s["end_word"] - s["start_word"] >= 12 for s in spans)


def test_leaks_empty(spark):
    one = documents(spark, [{"doc_id": 1, "text": "a b c"}])
    assert leaks.leaks(one, items(spark, [])).count() == 0 and leaks.leaks(documents(spark, []), items(spark, [{"item_id": 1, "text": "a " * 20}])).count() == 0


# ---- shared spans -----------------------------------------------------------------------------------------------------


def brute10(docs, span=400):
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            seen.setdefault(t[i : i + span], set()).add(d)
    out = set()
    for d, t in docs:
        run = None
        for i in range(len(t or "") - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + span
                else:
                    if run:
                        out.add((d, *run))
                    run = [i, i + span]
        if run:
            out.add((d, *run))
    return sorted(out)


def texts(seed, alphabet="abcdefghij k\n é😀"):
    rnd = random.Random(seed)
    rand = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    parts = [rand(n) for n in (400, 401, 399, 450, 560, 700, 1500, 900)]
    docs = []
    for d in range(24):
        t = rand(rnd.randint(0, 500))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(parts)
            a, b = (0, len(p)) if rnd.random() < 0.5 else sorted(rnd.sample(range(len(p)), 2))
            t += p[a:b] + rand(rnd.choice([0, 1, 30, 300]))
        docs.append((d, t))
    docs += [(30, docs[0][1]), (31, docs[3][1]), (32, None), (33, ""), (34, "x" * 2000), (35, "x" * 450), (36, "ab" * 700), (37, "y" * 3000), (38, parts[6] + "z" + parts[6]), (38, "other"), (39, "q" * 399), (40, "q" * 399)]
    return docs


@pytest.mark.parametrize(("seed", "few"), [(1, 200_000), (2, 0), (3, 200_000)])
def test_spans_like_brute_force(spark, monkeypatch, seed, few):
    monkeypatch.setattr(bounded, "BROADCAST_BYTES", few)
    docs = texts(seed)
    d = documents(spark, [{"doc_id": a, "text": t} for a, t in docs])
    got = rows(sharedspans.shared_runs(d))
    assert got == [x for x in brute10(docs)]
    n = {r["doc_id"]: r["n_shared"] for r in sharedspans.shared_share(d).collect()}
    assert n[32] == 0 and n[30] == sum(e - s for x, s, e in got if x == 30)


def test_chunks_survive_insertions():
    rnd = random.Random(9)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    b = a[:2500] + "inserted" + a[2500:]
    _, s1, e1, d1, _, _ = sharedspans.chunks([a])
    _, s2, e2, d2, _, _ = sharedspans.chunks([b])
    assert len(set(d1.tolist()) & set(d2.tolist())) >= len(d1) - 4
    assert (e1 - s1).max() <= sharedspans.WINDOW and (s1[1:] == e1[:-1]).all()


def test_chunks_do_not_depend_on_neighbours():
    rnd = random.Random(4)
    t = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (400, 900, 2000, 5000)]
    owner, s, e, d, _, begin = sharedspans.chunks(t)
    for k, x in enumerate(t):
        o1, s1, e1, d1, _, _ = sharedspans.chunks([x])
        assert d1.tolist() == d[owner == k].tolist() and (s1 + begin[k]).tolist() == s[owner == k].tolist()


def test_spans_empty(spark):
    assert sharedspans.shared_runs(documents(spark, [])).count() == 0 and sharedspans.shared_share(documents(spark, [{"doc_id": 1}])).collect()[0]["share"] == 0


def test_measured_bytes(spark):
    df = spark.createDataFrame([(1, "é" * 100, [1, 2], ["ab", None]), (None, None, None, None)], "a long, b string, c array<int>, d array<string>")
    assert 300 < bounded.measured_bytes(df) < 600
    assert bounded.measured_bytes(df.limit(0)) == 0


def test_shards_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(leaks, "SHARD", 3)
    monkeypatch.setattr(leaks, "SHARD_POINTS", 10)
    assert list(leaks._shards(pa.array(["a", "b", "c", "d", None, "x" * 30, "y", "z" * 9]))) == [(0, 3), (3, 2), (5, 1), (6, 2)]
    assert list(leaks._shards(pa.array([], pa.string()))) == []
