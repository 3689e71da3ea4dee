import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import common, decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if owners := wins.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= owners
        out[d] = (len(w), len(hit), sorted(found))
    return out


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eps", "Été", "x1", "to", "to", "to"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 9, 10, 11, 30])))) for i in range(12)] + [(99, "to to to"), (100, None), (101, "--- !!")]
    docs = []
    for d in range(40):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            w = words(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(w)))
            parts[len(parts) // 2 : len(parts) // 2] = [x.upper() if x.isascii() else x for x in w[a : a + rng.randrange(5, 30)]]
        docs.append((d, ", ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("bits", "keys"), [(27, 500_000), (5, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, bits, keys):
    """Also with a bitmap that lets nearly everything through, and with the shuffled join."""
    monkeypatch.setattr(common, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", keys)
    docs, items = fixture(seed)
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == brute(docs, items)
    kept = decontaminate.keep_clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, hit, _) in brute(docs, items).items() if not hit}


def test_driver_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i: (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0) for i, (n, hit, found) in brute(docs, items).items()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op8_decontaminate(spark, d).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_bitmap(spark):
    rng = random.Random(1)
    h = [rng.randrange(-(2**63), 2**63) for _ in range(500)]
    bits, data = common.bitmap(spark.createDataFrame([(x,) for x in h], "h long"), len(h))
    look = common.Bitmap(bits, data)
    own = np.array(h, dtype=np.int64).view(np.uint64)
    assert look(own).all() and look(np.arange(10**6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.05


def test_many_items_are_no_block(spark):
    """A benchmark of many windows over few documents: windows no document has are gone before the documents are read again."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(i, text(200)) for i in range(300)]
    docs = [(d, text(50) + " " + " ".join(items[d][1].split()[20:45]) + " " + text(50)) for d in range(20)] + [(99, text(3000))]
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == brute(docs, items)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "One  TWO"), (1, "one two"), (2, None), (None, "a b c"), (3, "word word word")], "item_id long, text string")
    rows = decontaminate.scan(awkward, items).collect()
    assert len(rows) == awkward.count()
    assert [(r.n_hit, r["items"]) for r in rows if r.doc_id == 4] == [(2, ["1"])] * 2
    assert [(r.n_words, r.n_hit) for r in rows if r.doc_id in (1, 2, 3)] == [(0, 0)] * 3
    assert [(r.n_words, r.n_hit) for r in rows if r.doc_id == 6] == [(30000, 30000)]
    assert decontaminate.scan(nothing, items).count() == 0
    assert {r.n_hit for r in decontaminate.scan(awkward, items.where("false")).collect()} == {0}
    assert decontaminate.keep_clean(awkward, items).columns == awkward.columns


def test_runs():
    there = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1], dtype=bool)
    for least, want in ((1, there), (2, [1, 1, 0, 1, 1, 1, 0, 0, 0]), (3, [0, 0, 0, 1, 1, 1, 0, 0, 0]), (4, [0] * 9)):
        assert decontaminate.in_runs(there, least).tolist() == [bool(x) for x in want]
    assert decontaminate.in_runs(np.zeros(0, dtype=bool), 2).tolist() == []
