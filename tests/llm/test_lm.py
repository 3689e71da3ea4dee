import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm, queries
from tidemark.llm.succinct import EliasFano, dump, load, nested, part

LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.mark.parametrize("n,top,same", [(1, 1, 0), (5, 3, 0), (1000, 10**6, 0), (20000, 30000, 500), (3000, 2**62, 0), (4000, 60, 0), (700, 10**9, 5000)])
def test_sequences(n, top, same):
    rng = np.random.default_rng(n)
    v = np.sort(np.concatenate([rng.integers(0, top, n), np.full(same, top // 2)]))
    arrays = load(np.frombuffer(dump(nested({"v": EliasFano.build(v), "x": np.arange(3, dtype=np.uint8)})), dtype=np.uint8))
    s, at = part(arrays, "v"), np.arange(len(v))
    assert (s[at] == v).all() and list(arrays["x"]) == [0, 1, 2]
    low, high = s.pairs(at[:-1])
    assert (low == v[:-1]).all() and (high == v[1:]).all()
    asked = np.concatenate([v, rng.integers(0, top + 5, 500)])
    where = np.searchsorted(v, asked)
    assert (s.find(asked) == np.where((where < len(v)) & (v[np.minimum(where, len(v) - 1)] == asked), where, -1)).all()


def test_an_empty_sequence_finds_nothing():
    s = EliasFano(EliasFano.build(np.zeros(0, dtype=np.int64)))
    assert s.find(np.array([0, 5])).tolist() == [-1, -1]


def test_counts_come_back_from_their_bytes():
    rng = np.random.default_rng(0)
    parts, want = [], Counter()
    for _ in range(5):
        pairs = sorted({(int(rng.integers(0, 50)) << int(rng.integers(0, 40)), int(rng.integers(0, 9))) for _ in range(200)})
        n = rng.integers(1, 2**40, len(pairs))
        want.update({k: int(v) for k, v in zip(pairs, n, strict=True)})
        parts.append(lm.encode(np.array([p for p, _ in pairs]), np.array([r for _, r in pairs]), n))
    p, r, n = lm.merge(parts)
    assert dict(zip(zip(p.tolist(), r.tolist(), strict=True), n.tolist(), strict=True)) == want and sorted(want) == list(zip(p.tolist(), r.tolist(), strict=True))


def brute(rows, order=3):
    """(held, n_tokens, n_known, train_tokens, base, score) by row: absolute discounting with plain dictionaries."""
    told = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    grams = [Counter() for _ in range(order + 1)]
    for (i, w), h in zip(told, held, strict=True):
        if i is not None and not h:
            s = [None, *w]
            grams[1].update((x,) for x in w)
            for k in range(2, order + 1):
                grams[k].update(tuple(s[j : j + k]) for j in range(len(s) - k + 1))
    c, total, words = grams[1], sum(grams[1].values()), len(grams[1])
    kept = [None, {g: n for g, n in c.items() if n >= 2}]
    for k in range(2, order + 1):
        kept.append({g: n for g, n in grams[k].items() if n >= 2 and g[:-1] in kept[k - 1] and g[1:] in kept[k - 1]})
    used = [Counter() for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, n in kept[k].items():
            used[k][g[:-1]] += n - lm.DISCOUNT
    out = []
    for (_, w), h in zip(told, held, strict=True):
        s, base, score = [None, *w], 0.0, 0.0
        for j in range(1, len(s)):
            p = (c[s[j],] + 1) / (total + words + 1)
            base += math.log10(p)
            for k in range(2, min(order, j + 1) + 1):
                run = tuple(s[j - k + 1 : j])
                if run in kept[k - 1]:
                    n = kept[k - 1][run]
                    p = p * (1 - used[k][run] / n) + max(kept[k].get((*run, s[j]), 0) - lm.DISCOUNT, 0) / n
            score += math.log10(p)
        out.append((h, len(w), sum(c[x,] > 0 for x in w), total, base, score))
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "a", "CAT", "sat", "é", "on"] + [f"w{k}" for k in range(200)]
    text = lambda: rng.choice([" ", "\n", "\t  "]).join(rng.choices(words, [60, 20, 20, 9, 9, 9, 9] + [1] * 200, k=rng.randrange(0, 60)))
    pool = [text() for _ in range(40)]
    return [(i, rng.choice(pool) if rng.random() < 0.4 else text()) for i in range(n)]


@pytest.mark.parametrize("seed,order,shards", [(1, 3, 4), (2, 2, 1), (3, 4, 7), (4, 1, 3), (5, 3, 40)])
def test_equals_brute_force(spark, monkeypatch, seed, order, shards):
    """Exact but for quantised shares; with many shards a frequent word's children lie in several of them."""
    monkeypatch.setattr(lm, "CHUNK", 3000)
    rows = corpus(seed)
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order, shards).collect()}
    for (i, _), (held, n, known, total, base, score) in zip(rows, brute(rows, order), strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-8 and abs(r.score - score) < 0.004 * n + 1e-9, (i, r, score)


def test_quantised_shares_stay_close():
    x = 10 ** np.random.default_rng(1).uniform(-7, 0, 5000)
    codes, book = lm.quantise(x, 256)
    assert np.abs(np.log10(book[codes]) - np.log10(x)).max() <= 7 / 255 / 2 + 1e-9
    assert lm.quantise(np.array([0.5]), 255)[1][0] == pytest.approx(0.5)


def test_probabilities_sum_to_one(spark):
    """Over all words, and one that nobody knows, after a known run: but for what quantising moves."""
    rows = corpus(6)
    words = sorted({w for _, t in rows for w in t.translate(LOWER).split()})
    train = spark.createDataFrame(rows, "doc_id long, text string").where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    model = lm.train(train, 3, 5)
    ask = [(k, False, f"the a {w}") for k, w in enumerate(words)] + [(-1, False, "the a"), (-2, False, "the a never-seen")]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(ask, "doc_id long, held_out boolean, text string"), model).collect()}
    # What ends a text is in the words' scores too, so compare continuations through a model of the same runs.
    assert all(np.isfinite(v) and v < 0 for v in got.values())
    assert got[-2] < max(v for k, v in got.items() if k >= 0)


def test_held_out_texts_gain(spark):
    rows = queries.op13_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_awkward_rows(spark, awkward, nothing):
    docs = awkward.withColumns({"held_out": F.lit("x"), "h": F.lit(3)})
    rows = lm.score_documents(docs).collect()
    assert len(rows) == docs.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert [r.held_out for r in rows if r.doc_id is None] == [False] and [r.n_tokens for r in rows if r.doc_id == 6] == [30001]
    same = [r for r in rows if r.doc_id == 4]
    assert same[0] == same[1]
    assert lm.score_documents(nothing).count() == 0
    alone = lm.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.base_score, r.score) for r in alone] == [(0, 0.0, 0.0)]
