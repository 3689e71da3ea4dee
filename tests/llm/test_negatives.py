import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, queries

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, turned=lambda i, y: (y + 1) % 10 if i % 7 == 0 else y):
    fit = [(i, turned(i, y), [math.floor(256 * np.float64(np.float32(v))) for v in x]) for i, x, y in rows if None not in (i, x, y) and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for i, y, x in fit:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(x, z, strict=True)), j, w) for j, w, z in fit if j != i and len(z) == len(x)]
        for ps, p, _ in sorted((s for s in scored if s[2] == y), key=lambda s: (-s[0], s[1]))[:5]:
            near = sorted(((s, j) for s, j, w in scored if w != y and 50 * ps <= 100 * s <= 95 * ps), key=lambda s: (-s[0], s[1]))[:3]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, ROWS).withColumns({"x": F.lit(1), "anchor_id": F.lit(2), "score": F.lit("s")})
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fit = negatives.usable(df, turned)
    got = negatives.mine(fit.repartition(5), fit.where(F.col("vec_id") % 50 == 0), **more).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def corpus(seed, n=1200, dim=6):
    """Few distinct vectors, so that scores tie, and one label with a third of the rows."""
    rng = random.Random(seed)
    pool = [[round(rng.uniform(-1, 1), 1) for _ in range(dim)] for _ in range(60)]
    return [(i, rng.choice(pool) if rng.random() < 0.6 else [rng.gauss(0.3, 0.5) for _ in range(dim)], 3 if rng.random() < 0.33 else rng.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("seed,size", [(1, negatives.GROUP_BYTES), (2, 400)])
def test_equals_brute_force(spark, monkeypatch, seed, size):
    """Also in many groups of anchors, and with blocks and chunks that part the rows anyhow."""
    monkeypatch.setattr(negatives, "CHUNK", 37)
    monkeypatch.setattr(negatives, "SUB_BLOCK", 5)
    rows = corpus(seed)
    assert mined(spark, rows, group_bytes=size) == brute(rows) != []


def test_driver_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op11_negatives(spark, d)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 2), (2, [0.6, 0.0], 3), (3, [0.5, nan], 3), (4, [inf, 0.0], 3), (5, None, 3), (6, [0.5, 0.0], None), (None, [0.5, 0.0], 3), (8, [0.5, None], 3), (9, [0.5], 3), (10, [], 2), (50, [], 2), (100, [0.1, 0.1], 5), (16, [0.6, 0.0], 3)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [r for r in rows if r[0] is None]) == []
    # Rows that repeat an id are candidates each, and one anchor.
    twice = [(50, [1.0], 1), (50, [1.0], 1), (51, [1.0], 1), (51, [1.0], 1), (52, [0.9], 2), (52, [0.9], 2)]
    got = mined(spark, twice)
    assert {r[:2] for r in got} == {(50, 51)} and {r[3] for r in got} == {52}


def test_products_are_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**27), 2**27, (3, 9)).astype(float) for _ in range(2))
    want = [[int(sum(int(x) * int(y) for x, y in zip(u, v, strict=True))) for v in b] for u in a]
    assert negatives.products(a, b).tolist() == want
    with pytest.raises(OverflowError):
        negatives.products(a * 2.0**10, b)
