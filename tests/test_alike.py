"""Comparisons of every two vectors: none is missed, whatever the blocks."""

import numpy as np
import pytest

from tidemark.operators import index, search


def near(seed, n, dim, low, high):
    """n random unit vectors and, for each, one at a cosine between low and high."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, y = unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(low, high, (n, 1))
    return x, c * x + np.sqrt(1 - c * c) * y


def rows(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("block", [1 << 17, 90])
def test_no_pair_is_missed(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_ROWS", block)
    x, y = near(3, 200, 16, 0.78, 0.82)
    both = np.concatenate([x, y])
    c = both @ both.T
    found = search.alike(rows(spark, both), "id", "v", 0.8).collect()
    got = {(r.a, r.b): r.cosine for r in found}
    assert len(found) == len(got)
    assert got.keys() == {(i, j) for i in range(400) for j in range(i + 1, 400) if c[i, j] >= 0.8}
    assert all(abs(s - c[p]) < 1e-12 for p, s in got.items())
    cross = {(r.a, r.b - 1000) for r in search.within(rows(spark, x), rows(spark, y, 1000), "id", "v", 0.8).collect()}
    assert cross == {(int(i), int(j)) for i, j in np.argwhere(x @ y.T >= 0.8)}


def test_generations_miss_no_pair(spark, tmp_path):
    """Whatever bands are asked for."""
    both = np.concatenate(near(4, 150, 16, 0.8, 0.82))
    path = f"file://{tmp_path}/i"
    for ids in (range(0, 300, 2), range(1, 300, 2)):
        df = spark.createDataFrame([(i, both[i].tolist()) for i in ids], "id long, v array<double>")
        index.extend(df, path, "id", "v", bits=30, bands=3, dim=16, least=0.8)
    c = both @ both.T
    assert {(r.a, r.b) for r in index.pairs(spark, path).collect()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if c[i, j] >= 0.8}


def test_awkward_vectors_have_no_cosine(spark):
    odd = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (8, [1e300, 2e300]), (9, []), (10, [2e-300, 4e-300])]
    df = spark.createDataFrame(odd, "id long, v array<double>")
    assert {(r.a, r.b) for r in search.within(df, df, "id", "v", 0.9).collect()} >= {(1, 1), (7, 7)}
    assert {(r.a, r.b) for r in search.alike(df, "id", "v", 0.9).where("a < 8 AND b < 8").collect()} == set()
    assert search.alike(df.where("false"), "id", "v", 0.9).count() == 0
