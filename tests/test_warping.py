"""The table of alignments in blocks: the same distances whatever the blocks are, and work dealt among more tasks than series."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels, warping


def expected(x):
    x = np.array([np.nan if v is None else v for v in x], float)
    f = np.column_stack([x[:-1], x[1:]])
    r = kernels.warp_distance(f[: len(f) // 2], f[len(f) // 2 :], most=None)
    return None if r is None or np.isnan(r) else pytest.approx(r, abs=1e-12)


def slow(a, b):
    """Every cell by itself: total and steps of the last row and column, ties to the diagonal and then to the row above."""
    best = {(0, 0): (0.0, 0)}
    for i, u in enumerate(a, 1):
        for j, v in enumerate(b, 1):
            t, k = min((best.get((i - 1, j - 1), (np.inf, 0)), best.get((i - 1, j), (np.inf, 0)), best.get((i, j - 1), (np.inf, 0))), key=lambda c: c[0])
            best[i, j] = (t + 1.0 - float(u @ v), k + 1)
    return best


def test_a_block_continues_its_edges():
    rng = np.random.default_rng(3)
    a, b = (kernels.unit_frames(rng.integers(0, 4, (n, 2)).astype(float)) for n in (23, 31))
    best = slow(a.T, b.T)
    edge = lambda cells: (np.array([best.get(c, (np.inf, 0))[0] for c in cells]), np.array([best.get(c, (np.inf, 0))[1] for c in cells]))
    for i, j, rows in ((0, 0, 99), (7, 11, 99), (7, 11, 5), (22, 30, 1), (0, 12, 4), (9, 0, 3)):
        down, right = kernels.warp_block(a[:, i:], b[:, j:], edge([(i, c) for c in range(j, 32)]), edge([(r, j) for r in range(i + 1, 24)]), rows)
        for got, want in ((down, edge([(23, c) for c in range(j, 32)])), (right, edge([(r, 31) for r in range(i + 1, 24)]))):
            assert got[0] == pytest.approx(want[0], abs=1e-12) and (got[1] == want[1]).all()


def test_totals_and_the_way_back_are_those_of_the_table():
    rng = np.random.default_rng(4)
    for n, m, side, rows in ((23, 31, 5, 99), (31, 23, 7, 4), (40, 40, 8, 40), (1, 9, 4, 1), (9, 1, 4, 2), (1, 1, 4, 1)):
        a, b = (kernels.unit_frames(rng.integers(0, 3, (k, 2)).astype(float)) for k in (n, m))
        for top, left in ((np.r_[0.0, np.full(m, np.inf)], np.full(n, np.inf)), (rng.integers(0, 3, m + 1) / 4.0, rng.integers(0, 3, n) / 4.0)):
            # Steps that also tell where an alignment came in.
            come = 1000 * np.arange(m + 1 + n, dtype=np.int32)
            down, right = kernels.warp_block(a, b, (top, come[: m + 1]), (left, come[m + 1 :]))
            got = kernels.warp_totals(a, b, top, left, rows)
            assert (got[0] == down[0]).all() and (got[1] == right[0]).all()
            for r, c in ((n, m), (n // 2 + 1, m), (n, m // 2 + 1)):
                met = (right[1][r - 1] if c == m else down[1][c]).item()
                place, steps = kernels.warp_entry(a[:, :r], b[:, :c], top[: c + 1], left[:r], side)
                assert (place if place <= c else place - c + m, steps) == divmod(met, 1000)


@pytest.mark.parametrize(("least", "parts"), [(16384, 32), (16, 4), (1, 3)])
def test_blocks_change_no_distance(spark, least, parts):
    rng = np.random.default_rng(5)
    series = {"one": [1.0], "two": [1.0, 2.0], "three": [3.0, 1.0, 2.0], "even": rng.exponential(9, 300).tolist(), "odd": rng.exponential(9, 141).tolist()}
    series |= {"ties": rng.integers(0, 3, 200).astype(float).tolist(), "zeros": [0.0] * 90, None: rng.normal(size=80).tolist(), "null": [*rng.normal(size=60).tolist(), None, *rng.normal(size=60).tolist()]}
    # The halves run at different speeds, so that the best alignment leaves the diagonal.
    series["apart"] = np.concatenate([np.repeat(np.arange(1.0, 30), 3), np.repeat(np.arange(1.0, 30), np.r_[np.full(20, 1), np.full(9, 8)])]).tolist()
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "kind string, at long, value double").repartition(3)
    out = warping.half_distances(df, ["kind"], F.col("at"), F.floor(F.col("at") / 20), least=least, parts=parts)
    assert {r.kind: r.distance for r in out.collect()} == {k: expected(x) for k, x in series.items()}


def test_one_series_is_dealt_among_tasks(spark, tmp_path, monkeypatch):
    sizes = str(tmp_path)
    inner = warping._block

    def noted(key, frame):
        import os
        import uuid

        with open(f"{sizes}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{max(len(t) for t in frame['total'])} {os.getpid()}")
        return inner(key, frame)

    monkeypatch.setattr(warping, "_block", noted)
    x = np.random.default_rng(8).exponential(5, 1200)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "s int, at long, value double")
    assert warping.half_distances(df, ["s"], F.col("at"), F.floor(F.col("at") / 100), least=100).first().distance == expected(x)
    told = [[int(n) for n in p.read_text().split()] for p in tmp_path.iterdir()]
    # Six blocks along each half; no task holds more than a block's edges. Corners of the table are dropped.
    assert max(n for n, _ in told) <= 102 and 11 <= len(told) < 36
