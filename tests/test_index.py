import numpy as np
import pytest

from tidemark.operators import index

SETTINGS = {"bits": 240, "bands": 30, "dim": 16, "least": 0.8}


def vectors(seed, n=300):
    """Random unit vectors and, for each, a neighbour at a cosine between 0.8 and 0.9."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, 16))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.8, 0.9, (n, 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "id long, v array<double>")


def close(x, least=0.8):
    c = x @ x.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] >= least}


@pytest.mark.parametrize("most", [512, 8])
def test_generations_equal_one_run(spark, tmp_path, most):
    """Also with hot buckets; recall near the threshold, against brute force, is 0.9 or more."""
    x = vectors(1)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    index.extend(frame(spark, x, range(600)), one, "id", "v", most=most, **SETTINGS)
    for ids in (range(0, 600, 2), range(1, 400, 2), range(401, 600, 2)):
        index.extend(frame(spark, x, ids), two, "id", "v", most=most, **SETTINGS)
    whole, parts = ({(r.a, r.b) for r in index.pairs(spark, p).collect()} for p in (one, two))
    want = close(x)
    assert index.generations(spark, two) == 3 and whole <= want and parts <= want
    assert len(whole) >= 0.9 * len(want) and len(parts) >= 0.9 * len(want)
    if most == 512:
        assert whole == parts


def test_adding_twice_adds_nothing(spark, tmp_path):
    x, path = vectors(2, 40), f"file://{tmp_path}/i"
    first = {(r.a, r.b) for r in index.extend(frame(spark, x, range(80)), path, "id", "v", **SETTINGS).collect()}
    assert first and index.extend(frame(spark, x, range(80)), path, "id", "v", **SETTINGS).count() == 0
    assert {(r.a, r.b) for r in index.pairs(spark, path).collect()} == first


def test_a_number_is_taken_once(spark, tmp_path):
    """A writer that finds its number taken leaves the index as it was."""
    x, path = vectors(3, 20), f"file://{tmp_path}/i"
    index.extend(frame(spark, x, range(20)), path, "id", "v", **SETTINGS)
    (tmp_path / "i" / "done").mkdir(exist_ok=True)
    real, index.generations = index.generations, lambda *_: 0
    try:
        with pytest.raises(Exception, match="(?i)exist"):
            index.extend(frame(spark, x, range(20, 40)), path, "id", "v", **SETTINGS)
    finally:
        index.generations = real
    assert index.generations(spark, path) == 1


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0] * 16), (2, [1.0] * 16), (2, [1.0] * 16), (3, None), (None, [1.0] * 16), (4, [1.0]), (5, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = index.extend(df, f"file://{tmp_path}/i", "id", "v", **SETTINGS).collect()
    assert [(r.a, r.b, round(r.cosine, 9)) for r in got] == [(1, 2, 1.0)]
    assert index.extend(df.where("false"), f"file://{tmp_path}/e", "id", "v", **SETTINGS).count() == 0
