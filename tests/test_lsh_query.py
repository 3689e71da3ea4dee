import numpy as np

from tidemark.plans import catalogue


def test_lsh_candidates_miss_nothing(spark, tmp_path):
    """900 vectors just above 0.6 to a query that is turned; shared buckets missed some."""
    rng = np.random.default_rng(5)
    q = rng.normal(size=64).astype(np.float32)
    turned = np.where(np.arange(64) % 8 == 0, -q, q).astype(float)
    turned /= np.linalg.norm(turned)
    y = rng.normal(size=(900, 64))
    y -= (y @ turned)[:, None] * turned
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    data = [(0, q.tolist())] + [(101 + 100 * (i // 99) + i % 99, (0.6001 * turned + 0.79992 * v).tolist()) for i, v in enumerate(y)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b) for r in catalogue.queries()["lsh_candidates"](spark, str(tmp_path)).collect()}
    assert {b for a, b in got if a == 0} >= {i for i, _ in data[1:]}
