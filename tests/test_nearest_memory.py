import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from tidemark.operators import search


def test_memory_of_nearest_does_not_grow_with_the_queries():
    rng = np.random.default_rng(1)
    x, ids = rng.normal(size=(4096, 8)), np.arange(3000)
    frame = pd.DataFrame({"id": np.arange(4096), "v": list(x)})
    tracemalloc.start()
    (found,) = search._nearest(SimpleNamespace(value={8: (ids, x[:3000])}), 2)([frame])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(f"peak {peak / 1e6:.0f} MB")
    assert peak < 100e6
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u[:3000] @ u.T
    c[ids, ids] = -1
    want = np.argsort(-c, axis=1)[:, :2]
    assert len(found) == 6000 and {(r.a, r.b) for r in found.itertuples()} == {(i, int(b)) for i in ids for b in want[i]}
