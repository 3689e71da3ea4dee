import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common


@pytest.mark.parametrize("n,bits", [(0, 16), (1000, 16), (40_000, 22), (3_000_000, 27)])
def test_bitmap_lets_no_member_out(spark, n, bits):
    """Every member has its bit, few others have one, and slices that tasks build make up the whole map."""
    df = spark.range(0, n, 1, 8).select(F.xxhash64("id").alias("h"))
    got, data = common.bitmap(df, n)
    assert got >= bits and got <= common.MOST_BITS and len(data) == 1 << (got - 3)
    look = common.Bitmap(got, data)
    sample = np.array([r.h for r in df.where("id % 97 = 0").collect()], dtype=np.int64).view(np.uint64)
    assert look(sample).all()
    others = np.array([r.h for r in spark.range(10_000_000, 10_020_000).select(F.xxhash64("id").alias("h")).collect()], dtype=np.int64).view(np.uint64)
    assert look(others).mean() < (0.03 if n < 1_000_000 else 0.05)
