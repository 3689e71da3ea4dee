from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest

from tidemark.operators import accounts

D = Decimal


def test_reservations_and_settlements(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    assert accounts.read(spark, path).count() == 0
    assert accounts.reserve(spark, path, "a", "r1", D("0.6"), D(1)) == 1
    assert accounts.reserve(spark, path, "a", "r2", D("0.5"), D(1)) is None
    assert accounts.reserve(spark, path, "a", "r1", D("0.6"), D(1)) == 1  # held already
    assert accounts.reserve(spark, path, "b", "r2", D("0.5"), D(1)) == 2
    assert accounts.settle(spark, path, "a", "r1", D("0.7")) is None  # more than was reserved
    assert accounts.settle(spark, path, "a", "r1", D("0.1")) == 3
    assert accounts.settle(spark, path, "a", "r1", D("0.1")) is None and accounts.settle(spark, path, "a", "no", D(0)) is None
    assert accounts.reserve(spark, path, "a", "r3", D("0.9"), D(1)) == 4
    got = {r.account: (r.held, r.spent) for r in accounts.balances(accounts.read(spark, path)).collect()}
    assert got == {"a": (D("0.9"), D("0.1")), "b": (D("0.5"), D(0))}
    with pytest.raises(ValueError):
        accounts.reserve(spark, path, "a", "r4", D(-1), D(1))


def test_two_writers_never_pass_the_limit_nor_share_a_revision(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda k: accounts.reserve(spark, path, "a", f"r{k}", D(3), D(10)), range(6)))
    numbers = [n for n in got if n is not None]
    assert sorted(numbers) == [1, 2, 3] and got.count(None) == 3
    rows = accounts.read(spark, path).collect()
    assert sorted(r.revision for r in rows) == [1, 2, 3] and sum(r.amount for r in rows) == 9


def test_what_a_lost_writer_left_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    spark.createDataFrame([("a", "x", "reserve", D(5))], accounts.ENTRY).write.parquet(f"{path}/parts/lost")
    assert accounts.reserve(spark, path, "a", "r", D(8), D(10)) == 1
    assert accounts.read(spark, path).count() == 1
