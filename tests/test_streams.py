import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.streaming import streams

SCHEMA = "pair string, revision long, action string"


def write(spark, rows, folder, n):
    """Rows in n files, whose modification order is the order of their names."""
    for k in range(n):
        spark.createDataFrame(rows[k::n], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_equal_the_ledger_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"p{rng.randrange(6)}", k, rng.choice(["same", "distinct", "reset"])) for k in range(60)]
    want = {r.pair: (r.revision, r.state, r.n_events) for r in ledger.decisions(spark.createDataFrame(rows, SCHEMA), ["pair"], ["revision"], "action", "reset").collect()}
    rng.shuffle(rows)
    write(spark, rows, tmp_path / "in", 5)
    stream = streams.decisions(streams.read_events(spark, str(tmp_path / "in"), SCHEMA), ["pair"], "revision", "action", "reset")
    streams.run_updates(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.pair: (r.revision, r.state, r.n_events) for r in streams.merged(spark, str(tmp_path / "out"), stream.schema, ["pair"]).collect()}
    assert got == want and len(list((tmp_path / "out").glob("batch=*"))) > 1


def test_decisions_go_on_after_a_restart(spark, tmp_path):
    """What a second run reads is added to the state of the first; an older revision that comes late changes nothing."""
    def run():
        stream = streams.decisions(streams.read_events(spark, str(tmp_path / "in"), SCHEMA), ["pair"], "revision", "action", "reset")
        streams.run_updates(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        return {r.pair: (r.revision, r.state, r.n_events) for r in streams.merged(spark, str(tmp_path / "out"), stream.schema, ["pair"]).collect()}

    write(spark, [("a", 5, "same"), ("b", 1, "distinct"), ("c", None, "same")], tmp_path / "in", 1)
    assert run() == {"a": (5, "SAME", 1), "b": (1, "DISTINCT", 1), "c": (None, None, 1)}
    write(spark, [("a", 3, "distinct"), ("b", 2, "reset")], tmp_path / "in", 1)
    assert run() == {"a": (5, "SAME", 2), "b": (2, "UNDECIDED", 2), "c": (None, None, 1)}
    # Only the keys that changed were written again.
    last = max((tmp_path / "out").glob("batch=*"), key=lambda p: int(p.name.split("=")[1]))
    assert {r.pair for r in spark.read.parquet(str(last)).collect()} == {"a", "b"}
    assert run() == {"a": (5, "SAME", 2), "b": (2, "UNDECIDED", 2), "c": (None, None, 1)}


def test_decisions_of_nothing(spark):
    assert ledger.decisions(spark.createDataFrame([], SCHEMA), ["pair"], ["revision"], "action", "reset").where(F.lit(True)).count() == 0
