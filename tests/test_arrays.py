import numpy as np
import pytest

from tidemark.sources import arrays

ROWS = "track string, sample_index long, time_s double, value double"


def test_tracks_come_back(spark, tmp_path):
    rows = [(f"t/{k}", i, 0.1 * i + k, None if i == 2 else float(i * k)) for k in range(3) for i in range(5)]
    arrays.write_tracks(spark.createDataFrame(rows, ROWS).repartition(4), str(tmp_path))
    got = arrays.read_tracks(spark, str(tmp_path)).collect()
    files = sorted({r.path for r in got})
    assert [f.rsplit("/", 1)[1] for f in files] == ["t%2F0.npz", "t%2F1.npz", "t%2F2.npz"]
    assert sorted((r.path, r.sample_index, r.time_s, r.value) for r in got if r.value is not None) == sorted((files[int(t[2])], i, s, v) for t, i, s, v in rows if v is not None)
    assert all(r.violation is None for r in got) and len(got) == 15 and not list((tmp_path / "_staging").iterdir())


def test_bad_files_are_rows(spark, tmp_path):
    t = np.arange(4.0)
    np.savez(tmp_path / "good.npz", time_s=t, value=t)
    np.savez(tmp_path / "short.npz", time_s=t, value=t[:3])
    np.savez(tmp_path / "clock.npz", time_s=t[::-1], value=t)
    np.savez(tmp_path / "infinite.npz", time_s=t, value=t / np.array([1, 1, 0, 1]))
    np.savez(tmp_path / "named.npz", time=t, value=t)
    (tmp_path / "text.npz").write_text("no archive")
    (tmp_path / "other.txt").write_text("not looked at")
    rows = arrays.read_tracks(spark, f"file://{tmp_path}").collect()
    wrong = {r.path.rsplit("/", 1)[1]: r.violation for r in rows if r.violation}
    assert wrong == {"short.npz": "LENGTHS", "clock.npz": "CLOCK", "infinite.npz": "NOT_FINITE", "named.npz": "FIELDS", "text.npz": "UNREADABLE"}
    assert sum(r.path.endswith("good.npz") for r in rows) == 4 and len(rows) == 9


def test_nothing_is_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0)], ROWS)
    arrays.write_tracks(df, str(tmp_path))
    with pytest.raises(Exception, match="there already"):
        arrays.write_tracks(df, str(tmp_path))
    with pytest.raises(Exception, match="CLOCK"):
        arrays.write_tracks(spark.createDataFrame([("b", 0, 1.0, 1.0), ("b", 1, 1.0, 1.0)], ROWS), str(tmp_path))
    assert [p.name for p in tmp_path.glob("*.npz")] == ["a.npz"]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert arrays.read_tracks(spark, str(empty)).count() == 0
