"""Tracks as NPZ files: a data source for spark.read and df.write, one file a track.

    spark.dataSource.register(TrackArrays)
    spark.read.format("track_arrays").load(folder)        # path, sample_index, time_s, value, violation
    df.write.format("track_arrays").mode("append").save(folder)   # from track, sample_index, time_s, value

A file holds `time_s` and `value` of equal length, times strictly rising and finite. A file that isn't so gives a single row
that says why, and no values: LENGTHS, CLOCK, NOT_FINITE, FIELDS or UNREADABLE. Files are partitions, read by the tasks through
the store that the folder's address names. Written files are named by track and appear under that name when the job
commits; rows of a track must come in one partition (write_tracks deals them so), else the job fails.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

READ = "path string, sample_index long, time_s double, value double, violation string"
WRITTEN = ["track", "sample_index", "time_s", "value"]


def _store(folder: str):
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def check(data: bytes) -> tuple[np.ndarray, np.ndarray, str | None]:
    """(times, values, what is wrong with the file)."""
    none = np.zeros(0)
    try:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        if not {"time_s", "value"} <= set(held.files):
            return none, none, "FIELDS"
        t, v = np.asarray(held["time_s"], dtype=float), np.asarray(held["value"], dtype=float)
    except Exception:
        return none, none, "UNREADABLE"
    if t.ndim != 1 or t.shape != v.shape:
        return none, none, "LENGTHS"
    if not np.isfinite(t).all() or np.isinf(v).any():
        return none, none, "NOT_FINITE"
    if len(t) > 1 and not (np.diff(t) > 0).all():
        return none, none, "CLOCK"
    return t, v, None


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        store, path = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(path, recursive=False))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".npz")] or [_File("")]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = _store(self.folder)
        with store.open_input_file(partition.path) as f:
            t, v, wrong = check(f.read())
        if wrong:
            yield (partition.path, None, None, None, wrong)
        for i, (a, b) in enumerate(zip(t.tolist(), v.tolist(), strict=True)):
            yield (partition.path, i, a, None if np.isnan(b) else b, None)


@dataclass
class _Done(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, names: list[str], overwrite: bool):
        self.folder, self.names = folder, names
        if overwrite:
            raise ValueError("tracks are added, not overwritten")
        if missing := set(WRITTEN) - set(names):
            raise ValueError(f"missing columns: {sorted(missing)}")

    def write(self, iterator) -> _Done:
        at = {n: self.names.index(n) for n in WRITTEN}
        tracks: dict[str, list[tuple]] = {}
        for row in iterator:
            tracks.setdefault(row[at["track"]], []).append((row[at["sample_index"]], row[at["time_s"]], row[at["value"]]))
        store, path = _store(self.folder)
        files = []
        for name, rows in tracks.items():
            rows.sort(key=lambda r: r[0])
            out = io.BytesIO()
            np.savez(out, time_s=np.array([r[1] for r in rows], dtype=float), value=np.array([np.nan if r[2] is None else r[2] for r in rows], dtype=float))
            if wrong := check(out.getvalue())[2]:
                raise ValueError(f"track {name}: {wrong}")
            staged = f"{path}/_staging/{uuid.uuid4().hex}"
            store.create_dir(f"{path}/_staging", recursive=True)
            with store.open_output_stream(staged) as f:
                f.write(out.getvalue())
            files.append((f"{path}/{quote(str(name), safe='')}.npz", staged))
        return _Done(files)

    def commit(self, messages) -> None:
        store, _ = _store(self.folder)
        files = [f for m in messages if m for f in m.files]
        names = [name for name, _ in files]
        taken = [name for name in set(names) if names.count(name) > 1 or store.get_file_info(name).type != fs.FileType.NotFound]
        if taken:
            self.abort(messages)
            raise ValueError(f"tracks that are there already or in several partitions: {sorted(taken)[:5]}")
        for name, staged in files:
            store.move(staged, name)

    def abort(self, messages) -> None:
        store, _ = _store(self.folder)
        for m in messages:
            for _, staged in m.files if m else []:
                if store.get_file_info(staged).type != fs.FileType.NotFound:
                    store.delete_file(staged)


class TrackArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "track_arrays"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names, overwrite)


def write_tracks(df: DataFrame, folder: str) -> None:
    """Write (track, sample_index, time_s, value), each track in one task; a task holds one partition's tracks."""
    df.sparkSession.dataSource.register(TrackArrays)
    df.select(*WRITTEN).repartition("track").write.format("track_arrays").mode("append").save(folder)


def read_tracks(spark, folder: str) -> DataFrame:
    spark.dataSource.register(TrackArrays)
    return spark.read.format("track_arrays").load(folder)
