"""Order-dependent passes over groups, many groups to a Python call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], order: list, step: Callable[[dict[str, np.ndarray]], dict | None], schema: str) -> DataFrame:
    """step(columns of one group, in order) -> columns of its result, for every group; None for no rows.

    Rows are dealt by key and sorted, so a task streams through its groups: a batch of Arrow rows holds thousands of small
    ones, and only a group that runs across batches is carried on. Nulls of keys are one group, as in groupBy.
    """
    names = [x.strip().split(" ")[0].strip("`") for x in _fields(schema)]

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            starts = _starts(frame, keys)
            if held and not _same(held[-1], frame, keys):
                yield _columns(held)
                held = []
            if len(starts) > 1:
                yield _columns([*held, frame.iloc[: starts[1]]])
                arrays = _columns([frame])
                for a, z in zip(starts[1:], starts[2:], strict=False):
                    yield {k: v[a:z] for k, v in arrays.items()}
                held = [frame.iloc[starts[-1] :]]
            else:
                held.append(frame)
        if held:
            yield _columns(held)

    def run(frames):
        out: list[dict] = []
        rows = 0
        for group in groups(frames):
            made = step(group)
            if made is not None and len(made[names[0]]):
                out.append(made)
                rows += len(made[names[0]])
            if rows >= 10_000:
                yield _frame(out, names)
                out, rows = [], 0
        if out:
            yield _frame(out, names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Fields of a schema string: commas inside brackets don't part them."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def _starts(frame: pd.DataFrame, keys: list[str]) -> list[int]:
    fresh = np.zeros(len(frame), dtype=bool)
    fresh[0] = True
    for k in keys:
        v = frame[k]
        codes = pd.factorize(v, use_na_sentinel=True)[0]
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.nonzero(fresh)[0].tolist()


def _same(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    pairs = [(a[k].iloc[-1], b[k].iloc[0]) for k in keys]
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in pairs)


def _columns(frames: list[pd.DataFrame]) -> dict[str, np.ndarray]:
    whole = frames[0] if len(frames) == 1 else pd.concat(frames)
    return {k: whole[k].to_numpy() for k in whole.columns}


def _frame(parts: list[dict], names: list[str]) -> pd.DataFrame:
    def column(k: str):
        held = [p[k] for p in parts]
        return np.concatenate(held) if all(isinstance(x, np.ndarray) and x.dtype == held[0].dtype for x in held) else [v for x in held for v in x]

    return pd.DataFrame({k: column(k) for k in names})
