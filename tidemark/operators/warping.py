"""How far the two halves of a series are apart along their best alignment, over series of any length.

The table of alignments has the square of a series' cells and each needs its neighbours, so it is cut into blocks along both
halves, up to `PARTS` squared. Blocks of one antidiagonal don't need each other: each wave is a job that deals them,
and only their edges, last rows and columns, go on to the next wave, as Parquet in the shared folder. A task holds the edges of
a block and the stretches of the series beside it, never a series. Edges are totals; how many steps the best alignment has is
told by a way back through the blocks that it passes, from the last to the first, two of each row at most or so.

Costs aren't negative, so no alignment that is better than a known one passes through a cell of a higher total. The blocks on
the diagonal, each aligned by itself, give such a known one; an edge whose cells are all above it goes no further. That drops
blocks in the table's corners and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, signals
from .graph import scratch

#: Frames of a half that are one block at least, and blocks along a half at most; a half's block count is `_parts`.
LEAST, PARTS = 16384, 32
#: Names of blocks that are broadcast to find their stretches; beyond, they are joined by shuffle.
BROADCAST = 100_000
PIECE = "series string, i int, j int, side string, parts int, most double, total array<double>"
#: Where an alignment leaves a block, as the number of its rows and columns up to there (null: all), and its steps after that.
EXIT = "series string, i int, j int, rows int, columns int, steps long"


def half_distances(samples: DataFrame, keys: list[str], order: Column, bucket: Column, value: str = "value", least: int = LEAST, parts: int = PARTS) -> DataFrame:
    """(keys, distance), keys being text or numbers: mean cosine distance of the first half of a series' frames and the second, along the best alignment.

    A frame is two neighbouring values by `order`, which must leave no ties; `bucket` is a monotone function of it and not null.
    A series of under three values has no distance, nor has one with a null, NaN or infinite value.
    """
    spark = samples.sparkSession
    # One string names a series, null keys included, so that it joins and comes back from Python as it is.
    named = samples.select(F.to_json(F.struct(*keys)).alias("series"), F.struct(*keys).alias("keys"), order.alias("_at"), bucket.alias("_in"), F.col(value).cast("double").alias("v"))
    placed = signals.number(named.drop("keys"), ["series"], "_at", F.col("_in"))
    sizes = named.groupBy("series").agg(F.count("*").alias("size"), F.first("keys").alias("keys"))
    root = scratch(spark, "warp")
    _stretches(placed, sizes, least, parts).write.parquet(f"{root}/stretches")
    stretches = spark.read.parquet(f"{root}/stretches")

    # The best alignment that passes through all corners of the blocks on the diagonal; with one block it is the best of all.
    # Dealt by ranges of names, here and below: by their bytes, Spark would join the few stretches into one task.
    dealt = stretches.repartitionByRange(_wide(stretches.where("half = 'rows'").count()), "series", "block")
    met = dealt.groupBy("series", "block", "parts").applyInArrow(_diagonal, "series string, parts int, total double, steps int")
    met.write.parquet(f"{root}/diagonal")
    known = spark.read.parquet(f"{root}/diagonal").groupBy("series", "parts").agg(F.sum("total").alias("most"), F.sum("steps").alias("steps"))
    # Sums of rounded costs may be a little above or below: the bound leaves room for that.
    known.withColumn("most", F.when(~F.isnan("most"), F.col("most"))).write.parquet(f"{root}/known")
    known = spark.read.parquet(f"{root}/known")
    ends = known.where("parts = 1").select("series", (F.col("most") / F.col("steps")).alias("distance"))

    longer = known.where("parts > 1 AND most IS NOT NULL")
    count = longer.agg(F.count("*").alias("n"), F.max("parts").alias("parts")).first()
    waves = 2 * count["parts"] - 1 if count["n"] else 0
    start = longer.select("series", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit("start").alias("side"), "parts", (F.col("most") * (1 + 1e-9) + 1e-9).alias("most"), F.array().cast("array<double>").alias("total"))
    edges = start
    for wave in range(waves):
        live = edges.select("series", "i", "j", "parts", "most").distinct()
        live = F.broadcast(live) if count["n"] * count["parts"] <= BROADCAST else live
        beside = [
            live.join(stretches.where(F.col("half") == half).select("series", F.col("block").alias(at), "v"), ["series", at]).select("series", "i", "j", F.lit(half).alias("side"), "parts", "most", F.col("v").alias("total"))
            for half, at in (("rows", "i"), ("columns", "j"))
        ]
        wide = _wide(count["n"] * min(wave + 1, waves - wave))
        dealt = edges.unionByName(beside[0]).unionByName(beside[1]).repartitionByRange(wide, "series", "i", "j")
        dealt.groupBy("series", "i", "j").applyInArrow(_block, PIECE).write.parquet(f"{root}/wave={wave}")
        done = spark.read.schema(PIECE).parquet(f"{root}/wave={wave}")
        edges = done.where("side <> 'end'")
    if waves:
        last = spark.read.schema(PIECE).parquet(*[f"{root}/wave={wave}" for wave in range(waves)]).where("side = 'end'")
        steps = _way_back(root, stretches, start, waves, count["n"])
        ends = ends.unionByName(last.join(steps, "series").select("series", (F.col("total")[0] / F.col("steps")).alias("distance")))
    return sizes.join(ends, "series", "left").select("keys.*", "distance")


def _way_back(root: str, stretches: DataFrame, start: DataFrame, waves: int, series: int) -> DataFrame:
    """(series, steps) of the best alignments, from each series' last block to its first, a wave after the other."""
    spark = stretches.sparkSession
    last = start.select("series", (F.col("parts") - 1).alias("i"), (F.col("parts") - 1).alias("j"), F.lit(None).cast("int").alias("rows"), F.lit(None).cast("int").alias("columns"), F.lit(0).cast("long").alias("steps"))
    for wave in reversed(range(waves)):
        # Through a corner an alignment skips a wave.
        before = [f"{root}/back={w}" for w in (wave + 1, wave + 2) if w < waves]
        exits = last.unionByName(spark.read.schema(EXIT).parquet(*before)) if before else last
        exits = exits.where(F.col("i") + F.col("j") == wave)
        exits = F.broadcast(exits) if series <= BROADCAST else exits
        edges = spark.read.schema(PIECE).parquet(f"{root}/wave={wave - 1}").where("side <> 'end'") if wave else start
        held = [
            edges.join(exits, ["series", "i", "j"]).select(*exits.columns, "side", F.col("total").alias("held")),
            exits.join(stretches.where("half = 'rows'").withColumnRenamed("block", "i"), ["series", "i"]).select(*exits.columns, F.lit("u").alias("side"), F.col("v").alias("held")),
            exits.join(stretches.where("half = 'columns'").withColumnRenamed("block", "j"), ["series", "j"]).select(*exits.columns, F.lit("v").alias("side"), F.col("v").alias("held")),
        ]
        dealt = held[0].unionByName(held[1]).unionByName(held[2]).repartition(4 * _wide(series), "series", "i", "j")
        dealt.groupBy("series", "i", "j").applyInArrow(_back, EXIT).write.parquet(f"{root}/back={wave}")
    return spark.read.schema(EXIT).parquet(f"{root}/back=0").select("series", "steps")


def _wide(blocks: int) -> int:
    """Several times as many partitions as blocks, so that a range is one block."""
    return max(1, min(2000, 4 * blocks))


def _stretches(placed: DataFrame, sizes: DataFrame, least: int, parts: int) -> DataFrame:
    """(series, half, block, parts, v): the values whose frames are a block of rows, or of columns, of the table."""
    rows = F.expr("(size - 1) div 2")
    columns = F.col("size") - 1 - rows
    cut = sizes.where("size > 2").withColumns({"rows": rows, "columns": columns})
    cut = cut.withColumn("parts", F.greatest(F.lit(1), F.least(F.lit(parts), F.ceil(F.col("columns") / least), F.col("rows"))).cast("int"))
    # A value is the second of one frame and the first of the next; frames of the second half count from its start.
    place = "CASE WHEN f < rows THEN struct('rows' AS half, f * parts div rows AS block) ELSE struct('columns' AS half, (f - rows) * parts div columns AS block) END"
    frames = "filter(array(sample_index - 1, sample_index), f -> f >= 0 AND f < size - 1)"
    at = placed.join(cut, "series").select("series", "parts", "sample_index", "v", F.expr(f"explode(array_distinct(transform({frames}, f -> {place}))) AS _to"))
    at = at.select("series", "parts", "sample_index", "v", "_to.half", F.col("_to.block").cast("int").alias("block"))
    packed = at.groupBy("series", "half", "block", "parts").agg(F.sort_array(F.collect_list(F.struct("sample_index", "v"))).alias("_s"))
    return packed.select("series", "half", "block", "parts", F.transform("_s", lambda s: s["v"]).alias("v"))


def _frames(values: pa.ListScalar) -> np.ndarray:
    x = values.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    return kernels.unit_frames(np.column_stack([x[:-1], x[1:]]))


def _numbers(x: pa.ListScalar) -> np.ndarray:
    return np.array(x.values.to_numpy(zero_copy_only=False))


def _edges(held: dict, top: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges above a block and before it, of these sizes, from the pieces that came."""
    above, before = (_numbers(held[side]) if side in held else np.full(size, np.inf) for side, size in (("top", top), ("left", left)))
    if "start" in held:
        above[0] = 0.0
    return above, before


def _diagonal(key: tuple, table: pa.Table) -> pa.Table:
    held = dict(zip(table["half"].to_pylist(), table["v"], strict=True))
    u, v, parts = _frames(held["rows"]), _frames(held["columns"]), key[2].as_py()
    if parts == 1:
        total, steps = kernels.warp_ends(u, v)
    else:
        total, steps = float(kernels.warp_totals(u, v, *_edges({"start": None}, v.shape[1] + 1, u.shape[1]))[0][-1]), 0
    return pa.table({"series": [key[0].as_py()], "parts": pa.array([parts], pa.int32()), "total": [total], "steps": pa.array([steps], pa.int32())})


def _block(key: tuple, table: pa.Table) -> pa.Table:
    series, i, j = (k.as_py() for k in key)
    held = dict(zip(table["side"].to_pylist(), table["total"], strict=True))
    parts, most = table["parts"][0].as_py(), table["most"][0].as_py()
    u, v = _frames(held["rows"]), _frames(held["columns"])
    down, right = kernels.warp_totals(u, v, *_edges(held, v.shape[1] + 1, u.shape[1]))
    if i == j == parts - 1:
        out = [(i, j, "end", down[-1:])]
    else:
        out = [(i + 1, j, "top", down)] * (i + 1 < parts) + [(i, j + 1, "left", right)] * (j + 1 < parts)
        out = [r for r in out if r[3].min() <= most]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
    rows = [(series, *r[:3], parts, most, r[3]) for r in out]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["series", "i", "j", "side", "parts", "most", "total"])


def _back(key: tuple, table: pa.Table) -> pa.Table:
    series, i, j = (k.as_py() for k in key)
    held = dict(zip(table["side"].to_pylist(), table["held"], strict=True))
    rows, columns, steps = (table[k][0].as_py() for k in ("rows", "columns", "steps"))
    u, v = _frames(held["u"]), _frames(held["v"])
    top, left = _edges(held, v.shape[1] + 1, u.shape[1])
    u, v = u[:, :rows], v[:, :columns]
    place, own = kernels.warp_entry(u, v, top[: v.shape[1] + 1], left[: u.shape[1]])
    if place == 0:
        to = (i - 1, j - 1, None, None)
    elif place <= v.shape[1]:
        to = (i - 1, j, None, place)
    else:
        to = (i, j - 1, place - v.shape[1], None)
    kinds = (pa.string(), *[pa.int32()] * 4, pa.int64())
    return pa.table([pa.array([x], kind) for x, kind in zip((series, *to, steps + own), kinds, strict=True)], names=["series", "i", "j", "rows", "columns", "steps"])
