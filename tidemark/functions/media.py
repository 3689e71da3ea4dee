"""Clock and level functions, match rules, costs. Zero and missing levels stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decibels(amplitude: Column) -> Column:
    return 20 * F.log10(F.nullif(F.abs(amplitude), F.lit(0.0)))


def source_time(offset: Column, clip: Column) -> Column:
    return offset + clip


def duration_with_basis(fmt: Column, stream: Column, packets: Column) -> Column:
    """struct(seconds, basis) of the first duration that is known."""
    basis = F.when(fmt.isNotNull(), "FORMAT").when(stream.isNotNull(), "STREAM").when(packets.isNotNull(), "PACKETS").otherwise("UNKNOWN")
    return F.struct(F.coalesce(fmt, stream, packets).alias("seconds"), basis.alias("basis"))


def tick_tolerance(num_a: Column, den_a: Column, num_b: Column, den_b: Column) -> Column:
    """Half a tick of both clocks."""
    return (num_a / den_a + num_b / den_b) / 2


def full_span(start: Column, end: Column, lo: Column, hi: Column, slack: float = 0.05, share: float = 0.98) -> Column:
    """A match that reaches both ends within the slack and covers enough of the whole."""
    return (start <= lo + slack) & (end >= hi - slack) & ((end - start) >= share * (hi - lo))


def match_class(score: Column) -> Column:
    return F.when(score >= 0.985, "EXACT").when(score >= 0.95, "NEAR_EXACT").when(score >= 0.85, "PROBABLE").otherwise("POSSIBLE")


def identity_decision(kind: Column, whole_a: Column, whole_b: Column, composite: Column, manual: Column) -> Column:
    """Whole units with an exact match are one; a manual decision stands first; no match is UNRESOLVED, never DISTINCT."""
    return (
        F.when(manual.isNotNull(), manual)
        .when(composite, "PART_OF_COMPOSITE")
        .when(kind.isin("EXACT", "NEAR_EXACT") & whole_a & whole_b, "SAME_UNIT")
        .when(kind.isin("EXACT", "NEAR_EXACT"), "SHARED_FRAGMENT")
        .otherwise("UNRESOLVED")
    )


def transformations(gain: Column, ratio: Column, pitch: Column) -> Column:
    """Labels of what a match changes: gain over 1.5 %, speed over 0.5 %, pitch over 0.05 semitones."""
    speed = F.abs(12 * F.log2(ratio) + pitch) <= 0.1
    return F.array_compact(
        F.array(
            F.when(gain < 0, F.lit("POLARITY")),
            F.when(F.abs(F.abs(gain) - 1) > 0.015, F.lit("GAIN")),
            F.when((F.abs(ratio - 1) > 0.005) & speed, F.lit("SPEED")),
            F.when((F.abs(ratio - 1) > 0.005) & ~speed, F.lit("TIME_STRETCH")),
            F.when((F.abs(pitch) > 0.05) & ~((F.abs(ratio - 1) > 0.005) & speed), F.lit("PITCH")),
        )
    )


def estimate_cost(text: Column, seconds: Column, per_byte: str, per_second: str) -> Column:
    """Money as decimals: bytes of text and whole seconds of sound at the tariff."""
    money = "decimal(18,9)"
    by_text = F.octet_length(text).cast("decimal(18,0)") * F.lit(per_byte).cast(money)
    by_time = F.ceil(seconds).cast("decimal(18,0)") * F.lit(per_second).cast(money)
    return (by_text + by_time).cast(money)
