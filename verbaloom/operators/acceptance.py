"""The two-lane rule that accepts patterns: strong association, or many head lemmas without repulsion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

MODES = {"production": vocab.NPMI, "discovery": vocab.NPMI_DISCOVERY}
LANES = ("either", "npmi", "h_slot", "both")


def _number(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def with_lanes(patterns: DataFrame, npmi: float | Column = vocab.NPMI, h_slot: float | Column = vocab.H_SLOT, g2_npmi: float = vocab.G2_NPMI, g2_h_slot: float = vocab.G2_H_SLOT, floor: float = vocab.NPMI_FLOOR, lanes: str = "either") -> DataFrame:
    """Adds npmi_pass, h_slot_pass, accepted and lane (NPMI, H_slot, Both; null if not accepted)."""
    if lanes not in LANES:
        raise ValueError(f"lanes must be one of {LANES}")
    one = (F.col("npmi") >= _number(npmi)) & (F.col("g_squared") >= g2_npmi)
    two = (F.col("h_slot") >= _number(h_slot)) & (F.col("g_squared") >= g2_h_slot) & (F.col("npmi") >= floor)
    a, b = F.col("npmi_pass"), F.col("h_slot_pass")
    chosen = {"either": a | b, "npmi": a, "h_slot": b, "both": a & b}[lanes]
    lane = F.when(~chosen, None).when(a & b, "Both").when(a, "NPMI").otherwise("H_slot")
    return patterns.withColumns({"npmi_pass": one, "h_slot_pass": two}).withColumns({"accepted": chosen, "lane": lane})


def accept(patterns: DataFrame, mode: str = "production", **more) -> DataFrame:
    """with_lanes at the thresholds of a mode: production or discovery."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    return with_lanes(patterns, npmi=MODES[mode], **more)


def lane_statistics(patterns: DataFrame, mode: str = "production", by: Sequence[str] = ()) -> DataFrame:
    """Counts of how patterns fare in the lanes; those below the floor are charged to lane2_g2_failed as well."""
    least = MODES[mode]
    p = accept(patterns, mode)
    strong = (F.col("h_slot") >= vocab.H_SLOT) & (F.col("g_squared") >= vocab.G2_H_SLOT)
    n = lambda condition, name: F.count_if(condition).alias(name)
    a, b = F.col("npmi_pass"), F.col("h_slot_pass")
    return p.groupBy(*by).agg(
        F.count("*").alias("total_patterns"),
        n(a, "lane1_npmi_passed"), n(~a & (F.col("npmi") < least), "lane1_npmi_failed"), n(~a & (F.col("npmi") >= least), "lane1_g2_failed"),
        n(b, "lane2_h_slot_passed"), n(~b & (F.col("h_slot") < vocab.H_SLOT), "lane2_h_slot_failed"), n(~b & (F.col("h_slot") >= vocab.H_SLOT), "lane2_g2_failed"),
        n(a & ~b, "npmi_only_passed"), n(b & ~a, "h_slot_only_passed"), n(a & b, "both_lanes_passed"), n(a | b, "total_accepted"),
        n(strong & (F.col("npmi") < vocab.NPMI_FLOOR), "h_slot_filtered_by_npmi_floor"),
    )
