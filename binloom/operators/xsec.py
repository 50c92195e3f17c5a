"""Algebra on cross-section tables and look-ups at a mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from binloom.functions.lookup import Curve


def relative_factor(percent: Column) -> Column:
    return 1 + percent / 100


def combine_production(table: DataFrame) -> DataFrame:
    """Quark-induced ZH, both W charges together, and scale factors from per-cent errors."""
    return table.select(
        "*", (F.col("ZH") - F.col("ggZH")).alias("zh_qq"), (F.col("Wplus") + F.col("Wminus")).alias("wh"),
        relative_factor(F.col("lo")).alias("scale_down"), relative_factor(F.col("hi")).alias("scale_up"))


def curve_from(points: DataFrame, x: str, y: str, limit: int = 10_000) -> Curve:
    """A table of (x, y) points as a curve; more points than the limit are refused, not cut."""
    rows = points.select(x, y).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} points; this is not a curve table")
    rows = sorted((float(a), float(b)) for a, b in rows)
    return Curve(tuple(a for a, _ in rows), tuple(b for _, b in rows))
