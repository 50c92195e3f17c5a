"""Bin-index expressions.  Bin 0 is underflow, size + 1 overflow, bins are ``[lo, hi)``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from binloom.config import Axis, Uniform


def bin_index(x: Column, axis: Axis) -> Column:
    """Integer bin of ``x``.  NaN counts as overflow, NULL stays NULL (no bin)."""
    x = x.cast("double")
    if isinstance(axis, Uniform):
        step = F.floor(F.lit(float(axis.n)) * (x - F.lit(float(axis.lo))) / F.lit(float(axis.hi - axis.lo)))
        inside = F.least(step + 1, F.lit(axis.n)).cast("int")
        return (
            F.when(x < float(axis.lo), F.lit(0))
            .when(x >= float(axis.hi), F.lit(axis.n + 1))
            .when(x.isNotNull(), inside)
        )
    edges = axis.edges()
    out = F.when(x < edges[0], F.lit(0))
    for i, edge in enumerate(edges[1:], start=1):
        out = out.when(x < edge, F.lit(i))
    return out.when(x.isNotNull(), F.lit(len(edges)))


def folded(bin_col: Column, size: int, mode: int) -> Column:
    """Move under (1), over (2) or both (3) into the outermost real bins."""
    if mode not in (0, 1, 2, 3):
        raise ValueError(f"fold must be 0..3, not {mode}")
    out = bin_col
    if mode & 1:
        out = F.greatest(out, F.lit(1))
    if mode & 2:
        out = F.least(out, F.lit(size))
    # greatest and least pass over NULL, but no bin must stay no bin
    return F.when(bin_col.isNotNull(), out) if mode else out
