"""Derived quantities and predicates used by selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def unroll2d(x: Column, y: Column, x_edges, y_edges) -> Column:
    """One index from two scores: ``ny * i + j + 1``; a value on an edge belongs to no cell (0)."""
    def cell(v, edges):
        out = F.lit(None).cast("int")
        for k in reversed(range(len(edges) - 1)):
            out = F.when((v > float(edges[k])) & (v < float(edges[k + 1])), F.lit(k)).otherwise(out)
        return out
    ny = len(y_edges) - 1
    return F.coalesce(F.lit(ny) * cell(x, x_edges) + cell(y, y_edges) + 1, F.lit(0))


def strict_winner(scores: dict[str, Column]) -> dict[str, Column]:
    """Per class a flag that its score is above every other one; nobody wins a tie."""
    out = {}
    for name, score in scores.items():
        others = [s for n, s in scores.items() if n != name]
        out[name] = reduce(lambda a, b: a & b, [score > s for s in others])
    return out


def masked(x: Column, good: Column, sentinel: float) -> Column:
    return F.when(good, x).otherwise(F.lit(sentinel))


def shifted_unless(x: Column, good: Column, shift: float = 9999.9) -> Column:
    """Failing objects are pushed far below any axis, so they fill the underflow."""
    return F.when(good, x).otherwise(x - F.lit(shift))


def trigger_priority(order: list[tuple[str, Column]]) -> Column:
    """Name of the first primary dataset whose trigger fired; NULL if none did."""
    out = None
    for name, fired in order:
        out = F.when(fired, F.lit(name)) if out is None else out.when(fired, F.lit(name))
    return out


def in_box(eta: Column, phi: Column, eta_lo, eta_hi, phi_lo, phi_hi) -> Column:
    return (eta > eta_lo) & (eta < eta_hi) & (phi > phi_lo) & (phi < phi_hi)


def flavour_threshold(pdg: Column, value: Column, electron: float, muon: float) -> Column:
    """Working point that depends on the lepton's flavour."""
    return (((F.abs(pdg) == 11) & (value > electron)) | ((F.abs(pdg) == 13) & (value > muon)))
