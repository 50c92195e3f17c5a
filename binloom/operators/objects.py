"""Operators on flat objects of an event: dressing, pairs, masks of combinations, fiducial."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from binloom.functions.events import at
from binloom.functions.kinematics import MISSING, P4, transverse_mass
from binloom.operators.joins import cell_join


def _with_copies(objects: DataFrame) -> DataFrame:
    """Equal rows as one with their number, so that rows can be told apart without numbering them."""
    return objects.groupBy(*objects.columns).agg(F.count(F.lit(1)).alias("copies"))


def dress(leptons: DataFrame, photons: DataFrame, key: str, order: list[str], dr2_cut: float) -> DataFrame:
    """All leptons as (key, pt, eta, phi) with the momenta of the photons nearest to them added.

    Both tables are flat with pt, eta, phi, mass; ``order`` names columns of the leptons (a leading ``-``: falling) and says which of
    several at one distance is the first.  A photon goes to its nearest lepton if that is within the cut.  It meets
    leptons of neighbouring cells only, so a hot event is spread.  Of equal leptons one is dressed, the others stay as they are.
    """
    fields = [c for c in leptons.columns if c != key]
    first = [(-F.col("o_" + c[1:]) if c.startswith("-") else F.col("o_" + c)).alias(f"k{i}") for i, c in enumerate(order)]
    photons = _with_copies(photons.select(key, "pt", "eta", "phi", "mass"))
    near = cell_join(photons, leptons, key, math.sqrt(dr2_cut), cut2=dr2_cut)
    own = near.groupBy(*photons.columns).agg(F.min(F.struct("o_dr2", *first, *[f"o_{c}" for c in fields])).alias("n"))
    v = P4.ptetaphim(F.col("pt"), F.col("eta"), F.col("phi"), F.col("mass"))
    p3 = ("px", "py", "pz")
    extra = own.select(key, *[F.col("n")[f"o_{c}"].alias(c) for c in fields],
                       *[(getattr(v, p) * F.col("copies")).alias(p) for p in p3], F.lit(0).alias("copies"))
    base = leptons.select(key, *fields, *[F.lit(0.0).alias(p) for p in p3], F.lit(1).alias("copies"))
    total = base.unionByName(extra).groupBy(key, *fields).agg(*[F.sum(p).alias(p) for p in p3], F.sum("copies").alias("copies"))
    total = total.withColumns({p: F.col(p) + getattr(v, p) for p in p3})
    pt = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py"))
    dressed = F.struct(pt.alias("pt"), F.asinh(F.try_divide(F.col("pz"), pt)).alias("eta"), F.atan2("py", "px").alias("phi"))
    bare = F.transform(F.sequence(F.lit(2), F.greatest(F.col("copies"), F.lit(2))), lambda _: F.struct("pt", "eta", "phi"))
    rows = F.when(F.col("copies") > 1, F.concat(F.array(dressed), bare)).otherwise(F.array(dressed))
    return total.select(key, F.explode(rows).alias("d")).select(key, "d.*")


def pair_sums(objects: DataFrame, key: str, value: str) -> DataFrame:
    """Per event the number of unordered pairs (``n_pairs``) and the sum of the products of their values (``products``).

    No pair is formed: products of pairs add up to half of (sum^2 - sum of squares).
    """
    x = F.col(value)
    sums = objects.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    return sums.select(key, F.expr("n * (n - 1) div 2").alias("n_pairs"), ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("products"))


# a block is so many widths long; values are told apart exactly where they are this near, relatively, to one width
BLOCK, EDGE = 4, 1e-6


def _near_pairs(objects: DataFrame, key: str, axis: str, width: float) -> DataFrame:
    """Rows (key, ``n_near``) that add up to the pairs nearer than ``width`` on one axis: one for each distinct finite value of an event."""
    one = objects.where(F.abs(axis) < F.lit(math.inf)).groupBy(key, F.col(axis).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    block = lambda x: F.floor(x / (BLOCK * width))
    own = block(F.col("x"))
    # a value near the end of its block has a guest's place in the next
    blocks = F.array_distinct(F.array(own, block(F.col("x") + width * (1 + EDGE))))
    placed = one.select(key, "x", "n", own.alias("home"), F.explode(blocks).alias("block")).select(key, "block", "x", "n", (F.col("home") < F.col("block")).alias("guest"))
    over = f"OVER (PARTITION BY `{key}`, block ORDER BY x"
    inner, outer = f"{width * (1 - EDGE)!r}D PRECEDING", f"{width * (1 + EDGE)!r}D PRECEDING"
    seen = placed.select(
        key, "x", "n", "guest", F.expr(f"sum(n) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("before"),
        F.expr(f"sum(n) {over} RANGE BETWEEN UNBOUNDED PRECEDING AND {inner})").alias("far"),
        F.expr(f"collect_list(struct(x, n)) {over} RANGE BETWEEN {outer} AND {inner})").alias("edge"))
    back = F.aggregate(F.filter("edge", lambda e: F.col("x") - e["x"] < width), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    partners = F.coalesce("before", F.lit(0)) - F.coalesce("far", F.lit(0)) + back
    return seen.where(~F.col("guest")).select(key, (F.expr("n * (n - 1) div 2") + F.col("n") * partners).alias("n_near"))


def pairs_within(objects: DataFrame, key: str, axis: str, width: float) -> DataFrame:
    """Per event the number of unordered pairs nearer than ``width`` on one axis (``n_near``); events without any value are left out.

    No pair is formed.  Equal values are counted together; then values are sorted within blocks of the axis, where running counts tell
    how many of those before are near.  Blocks are part of the key, so a hot event is spread, and a value stands in two at most.
    """
    return _near_pairs(objects, key, axis, width).groupBy(key).agg(F.sum("n_near").alias("n_near"))


def pair_summary(objects: DataFrame, key: str, value: str, axis: str, width: float) -> DataFrame:
    """``pair_sums`` and ``pairs_within`` of every event side by side, added up in one grouping."""
    v = F.col(value)
    near = _near_pairs(objects, key, axis, width).select(key, F.lit(0).alias("one"), F.lit(0.0).alias("v"), F.lit(0.0).alias("v2"), "n_near")
    rows = objects.select(key, F.lit(1).alias("one"), v.cast("double").alias("v"), (v * v).cast("double").alias("v2"), F.lit(0).cast("long").alias("n_near"))
    sums = rows.unionByName(near).groupBy(key).agg(F.sum("one").alias("n"), F.sum("v").alias("s"), F.sum("v2").alias("q"), F.sum("n_near").alias("n_near"))
    return sums.select(key, F.expr("n * (n - 1) div 2").alias("n_pairs"), ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("products"), "n_near")


def near_counts(objects: DataFrame, others: DataFrame, key: str, cone: float) -> DataFrame:
    """Every object (equal rows once, with ``copies``) with ``n_near``, the others of its event within the cone, and ``n_others``, all of them.

    The mask of a combination reduced over its second side is ``n_near > 0`` for any and ``n_near = n_others`` for all.
    """
    own = _with_copies(objects)
    near = cell_join(own, others.select(key, "eta", "phi"), key, cone, "left")
    near = near.groupBy(*own.columns).agg(F.count("o_dr2").alias("n_near"))
    total = others.groupBy(key).agg(F.count(F.lit(1)).alias("n_others"))
    return near.join(total, key, "left").withColumn("n_others", F.coalesce("n_others", F.lit(0)))


def fiducial_flag(lep: Column, jet: Column, met: Column, met_phi: Column) -> Column:
    """1 inside, 0 outside, -9999 where the event has not the objects to decide.

    ``jet`` are the two leading jets above 30 that are clean of leptons.
    """
    l1, l2, j1, j2 = at(lep, 0), at(lep, 1), at(jet, 0), at(jet, 1)
    ll, jj = P4.of(l1) + P4.of(l2), P4.of(j1) + P4.of(j2)
    third = F.coalesce(at(lep, 2)["pt"], F.lit(-1.0))
    decided = (F.size(lep) >= 2) & (F.coalesce(F.size(jet), F.lit(0)) >= 2) & (l1["pdgId"] * l2["pdgId"] == -11 * 13)
    inside = ((l1["pt"] > 25) & (l2["pt"] > 13) & (third < 10) & (ll.mass() > 12) & (ll.pt() > 30)
              & (j1["pt"] > 30) & (j2["pt"] > 30) & (jj.mass() > 120)
              & (F.abs(j1["eta"]) < 4.7) & (F.abs(j2["eta"]) < 4.7)
              & (F.abs(l1["eta"]) < 2.5) & (F.abs(l2["eta"]) < 2.5)
              & (transverse_mass(ll.pt(), ll.phi(), met, met_phi) >= 60))
    return F.when(decided, F.when(inside, 1).otherwise(0)).otherwise(F.lit(int(MISSING)))
