"""Bin boundaries found from a histogram's content.

The bins of one histogram are a bounded array, folded in order by the SQL aggregate function; many
histograms are processed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from binloom.config import Axis


def _bins(hist: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One row per histogram with its real bins as an array; bins never filled are zero."""
    real = hist.filter(F.col("bin").between(1, size)).groupBy(*keys, "bin").agg(
        F.sum("sumw").alias("w"), F.sum("sumw2").alias("q"))
    filled = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("w", "q"))))
    whole = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda b: F.coalesce(
        F.try_element_at(F.col("filled"), b), F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("q"))))
    return real.groupBy(*keys).agg(filled.alias("filled")).select(*keys, whole.alias("bins"))


def flat_edges(hist: DataFrame, keys: list[str], axis: Axis, nbins: int, min_events: float,
               lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Edges giving about equal content: walking from the right, an edge is set at the centre of the
    bin where the sum reaches total / n, and the sum restarts.

    n is the largest number up to ``nbins`` that leaves at least ``min_events`` per bin.
    """
    edges = axis.edges()
    centres = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
    h = _bins(hist, keys, axis.size)
    total = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["w"])
    h = h.withColumn("total", total)
    fits = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(nbins)), lambda n: F.col("total") / n >= min_events))
    h = h.withColumn("target", F.col("total") / F.coalesce(fits, F.lit(1)))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("edges"))
    steps = F.reverse(F.arrays_zip(F.col("bins").alias("b"), centres.alias("c")))

    def step(acc, x):
        here = acc["sum"] + x["b"]["w"]
        hit = here >= F.col("target")
        return F.struct(F.when(hit, F.lit(0.0)).otherwise(here).alias("sum"),
                        F.when(hit, F.concat(F.array(F.round(x["c"], 3)), acc["edges"])).otherwise(acc["edges"]).alias("edges"))

    found = F.aggregate(steps, start, step, lambda acc: acc["edges"])
    return h.select(*keys, F.concat(F.array(F.lit(lo)), found, F.array(F.lit(hi))).alias("edges"))


def uncertainty_groups(hist: DataFrame, keys: list[str], size: int, max_fraction: float = 0.25) -> DataFrame:
    """New bin number per old bin: neighbours merge, from the left, until the relative statistical
    error is small enough; a remainder joins the last good bin.
    """
    h = _bins(hist, keys, size)
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("q"), F.lit(1).alias("g"), F.array().cast("array<int>").alias("out"))

    def good(w: Column, q: Column) -> Column:
        return (w > 0) & (F.sqrt(q) <= max_fraction * w)

    def step(acc, b):
        w, q = acc["w"] + b["w"], acc["q"] + b["q"]
        done = good(w, q)
        return F.struct(F.when(done, F.lit(0.0)).otherwise(w).alias("w"), F.when(done, F.lit(0.0)).otherwise(q).alias("q"),
                        F.when(done, acc["g"] + 1).otherwise(acc["g"]).alias("g"),
                        F.concat(acc["out"], F.array(acc["g"])).alias("out"))

    def finish(acc):
        # groups that closed are 1 .. g-1; an open one is folded back
        return F.transform(acc["out"], lambda g: F.greatest(F.least(g, acc["g"] - 1), F.lit(1)))

    groups = F.aggregate("bins", start, step, finish)
    return h.select(*keys, F.posexplode(groups).alias("pos", "grp")).select(*keys, (F.col("pos") + 1).alias("bin"), "grp")


def apply_groups(hist: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram with its bins regrouped by the table ``uncertainty_groups`` gives."""
    return hist.join(groups, [*keys, "bin"]).groupBy(*keys, F.col("grp").alias("bin")).agg(
        F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"), F.sum("n").alias("n"))
