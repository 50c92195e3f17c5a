"""Per-event products of per-jet factors, on flat jets, and keyed dimension look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from binloom.config import Edges
from binloom.functions.bins import bin_index
from binloom.functions.lookup import BinnedMap
from binloom.functions.weights import tag_factor
from binloom.operators.scratch import Scratch


def fixed_wp_weights(jets: DataFrame, key: str, tagged: Column, sf: dict[int, BinnedMap],
                     eff: dict[int, BinnedMap], want: dict[str, tuple[tuple[int, ...], int]],
                     min_pt: float = 30.0, max_eta: float = 2.5) -> DataFrame:
    """Event weights of a fixed working point, one column per (flavours, error shift) wanted.

    Bin numbers are found once per set of edges, then contents per flavour.  The product is
    combined before the shuffle, so any number of jets per event is fine.
    """
    s = Scratch(jets.filter((F.col("pt") > min_pt) & (F.abs("eta") < max_eta)).withColumn("__tag", tagged))
    bins: dict[tuple, list[Column]] = {}
    for m in [*sf.values(), *eff.values()]:
        edges = (m.x_edges, m.y_edges)
        if edges not in bins:
            bins[edges] = s.put(list(m.bins(F.col("pt"), F.abs("eta"))))

    def content(maps: dict[int, BinnedMap], what: str) -> Column:
        out = F.lit(None).cast("double")
        for f, m in maps.items():
            out = F.when(F.col("flavour") == f, m.at_bins(*bins[m.x_edges, m.y_edges], what)).otherwise(out)
        return out

    value, error, e = s.put([content(sf, "value"), content(sf, "error"), content(eff, "value")])
    products = {}
    for name, (flavours, shift) in want.items():
        factor = tag_factor(F.col("__tag"), value + float(shift) * error if shift else value, e)
        products[name] = F.when(F.col("flavour").isin(*flavours), factor).otherwise(F.lit(1.0))
    made = s.put(list(products.values()))
    return s.df.groupBy(key).agg(*[F.product(c).alias(n) for n, c in zip(products, made)])


def dimension(spark: SparkSession, maps: dict[tuple[str, str, int], tuple[BinnedMap, int]]) -> DataFrame:
    """Rows of all maps keyed by (wp, syst, flavour); a shift adds that many errors."""
    rows = []
    for (wp, syst, flavour), (m, shift) in maps.items():
        rows += [(wp, syst, flavour, ix, iy, v + shift * e) for ix, iy, _, _, _, _, v, e in m.rows()]
    return spark.createDataFrame(rows, "wp string, syst string, flavour int, ix int, iy int, value double")


def keyed_lookup(objects: DataFrame, dim: DataFrame, x: Column, y: Column, x_edges, y_edges,
                 keys: list[str]) -> DataFrame:
    """Equi-join on bin numbers and keys: one row per object and systematic.

    Spark decides how to join from the size of ``dim``; there is no forced broadcast.
    """
    binned = objects.withColumns({"ix": bin_index(x, Edges(x_edges)), "iy": bin_index(y, Edges(y_edges))})
    return binned.join(dim, [*keys, "ix", "iy"])
