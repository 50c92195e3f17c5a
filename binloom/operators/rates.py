"""Rates and efficiencies measured from histograms, and normalisation factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CELL = ["bin", "biny"]
TABLE = ["variable", "variation"]     # rows that differ in these are never added up


def _pick(test: Column, value: str = "sumw") -> Column:
    return F.sum(F.when(test, F.col(value)).otherwise(F.lit(0.0)))


def rate_and_error(tight: Column, loose: Column) -> tuple[Column, Column]:
    """tight / loose with relative error sqrt(1/tight + 1/loose); zero where not defined."""
    rate = F.when(loose > 0, F.try_divide(tight, loose)).otherwise(F.lit(0.0))
    spread = F.sqrt(F.try_divide(F.lit(1.0), tight) + F.try_divide(F.lit(1.0), loose))
    return rate, F.when((loose > 0) & (tight > 0), rate * spread).otherwise(F.lit(0.0))


def fake_rate(hist: DataFrame, loose_cut: str, tight_cut: str, data: str,
              subtract: list[str] | None = None, scales: dict[str, float] | None = None) -> DataFrame:
    """Rate per map cell of each variable and variation, with prompt processes subtracted, and subtraction templates.

    One conditional aggregation over the histogram table gives all scales.  ``scales`` maps a
    template name to the factor on the subtracted processes; a template whose denominator is not
    positive takes the nominal rate.
    """
    subtract, scales = subtract or [], scales or {}
    is_data, is_sub = F.col("sample") == data, F.col("sample").isin(*subtract) if subtract else F.lit(False)
    sums = []
    for side, cut in (("t", tight_cut), ("l", loose_cut)):
        here = F.col("cut") == cut
        sums += [_pick(here & is_data).alias(f"{side}_data"), _pick(here & is_sub).alias(f"{side}_sub")]
    cells = hist.filter(F.col("cut").isin(loose_cut, tight_cut)).groupBy(*TABLE, *CELL).agg(*sums)

    def sides(scale):
        return (F.col("t_data") - scale * F.col("t_sub"), F.col("l_data") - scale * F.col("l_sub"))

    tight, loose = sides(1.0)
    rate, error = rate_and_error(tight, loose)
    out = cells.withColumns({"tight": tight, "loose": loose, "rate": rate, "error": error})
    for name, scale in scales.items():
        t, low = sides(scale)
        safe = F.when(t >= 0, F.try_divide(t, low)).otherwise(F.lit(0.0))
        out = out.withColumn(name, F.when(low > 0, safe).otherwise(F.col("rate")))
    return out.drop("t_data", "t_sub", "l_data", "l_sub")


def own_rate(hist: DataFrame, loose_cut: str, tight_cut: str, by: list[str]) -> DataFrame:
    """tight / loose per variable, variation and cell for every process on its own, in one aggregation."""
    cells = hist.groupBy(*by, *TABLE, *CELL).agg(_pick(F.col("cut") == tight_cut).alias("tight"),
                                         _pick(F.col("cut") == loose_cut).alias("loose"))
    rate, error = rate_and_error(F.col("tight"), F.col("loose"))
    return cells.withColumns({"rate": rate, "error": error})


def efficiency_map(objects: DataFrame, cell: dict[str, Column], passed: Column, weight: Column) -> DataFrame:
    """Weighted passed/all per cell of objects, e.g. flavour x pt x eta, in one aggregation."""
    w = objects.select(*[c.alias(n) for n, c in cell.items()], weight.alias("__w"), passed.alias("__p"))
    return w.groupBy(*cell).agg(
        F.sum(F.when(F.col("__p"), F.col("__w")).otherwise(0.0)).alias("num"), F.sum("__w").alias("den")
    ).withColumn("eff", F.coalesce(F.try_divide("num", "den"), F.lit(0.0)))


def sf_norm_ratio(events: DataFrame, objects: DataFrame, key: str, weight: str, sf: Column, flavour: str,
                  flavours: dict[str, int]) -> DataFrame:
    """sum(w) / sum(w * product of scale factors), overall for all events and per flavour for those that have it.

    Objects are reduced to one row per event with combinable products before the join, so a hot event is one row by then;
    objects with factor 0 are left out, and an event without objects has the factor 1.
    """
    f = objects.withColumn("__sf", sf).filter("__sf != 0")
    prods = [F.product(F.when(F.col(flavour) == code, F.col("__sf")).otherwise(F.lit(1.0))).alias(f"__p_{n}")
             for n, code in flavours.items()]
    seen = [F.max(F.col(flavour) == code).alias(f"__has_{n}") for n, code in flavours.items()]
    per_event = f.groupBy(key).agg(F.product("__sf").alias("__p_all"), *prods, *seen)
    w = F.col(weight)
    rows = [F.struct(F.lit("all").alias("flavour"), w.alias("before"), (w * F.coalesce("__p_all", F.lit(1.0))).alias("after"))]
    rows += [F.when(F.col(f"__has_{n}"), F.struct(F.lit(n).alias("flavour"), w.alias("before"),
                                                   (w * F.col(f"__p_{n}")).alias("after"))) for n in flavours]
    long = events.select(key, weight).join(per_event, key, "left").select(
        F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r"))
    return long.groupBy(F.col("r.flavour").alias("flavour")).agg(
        F.sum("r.before").alias("before"), F.sum("r.after").alias("after")
    ).withColumn("ratio", F.try_divide("before", "after"))


def combine_norm(runs: DataFrame, process: str, dataset: str, weight: str, base: str) -> DataFrame:
    """Factor that lets overlapping datasets of one process act as one.

    The dataset with fewest rows gives the cross-section (its base weight times its sum of
    weights); divided by the sum over all datasets it is the common base weight.  The windows run
    over one row per dataset.
    """
    per = runs.groupBy(process, dataset).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("sumw"),
                                             F.min(base).alias("base"))
    w = Window.partitionBy(process)
    xs = F.min_by(F.col("base") * F.col("sumw"), F.struct("n", dataset)).over(w)
    new_base = F.try_divide(xs, F.sum("sumw").over(w))
    return per.select(process, dataset, "n", "sumw", new_base.alias("new_base"),
                      F.try_divide(new_base, F.col("base")).alias("factor"))


def roc_points(hist: DataFrame, presel: str, cuts: list[str], signal: list[str], background: list[str]) -> DataFrame:
    """Per selection the efficiencies relative to the preselection, for each variable and variation."""
    sums = []
    for i, cut in enumerate([presel, *cuts]):
        for kind, names in (("s", signal), ("b", background)):
            sums.append(_pick((F.col("cut") == cut) & F.col("sample").isin(*names)).alias(f"{kind}{i}"))
    points = [F.struct(F.lit(cut).alias("cut"), F.try_divide(f"s{i}", "s0").alias("sig_eff"),
                       (1.0 - F.try_divide(f"b{i}", "b0")).alias("bkg_rejection"))
              for i, cut in enumerate(cuts, start=1)]
    return hist.groupBy(*TABLE).agg(*sums).select(*TABLE, F.inline(F.array(*points)))


def norm_factors(yields: DataFrame) -> DataFrame:
    """nominal / up and nominal / down per (sample, nuisance) from a yields table."""
    nuis = F.regexp_replace("variation", "(Up|Down)$", "")
    nominal = F.max(F.when(F.col("variation") == "nominal", F.col("yield"))).over(
        Window.partitionBy("sample", "cut", "variable"))

    def side(name):
        return F.sum(F.when(F.col("variation").endswith(name), F.col("yield")))

    var = (yields.withColumns({"nominal": nominal, "nuisance": nuis}).filter("variation RLIKE '(Up|Down)$'")
           .groupBy("sample", "cut", "variable", "nuisance", "nominal").agg(side("Up").alias("up"), side("Down").alias("down")))
    return var.select("sample", "cut", "variable", "nuisance", F.try_divide("nominal", "up").alias("norm_up"),
                      F.try_divide("nominal", "down").alias("norm_down"))
