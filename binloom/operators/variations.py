"""Systematic variations as table operations on filled histograms.

Variation names are ``<nuisance>Up`` / ``<nuisance>Down`` next to ``nominal``; alternatives of one
nuisance are ``<nuisance>_<i>``.  All tables here have as many rows as there are bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN = ["sample", "cut", "variable", "bin", "biny"]


def _is(name: str) -> Column:
    return F.col("variation") == name


def _value(name: str, col: str = "sumw") -> Column:
    return F.coalesce(F.sum(F.when(_is(name), F.col(col))), F.lit(0.0))


def _emit(wide: DataFrame, variants: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long rows from a table with one row per bin."""
    rows = F.array(*[F.struct(F.lit(n).alias("variation"), v.cast("double").alias("sumw"),
                              q.cast("double").alias("sumw2")) for n, (v, q) in variants.items()])
    return wide.select(*BIN, F.inline(rows))


def fallback_to_nominal(hist: DataFrame, wanted: list[str]) -> DataFrame:
    """Every wanted variation for every histogram; those not filled are the nominal copied.

    One pass: a window over the rows of one histogram tells which variations it has.
    """
    have = F.collect_set("variation").over(Window.partitionBy("sample", "cut", "variable"))
    copies = [F.col("variation")] + [
        F.when(_is("nominal") & ~F.array_contains("__have", v), F.lit(v)) for v in wanted]
    return (hist.withColumn("__have", have).withColumn("__v", F.explode(F.array(*copies)))
            .filter("__v IS NOT NULL").withColumn("variation", F.col("__v")).select(*hist.columns))


def envelope(hist: DataFrame, nuisance: str) -> DataFrame:
    """Per bin the largest and smallest content over the alternatives and the nominal."""
    rows = hist.filter(_is("nominal") | F.col("variation").rlike(f"^{nuisance}_[0-9]+$"))
    wide = rows.groupBy(*BIN).agg(F.max("sumw").alias("hi"), F.min("sumw").alias("lo"),
                                  _value("nominal", "sumw2").alias("q"))
    return _emit(wide, {f"{nuisance}Up": (F.col("hi"), F.col("q")), f"{nuisance}Down": (F.col("lo"), F.col("q"))})


def rms(hist: DataFrame, nuisance: str) -> DataFrame:
    """nominal -/+ sqrt(mean((alternative - nominal)^2)), in one aggregation.

    The list per bin holds one value per configured alternative.
    """
    alt = F.col("variation").rlike(f"^{nuisance}_[0-9]+$")
    rows = hist.filter(_is("nominal") | alt)
    values = rows.groupBy(*BIN).agg(
        _value("nominal").alias("nom"), _value("nominal", "sumw2").alias("q"),
        F.collect_list(F.when(alt, F.col("sumw"))).alias("alts"))
    square = F.aggregate("alts", F.lit(0.0), lambda a, x: a + (x - F.col("nom")) * (x - F.col("nom")))
    spread = F.sqrt(F.coalesce(F.try_divide(square, F.size("alts")), F.lit(0.0)))
    wide = values.withColumn("d", spread)
    return _emit(wide, {f"{nuisance}Up": (F.col("nom") + F.col("d"), F.col("q")),
                        f"{nuisance}Down": (F.col("nom") - F.col("d"), F.col("q"))})


def parse_factor(text: str) -> tuple[float, float]:
    """``"u"`` or ``"u/d"``; a single number acts up as u and down as 1/u."""
    parts = [float(p) for p in str(text).split("/")]
    return (parts[0], parts[1]) if len(parts) == 2 else (parts[0], 1.0 / parts[0])


def lnn(yields: DataFrame, nuisances: dict[str, dict[str, str]]) -> DataFrame:
    """Yields with flat up and down factors for every (nuisance, sample) declared."""
    rows = []
    for name, samples in nuisances.items():
        for sample, text in samples.items():
            up, down = parse_factor(text)
            rows.append(F.when(F.col("sample") == sample, F.struct(
                F.lit(name).alias("nuisance"), (F.col("yield") * up).alias("up"), (F.col("yield") * down).alias("down"))))
    return yields.withColumn("r", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull()))).select(
        *[c for c in yields.columns], "r.nuisance", "r.up", "r.down")


def lnn_as_shape(hist: DataFrame, nuisance: str, samples: dict[str, str]) -> DataFrame:
    """Scaled copies of the nominal as the up and down shapes of a flat nuisance."""
    rows = []
    for sample, text in samples.items():
        for side, f in zip(("Up", "Down"), parse_factor(text)):
            rows.append(F.when(F.col("sample") == sample, F.struct(
                F.lit(nuisance + side).alias("variation"), (F.col("sumw") * f).alias("sumw"),
                (F.col("sumw2") * (f * f)).alias("sumw2"))))
    nominal = hist.filter(_is("nominal")).withColumn(
        "r", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())))
    return nominal.select(*BIN, "r.variation", "r.sumw", "r.sumw2")


def shape_as_lnn(yields: DataFrame, nuisance: str, divisor: float = 1.0, symmetrise: bool = False,
                 floor: float = 5.0e-4) -> DataFrame:
    """Flat up/down factors from integrals; NULL where the effect is negligible."""
    keys = ["sample", "cut", "variable"]

    def integral(name):
        return F.coalesce(F.sum(F.when(_is(name), F.col("yield"))), F.lit(0.0))

    wide = yields.groupBy(*keys).agg(integral("nominal").alias("nom"), integral(nuisance + "Up").alias("up"),
                                     integral(nuisance + "Down").alias("down"))

    def shift(c):
        rel = F.try_divide(F.col(c) - F.col("nom"), F.col("nom")) / divisor
        return F.when((F.col("nom") > 0) & (F.col(c) > 0), rel).otherwise(F.lit(0.0))

    up, down = shift("up"), shift("down")
    if symmetrise:
        half = (up - down) * 0.5
        up, down = (
            F.when(half >= 1.0, half * 2.0 - 0.999).when(half <= -1.0, F.lit(-0.999)).otherwise(half),
            F.when(half >= 1.0, F.lit(-0.999)).when(half <= -1.0, -half * 2.0 - 0.999).otherwise(-half))
    fup, fdown = ((F.when(x + 1.0 == 0.0, F.lit(1.0)).otherwise(x + 1.0)) for x in (up, down))
    out = wide.withColumns({"f_up": fup, "f_down": fdown})
    dull = (F.abs(F.col("f_up") - 1.0) < floor) & (F.abs(F.col("f_down") - 1.0) < floor)
    return out.select(*keys, F.when(~dull, F.col("f_up")).alias("f_up"), F.when(~dull, F.col("f_down")).alias("f_down"))


def symmetrise(hist: DataFrame, nuisance: str) -> DataFrame:
    """Both shapes replaced by nominal -/+ half their difference."""
    names = [nuisance + "Up", nuisance + "Down"]
    wide = hist.filter(F.col("variation").isin("nominal", *names)).groupBy(*BIN).agg(
        _value("nominal").alias("nom"), _value("nominal", "sumw2").alias("q"),
        *[_value(n).alias(f"v{i}") for i, n in enumerate(names)])
    half = (F.col("v0") - F.col("v1")) * 0.5
    return _emit(wide, {names[0]: (F.col("nom") + half, F.col("q")), names[1]: (F.col("nom") - half, F.col("q"))})


def scope(hist: DataFrame, declared: DataFrame) -> DataFrame:
    """Keep a variation only where (nuisance, sample, cut) is declared; nominal always stays.

    ``declared`` is configuration: one row per declared combination.
    """
    nuisance = F.regexp_replace("variation", "(Up|Down)$", "")
    known = declared.select("nuisance", "sample", "cut").distinct().withColumn("__ok", F.lit(True))
    tagged = hist.withColumn("nuisance", nuisance).join(known, ["nuisance", "sample", "cut"], "left")
    return tagged.filter(_is("nominal") | F.col("__ok")).select(*hist.columns)


def rate_parameters(yields: DataFrame, params: dict[str, tuple[dict[str, float], tuple[str, ...] | None]]) -> DataFrame:
    """Free-floating samples: name -> ({sample: initial value}, cuts).  Exactly one sample each."""
    rows = []
    for name, (samples, cuts) in params.items():
        if len(samples) != 1:
            raise ValueError(f"rate parameter {name}: exactly one sample, not {len(samples)}")
        (sample, value), = samples.items()
        test = F.col("sample") == sample
        if cuts is not None:
            test = test & F.col("cut").isin(*cuts)
        rows.append(F.when(test, F.struct(F.lit(name).alias("parameter"), F.lit(float(value)).alias("initial"))))
    hit = yields.filter("variation = 'nominal'").withColumn(
        "r", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())))
    return hit.select("r.parameter", "cut", "variable", "sample", "r.initial",
                      (F.col("yield") * F.col("r.initial")).alias("scaled"))


def stat_bin_by_bin(hist: DataFrame, samples: list[str], size: int,
                    correlate: dict[str, list[str]] | None = None) -> DataFrame:
    """Per real bin one nuisance moving that bin by its statistical error.

    ``correlate`` names, per source sample, others whose same bin moves with the source's nuisance.
    """
    owners = F.array(*[
        F.when((F.col("sample") == s) | F.col("sample").isin(*(correlate or {}).get(s, [])), F.lit(s)) for s in samples])
    rows = hist.filter(_is("nominal") & F.col("bin").between(1, size)).withColumn(
        "owner", F.explode(owners)).filter("owner IS NOT NULL")
    name = F.concat_ws("_", F.col("owner"), F.lit("ibin"), F.col("bin").cast("string"), F.lit("stat"))
    err = F.sqrt("sumw2")
    return rows.select(*BIN, name.alias("nuisance"), (F.col("sumw") + err).alias("up"), (F.col("sumw") - err).alias("down"))


def stat_unified(hist: DataFrame, samples: list[str]) -> DataFrame:
    """One nuisance per sample moving all bins together by their errors."""
    err = F.sqrt("sumw2")
    nominal = hist.filter(_is("nominal") & F.col("sample").isin(*samples))
    rows = F.array(*[F.struct(F.concat(F.col("sample"), F.lit("_stat" + side)).alias("variation"), v.alias("sumw"))
                     for side, v in (("Up", F.col("sumw") + err), ("Down", F.col("sumw") - err))])
    return nominal.select(*BIN, "sumw2", F.inline(rows)).select(*BIN, "variation", "sumw", "sumw2")


def stat_auto(hist: DataFrame, threshold: float, samples: list[str]) -> DataFrame:
    """Effective number of events of the summed prediction and which treatment it calls for."""
    tot = hist.filter(_is("nominal") & F.col("sample").isin(*samples)).groupBy("cut", "variable", "bin", "biny").agg(
        F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"))
    n_eff = F.try_divide(F.col("sumw") * F.col("sumw"), F.col("sumw2"))
    return tot.withColumn("n_eff", n_eff).withColumn(
        "treatment", F.when(F.col("n_eff") > threshold, "gauss").otherwise("poisson"))


def linear_template(hist: DataFrame, base: str, other: str, factor: float, nuisance: str) -> DataFrame:
    """Up/down of ``base`` as base -/+ factor * other."""
    wide = hist.filter(_is("nominal") & F.col("sample").isin(base, other)).groupBy("cut", "variable", "bin", "biny").agg(*[
        F.coalesce(F.sum(F.when(F.col("sample") == s, F.col(c))), F.lit(0.0)).alias(f"{n}_{c}")
        for s, n in ((base, "b"), (other, "o")) for c in ("sumw", "sumw2")]).withColumn("sample", F.lit(base))
    q = F.col("b_sumw2") + factor * factor * F.col("o_sumw2")
    return _emit(wide, {nuisance + "Up": (F.col("b_sumw") + factor * F.col("o_sumw"), q),
                        nuisance + "Down": (F.col("b_sumw") - factor * F.col("o_sumw"), q)})


def rename(hist: DataFrame, names: dict[str, str], keep_old: bool = False) -> DataFrame:
    """Variations under new names; with ``keep_old`` the copy stands beside the original."""
    literal = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    side = F.regexp_extract("variation", "(Up|Down)$", 1)
    old = F.regexp_replace("variation", "(Up|Down)$", "")
    new = F.when(_is("nominal"), F.col("variation")).otherwise(F.concat(F.coalesce(literal[old], old), side))
    if not keep_old:
        return hist.withColumn("variation", new)
    both = F.array(F.col("variation"), F.when(~_is("nominal") & literal[old].isNotNull(), new))
    return (hist.withColumn("__v", F.explode(both)).filter("__v IS NOT NULL")
            .withColumn("variation", F.col("__v")).select(*hist.columns))


def decorrelate_by_cut(hist: DataFrame, nuisances: list[str]) -> DataFrame:
    """Listed nuisances get the selection's name appended, so that each selection has its own."""
    old = F.regexp_replace("variation", "(Up|Down)$", "")
    side = F.regexp_extract("variation", "(Up|Down)$", 1)
    return hist.withColumn("variation", F.when(
        old.isin(*nuisances), F.concat(old, F.lit("_"), F.col("cut"), side)).otherwise(F.col("variation")))


def error_band(hist: DataFrame, nuisances: list[str], samples: list[str]) -> DataFrame:
    """Total prediction with its band: statistics and every nuisance's shift in quadrature.

    A nuisance's larger-than-nominal up shape adds to the upper band and its down shape to the
    lower one, and the other way round.
    """
    keys = ["cut", "variable", "bin", "biny"]
    rows = hist.filter(F.col("sample").isin(*samples))
    tot = rows.groupBy(*keys).agg(
        _value("nominal").alias("total"), _value("nominal", "sumw2").alias("stat"),
        *[_value(n + s).alias(f"{n}{s}") for n in nuisances for s in ("Up", "Down")])
    up2, down2 = F.col("stat"), F.col("stat")
    for n in nuisances:
        du, dd = F.col(n + "Up") - F.col("total"), F.col(n + "Down") - F.col("total")
        rises = F.col(n + "Up") > F.col("total")
        up2 = up2 + F.when(rises, du * du).otherwise(dd * dd)
        down2 = down2 + F.when(rises, dd * dd).otherwise(du * du)
    return tot.select(*keys, "total", F.sqrt(up2).alias("err_up"), F.sqrt(down2).alias("err_down"))


def relative_band(band: DataFrame) -> DataFrame:
    return band.withColumns({
        f"rel_{s}": F.when(F.col("total") != 0, F.try_divide(f"err_{s}", "total")).otherwise(F.lit(0.0))
        for s in ("up", "down")})


def compare(hist: DataFrame, nuisance: str, impossible: Column | None = None) -> DataFrame:
    """Nominal, up and down side by side with their ratios; impossible combinations left out."""
    names = ["nominal", nuisance + "Up", nuisance + "Down"]
    rows = hist.filter(F.col("variation").isin(*names))
    if impossible is not None:
        rows = rows.filter(~impossible)
    wide = rows.groupBy(*BIN).agg(*[_value(n).alias(a) for n, a in zip(names, ("nominal", "up", "down"))])
    return wide.withColumns({"ratio_up": F.try_divide("up", "nominal"), "ratio_down": F.try_divide("down", "nominal")})


def norm_preserving_yields(df: DataFrame, value: str, weight: str, norms: DataFrame, keys: list[str]) -> DataFrame:
    """Yields ``nominal``, ``up`` and ``down`` per key of the factors in ``norm_preserving``.

    The factors are linear in ``value``, so the events are summed first and only the sums meet the few rows of ``norms``.
    """
    w, v = F.col(weight), F.col(value)
    sums = df.groupBy(*keys).agg(F.sum(w).alias("nominal"), F.sum(w * v).alias("__up"), F.sum(w * (2.0 - v)).alias("__down"))
    out = sums.join(norms, keys, "left")
    return out.select(*keys, "nominal", (F.col("__up") * F.col("norm_up")).alias("up"), (F.col("__down") * F.col("norm_down")).alias("down"))


def norm_preserving(df: DataFrame, value: str, norms: DataFrame, keys: list[str]) -> DataFrame:
    """Weight factors up = v * norm_up and down = (2 - v) * norm_down.

    ``norms`` comes from ``rates.norm_factors``: one row per configured combination.
    """
    return df.join(norms, keys, "left").withColumns({
        f"{value}_up": F.col(value) * F.col("norm_up"),
        f"{value}_down": (F.lit(2.0) - F.col(value)) * F.col("norm_down")})
