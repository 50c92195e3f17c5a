"""Table algebra on histograms.

A histogram table has key columns (sample, cut, variable, variation), ``bin``, ``biny`` and the
additive columns sumw, sumw2, n.  Its size is the number of bins, never the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from binloom.functions.literals import choose, constants

KEYS = ["cut", "variable", "variation"]
ADDITIVE = ["sumw", "sumw2", "n"]


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ADDITIVE]


def merge(parts: DataFrame, over: list[str]) -> DataFrame:
    """Add up histograms of partial productions, dropping the columns they differ in."""
    keys = [c for c in parts.columns if c not in ADDITIVE + over]
    return parts.groupBy(*keys).agg(*_sums())


def fold(hist: DataFrame, size: dict[str, int], mode: int, fold_errors: bool = True) -> DataFrame:
    """Fold a stored table.  ``fold_errors=False`` moves contents but leaves sumw2 in place."""
    nbins = _size_of(size)
    target = F.col("bin")
    if mode & 1:
        target = F.greatest(target, F.lit(1))
    if mode & 2:
        target = F.least(target, nbins)
    keys = [c for c in hist.columns if c not in ADDITIVE + ["bin"]]
    if fold_errors:
        return hist.withColumn("bin", target.cast("int")).groupBy(*keys, "bin").agg(*_sums())
    zero = F.lit(0.0)
    parts = F.array(
        F.struct(target.cast("int").alias("b"), F.col("sumw").alias("w"), zero.alias("q"), F.col("n").alias("m")),
        F.struct(F.col("bin").alias("b"), zero.alias("w"), F.col("sumw2").alias("q"), F.lit(0).cast("long").alias("m")))
    return hist.select(*keys, F.inline(parts)).groupBy(*keys, F.col("b").alias("bin")).agg(
        F.sum("w").alias("sumw"), F.sum("q").alias("sumw2"), F.sum("m").alias("n"))


def _size_of(size: dict[str, int]) -> Column:
    out = None
    for name, n in size.items():
        test = F.col("variable") == name
        out = F.when(test, F.lit(n)) if out is None else out.when(test, F.lit(n))
    return out


def in_range(hist: DataFrame, size: dict[str, int]) -> DataFrame:
    return hist.filter((F.col("bin") >= 1) & (F.col("bin") <= _size_of(size)))


def yields(hist: DataFrame, size: dict[str, int]) -> DataFrame:
    """Integral over the real bins."""
    return in_range(hist, size).groupBy("sample", *KEYS).agg(
        F.sum("sumw").alias("yield"), F.sum("sumw2").alias("yield2"))


def cutflow(df: DataFrame, steps: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """Survivors after each successive selection, all in one aggregation."""
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("all_events")]
    for name, expression in steps:
        passed = passed & F.expr(expression)
        counts.append(F.count_if(passed).alias(name))
    return df.groupBy(*by).agg(*counts)


def combine(hist: DataFrame, terms: dict[str, float], name: str) -> DataFrame:
    """Linear combination of samples: sum c * h, with sumw2 scaled by c squared."""
    c = _coefficient(terms)
    keys = [k for k in hist.columns if k not in ADDITIVE + ["sample"]]
    return (hist.filter(F.col("sample").isin(*terms)).withColumn("c", c).groupBy(*keys).agg(
        F.sum(F.col("c") * F.col("sumw")).alias("sumw"),
        F.sum(F.col("c") * F.col("c") * F.col("sumw2")).alias("sumw2"), F.sum("n").alias("n"))
        .withColumn("sample", F.lit(name)))


def _coefficient(terms: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for s, c in terms.items():
        out = out.when(F.col("sample") == s, F.lit(float(c)))
    return out


def ratio(hist: DataFrame, top: str, bottom: str) -> DataFrame:
    """Bin by bin ``top / bottom`` of two samples; NULL where the divisor is zero."""
    keys = [k for k in hist.columns if k not in ADDITIVE + ["sample"]]

    def pick(s, c):
        return F.sum(F.when(F.col("sample") == s, F.col(c)))

    wide = hist.filter(F.col("sample").isin(top, bottom)).groupBy(*keys).agg(
        pick(top, "sumw").alias("a"), pick(top, "sumw2").alias("a2"),
        pick(bottom, "sumw").alias("b"), pick(bottom, "sumw2").alias("b2"))
    q = F.try_divide(F.col("a"), F.col("b"))
    err = F.sqrt(F.try_divide(F.col("a2") + q * q * F.col("b2"), F.col("b") * F.col("b")))
    return wide.select(*keys, q.alias("ratio"), err.alias("error"))


def quadrature(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def clip_negative(hist: DataFrame) -> DataFrame:
    """Negative bins become empty."""
    return hist.withColumn("sumw", F.greatest(F.col("sumw"), F.lit(0.0)))


def remove_stat(hist: DataFrame, samples: list[str]) -> DataFrame:
    return hist.withColumn("sumw2", F.when(F.col("sample").isin(*samples), F.lit(0.0)).otherwise(F.col("sumw2")))


def unrolled(binx: Column, biny: Column, nx: int) -> Column:
    """Global bin number of a 2-D cell, rows of x after one another (including under/overflow)."""
    return binx + F.lit(nx) * biny


def region_transfer(hist: DataFrame, data: str, subtract: list[str], name: str,
                    cut_map: dict[str, str]) -> DataFrame:
    """Template for each target cut: data minus the subtracted samples in its source cut.

    The cut map is configuration (one entry per region), so it is a literal map in the plan.
    """
    literal = F.create_map(*[F.lit(x) for pair in cut_map.items() for x in pair])
    terms = {data: 1.0, **{s: -1.0 for s in subtract}}
    src = hist.filter(F.col("cut").isin(*cut_map))
    return combine(src, terms, name).withColumn("cut", literal[F.col("cut")])


def varied_transfer(hist: DataFrame, data: str, subtract: list[str], name: str, cut_map: dict[str, str],
                    variations: dict[str, str]) -> DataFrame:
    """The template of :func:`region_transfer` for the nominal and for each varied histogram of the data.

    ``variations`` maps the data's variation to the template's.  What is subtracted is always nominal, so its rows are repeated for
    every variation of the data that the source cut and variable have.  Variations nobody asked for are dropped.
    """
    wanted = {"nominal": "nominal", **variations}
    new = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    varied = (F.col("sample") == data) & F.col("variation").isin(*wanted)
    fixed = F.col("sample").isin(*subtract) & (F.col("variation") == "nominal")
    src = hist.filter(F.col("cut").isin(*cut_map) & (varied | fixed))
    seen = F.collect_set(F.when(varied, F.col("variation"))).over(Window.partitionBy("cut", "variable"))
    each = src.withColumn("__v", F.when(varied, F.array("variation")).otherwise(seen))
    rows = each.select(*[c for c in hist.columns if c != "variation"], F.explode("__v").alias("variation"))
    return region_transfer(rows.withColumn("variation", new[F.col("variation")]), data, subtract, name, cut_map)


def group_map(hist: DataFrame, groups: dict[str, str], name: str = "grp") -> DataFrame:
    """Samples added up into plot groups; samples without a group are dropped."""
    literal = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    keys = [k for k in hist.columns if k not in ADDITIVE + ["sample"]]
    return (hist.withColumn(name, literal[F.col("sample")]).filter(F.col(name).isNotNull())
            .groupBy(*keys, name).agg(*_sums()))


def stack_totals(hist: DataFrame, kind: dict[str, str], size: dict[str, int]) -> DataFrame:
    """Totals per (kind, sample), per kind and overall, in one rollup."""
    literal = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
    rows = in_range(hist, size).withColumn("kind", literal[F.col("sample")]).filter(F.col("kind").isNotNull())
    return rows.rollup("kind", "sample").agg(F.sum("sumw").alias("total"), F.grouping_id().alias("level"))


def cumulative_stack(hist: DataFrame, order: list[str]) -> DataFrame:
    """Running sum over samples in stacking order, per bin (as many rows as samples)."""
    rank = F.array_position(constants(order), F.col("sample"))
    w = (Window.partitionBy(*KEYS, "bin", "biny").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (hist.withColumn("rank", rank.cast("int")).filter("rank > 0")
            .withColumn("stacked", F.sum("sumw").over(w)))


def normalise_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each of ``columns`` divided by their sum over the row; zero rows stay zero."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in columns})


def rebin(hist: DataFrame, groups: list[int]) -> DataFrame:
    """Bins 1..n regrouped: ``groups[i]`` is the new bin of old bin i + 1; outer bins stay outer."""
    top = max(groups) + 1
    target = F.when(F.col("bin") <= 0, F.lit(0)).when(F.col("bin") > len(groups), F.lit(top)).otherwise(
        choose(F.col("bin") - 1, groups))
    keys = [k for k in hist.columns if k not in ADDITIVE + ["bin"]]
    return hist.withColumn("bin", target.cast("int")).groupBy(*keys, "bin").agg(*_sums())


def rebin_to_edges(hist: DataFrame, old: list[float], new: list[float]) -> DataFrame:
    """Content moved to the new bin holding the old bin's centre."""
    centres = [(a + b) / 2 for a, b in zip(old, old[1:])]
    groups = [sum(1 for e in new if e <= c) for c in centres]
    keys = [k for k in hist.columns if k not in ADDITIVE + ["bin"]]
    target = F.when(F.col("bin") <= 0, F.lit(0)).when(F.col("bin") > len(groups), F.lit(len(new))).otherwise(
        choose(F.col("bin") - 1, groups))
    return hist.withColumn("bin", target.cast("int")).groupBy(*keys, "bin").agg(*_sums())
