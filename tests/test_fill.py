"""Properties of the fused fill and of the table algebra behind it."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from binloom import Alias, Analysis, Cut, Edges, Nuisance, Sample, Uniform, Variable, fill
from binloom.functions.bins import bin_index, folded
from binloom.operators import histops, variations as V
from binloom.operators.define import branches, define, names_in, process_cases, redefine, rename_in, second_name

AXIS = Uniform(5, 0.0, 10.0)
ALL = [Cut("all", "true")]


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(1)
    n = 500
    pdf = pd.DataFrame({
        "x": rng.normal(5, 4, n), "y": rng.uniform(-1, 1, n), "weight": rng.choice([-0.5, 0.0, 1.0, 2.0], n),
        "sample": rng.choice(["DATA", "SIG", "BKG"], n), "part": rng.integers(0, 3, n)})
    pdf["x_up"], pdf["x_do"] = pdf.x * 1.1, pdf.x * 0.9
    return spark.createDataFrame(pdf).cache()


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_matches_numpy(events):
    got = {(r["sample"], r["bin"]): (r["sumw"], r["sumw2"], r["n"]) for r in fill(events, ALL, [Variable("x", "x", AXIS)]).collect()}
    pdf = events.toPandas()
    pdf["bin"] = np.digitize(pdf.x, np.linspace(0, 10, 6))
    want = pdf.assign(w2=pdf.weight ** 2).groupby(["sample", "bin"]).agg(s=("weight", "sum"), q=("w2", "sum"), n=("x", "size"))
    assert got == {k: (v.s, v.q, v.n) for k, v in want.iterrows()}


def test_total_equals_weighted_count(events):
    total = fill(events, ALL, [Variable("x", "x", AXIS)]).agg(F.sum("sumw"), F.sum("n")).first()
    assert total[0] == events.agg(F.sum("weight")).first()[0] and total[1] == 500


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_fold_conserves_and_agrees_with_stored_fold(events, mode):
    direct = fill(events, ALL, [Variable("x", "x", AXIS, fold=mode)])
    stored = histops.fold(fill(events, ALL, [Variable("x", "x", AXIS)]), {"x": 5}, mode)
    assert rows(direct, "sample", "bin", "sumw", "sumw2", "n") == rows(stored, "sample", "bin", "sumw", "sumw2", "n")
    bins = {r["bin"] for r in direct.collect()}
    assert (0 in bins) == (not mode & 1) and (6 in bins) == (not mode & 2)


def test_fold_without_errors_keeps_sumw2(events):
    raw = fill(events, ALL, [Variable("x", "x", AXIS)])
    out = histops.fold(raw, {"x": 5}, 3, fold_errors=False)
    q = {(r["sample"], r["bin"]): r["sumw2"] for r in raw.collect()}
    for r in out.collect():
        assert r["sumw2"] == q.get((r["sample"], r["bin"]), 0.0)
    assert out.agg(F.sum("sumw")).first() == raw.agg(F.sum("sumw")).first()


def test_merge_is_associative(events):
    by_part = fill(events, ALL, [Variable("x", "x", AXIS)], by=["sample", "part"])
    assert rows(histops.merge(by_part, ["part"])) == rows(
        fill(events, ALL, [Variable("x", "x", AXIS)]).select(histops.merge(by_part, ["part"]).columns))


def test_partition_count_does_not_matter(events):
    v = [Variable("x", "x", AXIS)]
    assert rows(fill(events.repartition(1), ALL, v)) == rows(fill(events.repartition(13), ALL, v))


def test_equal_selections_and_variables_under_two_names(events):
    cuts = [Cut("a", "y > 0"), Cut("b", "y > 0"), Cut("c", "y <= 0")]
    vs = [Variable("u", "x", AXIS), Variable("v", "x", AXIS), Variable("w", "y", Uniform(2, -1.0, 1.0), cuts=("c",))]
    h = fill(events, cuts, vs).groupBy("cut", "variable").agg(F.sum("n").alias("n")).collect()
    got = {(r["cut"], r["variable"]): r["n"] for r in h}
    up = events.filter("y > 0").count()
    assert got == {**{(c, v): up for c in "ab" for v in "uv"}, **{("c", v): 500 - up for v in "uvw"}}


def test_many_selections_agree_with_one_by_one(events):
    cuts = [Cut(f"c{i}", f"x > {i}", {"p": "y > 0", "m": "y < 0"}) for i in range(12)]
    vs = [Variable(f"v{j}", f"x * {j + 1}", Uniform(4, 0.0, 10.0 * (j + 1))) for j in range(6)]
    wide = fill(events, cuts, vs).filter("cut = 'c5_m' AND variable = 'v3'")
    alone = fill(events.filter("x > 5 AND y < 0"), [Cut("c5_m", "true")], [vs[3]])
    assert rows(wide) == rows(alone)


def test_two_dimensional(events):
    h = fill(events, ALL, [Variable("xy", "x", AXIS, "y", Uniform(2, -1.0, 1.0))])
    assert h.agg(F.sum("sumw")).first()[0] == events.agg(F.sum("weight")).first()[0]
    assert {r["biny"] for r in h.collect()} == {1, 2}


def test_factor_one_equals_nominal(events):
    h = fill(events, ALL, [Variable("x", "x", AXIS)], factors={"oneUp": "1D"})
    cols = ("sample", "bin", "sumw", "sumw2", "n")
    assert rows(h.filter("variation = 'oneUp'"), *cols) == rows(h.filter("variation = 'nominal'"), *cols)


def test_shape_variation_reaches_selection_alias_and_preselection(events):
    run = Analysis(aliases=[Alias("twice", "x * 2")], cuts=[Cut("high", "twice > 8")],
                   variables=[Variable("x", "x", AXIS), Variable("y", "y", Uniform(2, -1.0, 1.0))],
                   nuisances=[Nuisance("scale", "suffix", "up", "do")], preselection="x > 1")
    h = run.histograms(events)
    pdf = events.toPandas()
    for label, col in (("nominal", "x"), ("scaleUp", "x_up"), ("scaleDown", "x_do")):
        sel = pdf[(pdf[col] > 1) & (pdf[col] * 2 > 8) & (pdf.weight != 0)]
        got = h.filter((F.col("variation") == label) & (F.col("variable") == "y")).agg(F.sum("n")).first()[0]
        assert got == len(sel)


def test_up_and_down_swap(events):
    def run(up, down):
        a = Analysis(cuts=ALL, variables=[Variable("x", "x", AXIS)], nuisances=[Nuisance("s", "suffix", up, down)])
        return a.histograms(events)
    cols = ("sample", "bin", "sumw")
    assert rows(run("up", "do").filter("variation = 'sUp'"), *cols) == rows(run("do", "up").filter("variation = 'sDown'"), *cols)


def test_shape_variation_reaches_weight_and_process(spark):
    df = spark.createDataFrame([(10.0, 20.0, 5.0)] * 2, "pt double, pt_up double, pt_do double")
    run = Analysis(samples=[Sample("SIG", weight="pt / 10"), Sample("BKG", "pt > 8", weight="pt / 5")], cuts=ALL,
                   variables=[Variable("one", "1D", AXIS)], nuisances=[Nuisance("s", "suffix", "up", "do")])
    got = {(r["sample"], r["variation"]): r["sumw"] for r in run.histograms(df).collect()}
    assert got == {("SIG", "nominal"): 2.0, ("SIG", "sUp"): 4.0, ("SIG", "sDown"): 1.0, ("BKG", "nominal"): 4.0, ("BKG", "sUp"): 8.0}


def test_given_weight_and_process_columns_are_kept_for_variations(spark):
    df = spark.createDataFrame([("a", 6.0, 10.0, 3.0), ("b", 9.0, 10.0, 3.0)],
                               "sample string, pt double, pt_up double, weight double").withColumn("pt_do", F.col("pt"))
    run = Analysis(samples=[Sample("A", "sample = 'a' AND pt > 8", weight="weight * pt")], cuts=ALL,
                   variables=[Variable("one", "1D", AXIS)], nuisances=[Nuisance("s", "suffix", "up", "do")])
    assert rows(run.histograms(df), "sample", "variation", "sumw") == [("A", "sUp", 30.0)]


def test_untouched_histograms_get_no_variation(events):
    run = Analysis(cuts=ALL, variables=[Variable("y", "y", AXIS)], nuisances=[Nuisance("s", "suffix", "up", "do")])
    assert {r["variation"] for r in run.histograms(events).collect()} == {"nominal"}


def test_variation_without_columns_is_an_error(events):
    run = Analysis(cuts=ALL, variables=[Variable("x", "x", AXIS)], nuisances=[Nuisance("s", "suffix", "no", "no")])
    with pytest.raises(ValueError, match="no column"):
        run.histograms(events)


def test_disjoint_subsamples_partition_their_parent(events):
    raw = events.withColumnRenamed("sample", "s0").drop("weight")
    whole = Analysis(samples=[Sample("S", "s0 = 'SIG'")]).events(raw)
    split = Analysis(samples=[Sample("S", "s0 = 'SIG'", subsamples={"a": "y < 0", "b": "y >= 0"})]).events(raw)
    assert whole.count() == split.count() and {r[0] for r in split.select("sample").distinct().collect()} == {"S_a", "S_b"}


def test_not_a_number_overflows_and_null_has_no_bin(spark):
    df = spark.sql("SELECT x FROM VALUES (double('nan')), (CAST(NULL AS double)), (-1D), (10D), (9.99D) AS t(x)")
    for axis in (AXIS, Edges(AXIS.edges())):
        got = [r[0] for r in df.select(bin_index(F.col("x"), axis)).collect()]
        assert got == [6, None, 0, 6, 5]
    assert [r[0] for r in df.select(folded(bin_index(F.col("x"), AXIS), 5, 3)).collect()] == [5, None, 1, 5, 5]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-20, 20), min_size=1, max_size=40))
def test_uniform_and_explicit_edges_agree_away_from_edges(spark, xs):
    axis = Uniform(4, 0.0, 8.0)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(bin_index(F.col("x"), axis).alias("a"), bin_index(F.col("x"), Edges(axis.edges())).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_definitions(events):
    with pytest.raises(ValueError):
        define(events, [Alias("x", "x + 1")])
    assert define(events, [Alias("x", "x")]).columns == events.columns
    assert redefine(events, "x", "x + 1").agg(F.sum(F.col("x"))).first()[0] == pytest.approx(
        events.agg(F.sum("x")).first()[0] + 500)
    assert second_name(events, "z", "x").filter("z != x").count() == 0
    with pytest.raises(ValueError):
        redefine(events, "none", "1")
    assert branches(events, {"a": "x + y"}).columns == ["a"]


def test_names_are_words_outside_quotes():
    assert names_in("a > 1 AND b = 'c d' AND s.t = 2") == {"a", "AND", "b", "s"}
    assert rename_in("x + xx + 'x' + s.x", {"x": "x_up"}) == "x_up + xx + 'x' + s.x"


def test_same_names_are_refused():
    with pytest.raises(ValueError):
        process_cases([Sample("A"), Sample("A")])
    with pytest.raises(ValueError):
        Edges([1.0, 1.0])


def test_rate_parameter_needs_one_sample(events):
    y = histops.yields(fill(events, ALL, [Variable("x", "x", AXIS)]), {"x": 5})
    with pytest.raises(ValueError):
        V.rate_parameters(y, {"p": ({"SIG": 1.0, "BKG": 1.0}, None)})


def test_symmetrised_shapes_straddle_nominal(events):
    run = Analysis(cuts=ALL, variables=[Variable("x", "x", AXIS)], nuisances=[Nuisance("s", "suffix", "up", "do")])
    h = run.histograms(events)
    nominal = {(r["sample"], r["bin"]): r["sumw"] for r in h.filter("variation = 'nominal'").collect()}
    sums = V.symmetrise(h, "s").groupBy("sample", "bin").agg((F.sum("sumw") / 2).alias("m")).collect()
    assert all(r["m"] == pytest.approx(nominal.get((r["sample"], r["bin"]), 0.0)) for r in sums)
