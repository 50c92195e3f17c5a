"""Joins under skew, ordered operators, weights and models against brute force."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from check import compare, duck
from binloom.functions import arrays as A, kinematics as K, select as S, weights as W
from binloom.functions.lookup import BinnedMap, Curve, map_from_rows
from binloom.functions.poisson import interval
from binloom.operators import cards, histops, joins, ordered, quality, resample, reweight, scoring, tagging
from binloom.operators.collect import leading_collections, rank_objects


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows belong to one key."""
    rng = np.random.default_rng(2)
    key = np.where(rng.random(2000) < 0.5, 7, rng.integers(0, 400, 2000))
    return spark.createDataFrame(pd.DataFrame({"key": key, "id": np.arange(2000), "pt": rng.uniform(0, 100, 2000)})).cache()


def test_heavy_keys_are_found(skewed):
    assert joins.heavy_keys(skewed, "key", share=0.1, sample=1.0, min_rows=100) == [7]
    assert joins.heavy_keys(skewed, "key", share=0.1, sample=1.0) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    one = spark.createDataFrame([(k, k * 2) for k in range(0, 300)], "key long, v long")
    salted = joins.skew_safe_join(skewed, one, "key", how, heavy=[7], spread=8)
    plain = skewed.join(one, "key", how)
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_salted_join_spreads_the_heavy_key(spark, skewed):
    one = spark.createDataFrame([(k, k * 2) for k in range(0, 400)], "key long, v long")
    hot = F.col("key").isin(7)
    salt = F.pmod(F.xxhash64("id", "pt"), F.lit(8))
    sizes = [r["count"] for r in skewed.filter(hot).groupBy(salt.alias("s")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * sum(sizes)
    assert joins.skew_safe_join(skewed, one, "key", heavy=[7]).count() == 2000
    with pytest.raises(ValueError):
        joins.skew_safe_join(skewed, one, "key", "full")


def test_friend_must_not_repeat_columns(spark, skewed):
    with pytest.raises(ValueError):
        joins.friend_join(skewed, skewed, ["key"])


def test_ranking_limits_before_the_shuffle(skewed):
    ranked = rank_objects(skewed, ["key"], ["-pt", "id"], 3)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    pdf = skewed.toPandas().sort_values(["pt", "id"], ascending=[False, True]).groupby("key").head(3)
    assert sorted(r["id"] for r in ranked.collect()) == sorted(pdf.id)


def test_collections_are_bounded_and_ordered(skewed):
    tagged = skewed.withColumn("kind", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    got = leading_collections(tagged, "key", "kind", ["-pt", "id"], ["pt"], {"a": ("xs", 2), "b": ("ys", 3)}).collect()
    for r in got:
        assert len(r["xs"]) <= 2 and len(r["ys"]) <= 3
        assert [o["pt"] for o in r["ys"]] == sorted((o["pt"] for o in r["ys"]), reverse=True)


@pytest.mark.parametrize("cone", [0.3, 0.4, 3.0])
def test_cleaning_sees_every_object_of_an_event(spark, cone):
    rng = np.random.default_rng(3)
    eta, phi = rng.uniform(-400 * cone ** 2, 400 * cone ** 2, (2, 1000)), rng.uniform(-np.pi, np.pi, (2, 1000))
    eta[:, :2], phi[:, :2] = 0.0, [[np.pi, 0.5], [-np.pi, 0.5]]
    flat = [spark.createDataFrame([(1, i, float(e), float(p)) for i, (e, p) in enumerate(zip(eta[k], phi[k]))] + [(2 + k, -1, 0.0, 0.0)],
                                  "event int, i int, eta double, phi double") for k in (0, 1)]
    dp = np.abs(phi[0][:, None] - phi[1][None, :])
    near = (eta[0][:, None] - eta[1][None, :]) ** 2 + np.minimum(dp, 2 * np.pi - dp) ** 2 < cone * cone
    want = [-1, *np.flatnonzero(~near.any(1)).tolist()]
    assert 2 < len(want) < 1000 and 0 not in want and 1 not in want
    assert sorted(r["i"] for r in joins.clean_objects(*flat, "event", cone).collect()) == want


@pytest.mark.parametrize("down", [False, True])
def test_running_sums(spark, skewed, down):
    df = skewed.withColumn("v", F.floor(F.col("pt")).cast("double"))
    got = {r["v"]: (r["n"], r["n_run"]) for r in ordered.running_sums(df, "v", {"n": F.lit(1)}, down, bucket_rows=3).collect()}
    counts = Counter(r["v"] for r in df.collect())
    total = 0
    for v in sorted(counts, reverse=down):
        total += counts[v]
        assert got[v] == (counts[v], total)


@pytest.mark.parametrize("n", [0, 1, 137, 2000, 5000])
def test_first_n_by_hash_is_exact(skewed, n):
    ids = [r["id"] for r in ordered.first_n_by_hash(skewed, "id", n, bucket_rows=5).collect()]
    assert len(ids) == min(n, 2000) == len(set(ids))


def test_hash_percent_is_even(skewed):
    share = skewed.filter(ordered.hash_percent(F.col("id")) < 80).count() / 2000
    assert 0.75 < share < 0.85


FLAT = (0.0, 100.0), (0.0, 3.0)


def one_cell(v, e=0.0):
    return BinnedMap(*FLAT, ((v,),), ((e,),))


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, [(30.0, 1.0, a, s1), (20.0, -1.0, b, s2)]) for i, (a, b, s1, s2) in enumerate(
        (a, b, s1, s2) for a in (11, -13) for b in (13, -11) for s1 in (0.9, 0.1) for s2 in (0.9, 0.1))]
    return spark.createDataFrame(rows, "event int, lep array<struct<pt:double,eta:double,pdgId:int,score:double>>")


def tight(n):
    return [F.get("lep", F.lit(i))["score"] > 0.5 for i in range(n)]


def test_fake_weight_with_certain_prompts(pairs):
    """With prompt rate one, only loose leptons count, each with f / (1 - f)."""
    f = {11: 0.2, 13: 0.3}
    out = reweight.fake_weights(pairs, "lep", tight(2), {k: one_cell(1.0) for k in f},
                                {"w": ({k: one_cell(v) for k, v in f.items()}, {})})
    for r in out.collect():
        loose = [f[abs(o["pdgId"])] / (1 - f[abs(o["pdgId"])]) for o in r["lep"] if o["score"] < 0.5]
        want = {0: 0.0, 1: sum(loose), 2: -math.prod(loose) if len(loose) == 2 else 0.0}[len(loose)]
        assert r["w"] == pytest.approx(want)


def test_charge_flip_rules(pairs):
    out = reweight.charge_flip(pairs, "lep", BinnedMap((0.0, 3.0), (0.0, 300.0), ((0.1,),)), BinnedMap((0.0, 3.0), (0.0, 300.0), ((0.02,),)))
    for r in out.collect():
        n = sum(abs(o["pdgId"]) == 11 for o in r["lep"])
        assert r["flip"] == pytest.approx({0: 1.0, 1: 0.1, 2: 0.18}[n])
        assert r["flip_err"] == pytest.approx({0: 0.0, 1: 0.02, 2: math.sqrt(2) * 0.8 * 0.02}[n])
    with pytest.raises(ValueError):
        reweight.charge_flip(pairs, "lep", one_cell(0.1), one_cell(0.1), 3)


def test_fake_signs_for_many_leptons(spark):
    """The general sign rule gives the inclusion-exclusion sum for four leptons too."""
    p, f = 0.9, 0.2
    df = spark.createDataFrame([(i, [bool(i >> b & 1) for b in range(4)]) for i in range(16)], "i int, t array<boolean>")
    t = [F.get("t", F.lit(k)) for k in range(4)]
    probs = [W.tight_loose_probability(F.lit(p), F.lit(f), x) for x in t]
    got = df.select("t", W.fake_combination([a for a, _ in probs], [b for _, b in probs], t).alias("w")).collect()
    for r in got:
        total = 0.0
        n_loose = sum(not x for x in r["t"])
        for pick in range(1, 16):
            k = bin(pick).count("1")
            term = 1.0
            for b, x in enumerate(r["t"]):
                fake = pick >> b & 1
                num = (f * (1 - p) if x else f * p) if fake else (p * (1 - f) if x else p * f)
                term *= num / (p - f)
            total += term if (k + n_loose) % 2 == 0 else -term
        assert r["w"] == pytest.approx(total)


def test_poisson_interval_values():
    got = interval(pd.Series([0, 1, 10, 100, 250_000]))
    assert got.low.tolist()[:3] == pytest.approx([0.0, 0.1728, 6.8914], abs=2e-3)
    assert got.high.tolist()[:3] == pytest.approx([1.8410, 3.2995, 14.2669], abs=2e-3)
    assert got.high[4] - 250_000 == pytest.approx(500.5, abs=0.6)


def test_map_outside_is_zero_and_large_maps_join(spark):
    m = BinnedMap((0.0, 1.0, 2.0), (0.0, 1.0), ((0.5, 0.7),), ((0.1, 0.2),))
    df = spark.createDataFrame([(0.5, 0.5), (1.0, 0.0), (2.0, 0.5), (0.5, -1.0)], "x double, y double")
    assert [r[0] for r in df.select(m.value(F.col("x"), F.col("y"))).collect()] == [0.5, 0.7, 0.0, 0.0]
    wide = tuple(float(i) for i in range(120))
    big = BinnedMap(wide, wide, tuple(tuple(float(i * 1000 + j) for i in range(119)) for j in range(119)))
    got = big.attach(df, F.col("x") + 100, F.col("y") + 50, "v", "e")
    assert {r["x"]: r["v"] for r in got.filter("y >= 0").collect()} == {0.5: 100050.0, 1.0: 101050.0, 2.0: 102050.0}
    with pytest.raises(ValueError):
        big.value(F.col("x"), F.col("y"))
    with pytest.raises(ValueError):
        map_from_rows(m.table(spark).unionByName(m.table(spark)), m.x_edges, m.y_edges)
    again = map_from_rows(m.table(spark), m.x_edges, m.y_edges)
    assert again == m


def test_curve(spark):
    c = Curve((0.0, 10.0, 20.0), (1.0, 2.0, 0.0))
    df = spark.sql("SELECT x FROM VALUES (-5D), (5D), (10D), (15D), (25D), (CAST(NULL AS double)) AS t(x)")
    assert [r[0] for r in df.select(c.at(F.col("x"))).collect()][:5] == [1.0, 1.5, 2.0, 1.0, 0.0]
    assert [r[0] for r in df.select(c.at(F.col("x"), clamp=False, outside=-1.0)).collect()] == [-1.0, 1.5, 2.0, 1.0, -1.0, -1.0]


def test_erf_approximation(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-30, 31)], "x double")
    for r in df.select("x", K.erf(F.col("x")).alias("e"), K.gaussian(F.col("x"), 0.5, 2.0).alias("g")).collect():
        assert r["e"] == pytest.approx(math.erf(r["x"]), abs=2e-7)
        assert r["g"] == pytest.approx(math.exp(-0.5 * ((r["x"] - 0.5) / 2) ** 2))


def test_tag_factor_and_shape_gating(spark):
    df = spark.sql("SELECT tag, eff FROM VALUES (true, 0.7D), (false, 0.7D), (false, 1D) AS t(tag, eff)")
    got = [r[0] for r in df.select(W.tag_factor(F.col("tag"), F.lit(0.9), F.col("eff"))).collect()]
    assert got == pytest.approx([0.9, (1 - 0.63) / 0.3, 1.0])
    jets = spark.sql("SELECT f FROM VALUES (0), (4), (5) AS t(f)")
    for syst, want in (("central", [2, 2, 2]), ("up_jes", [2, 1, 1]), ("up_cferr1", [1, 2, 1]), ("up_hf", [2, 1, 2])):
        got = [r[0] for r in jets.select(W.shape_sf(syst, F.lit(2.0), F.col("f"), F.lit(0.0), F.lit(50.0), F.lit(0.5))).collect()]
        assert got == want, syst


def test_unroll_edges_belong_to_no_cell(spark):
    e = (0.0, 0.5, 1.0)
    df = spark.sql("SELECT x, y FROM VALUES (0.1D, 0.1D), (0.1D, 0.9D), (0.9D, 0.1D), (0.9D, 0.9D), (0.5D, 0.1D), (0D, 0.1D) AS t(x, y)")
    assert [r[0] for r in df.select(S.unroll2d(F.col("x"), F.col("y"), e, e)).collect()] == [1, 2, 3, 4, 0, 0]


def test_element_default_ignores_negative_index(spark):
    df = spark.sql("SELECT array(1D, 2D) AS a")
    got = df.select(A.alt(F.col("a"), -1, 9.0), A.alt(F.col("a"), 1, 9.0), A.alt(F.col("a"), 2, 9.0)).first()
    assert tuple(got) == (9.0, 2.0, 9.0)


def test_dense_scores_match_numpy(spark):
    rng = np.random.default_rng(3)
    net = scoring.Dense(((rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 2)), rng.normal(size=2))))
    x = rng.normal(size=(20, 3))
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(20, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    got = {r["i"]: r["s"] for r in scoring.dense_scores(df, ["a", "b", "c"], net, "s").collect()}
    hidden = np.maximum(x @ net.layers[0][0] + net.layers[0][1], 0) @ net.layers[1][0] + net.layers[1][1]
    want = np.exp(hidden) / np.exp(hidden).sum(axis=1, keepdims=True)
    assert got[20] is None and np.allclose([got[i] for i in range(20)], want)


def test_forest_sentinel(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 2), None if i == 0 else float(i % 2)) for i in range(60)], "i int, c int, y double, x double")
    model = scoring.forest_train(df, ["x"], "y", trees=2, depth=2)
    got = {r["i"]: r["p"] for r in scoring.forest_scores(df, F.col("c"), {0: (model, ["x"]), 1: (model, ["x"])}, 2, "p").collect()}
    assert got[0] == [-99.9, -99.9] and got[2] == [-99.9, -99.9]
    assert got[3][1] > 0.5 and sum(got[3]) == pytest.approx(1.0)


def test_forests_stand_side_by_side_in_one_scan(spark, tmp_path):
    rows = [(i, i % 4, float(i % 2), float(i % 2), float(i // 2 % 2)) for i in range(80)] + [(80, None, 0.0, 0.0, 0.0)]
    spark.createDataFrame(rows, "i int, c int, y double, a double, b double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    one, two = (scoring.forest_train(df, f, "y", trees=3, depth=2) for f in (["a"], ["b", "a"]))
    out = scoring.forest_scores(df, F.col("c"), {0: (one, ["a"]), 3: (two, ["b", "a"])}, 2, "p")
    assert out.columns == [*df.columns, "p"] and out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r["i"]: r["p"] for r in out.collect()}
    assert len(got) == 81 and got[80] == [-99.9, -99.9] and got[1] == [-99.9, -99.9]
    assert got[0][0] > 0.5 and got[3][1] > 0.5


def test_varied_transfer(spark):
    rows = [("DATA", "nominal", 1, 10.0, 12.0, 5), ("DATA", "effUp", 1, 11.0, 13.0, 5), ("DATA", "effUp", 2, 2.0, 2.0, 1), ("DATA", "otherUp", 1, 99.0, 1.0, 1),
            ("BKG", "nominal", 1, 4.0, 1.0, 3), ("BKG", "nominal", 3, 1.0, 0.5, 2), ("BKG", "effUp", 1, 77.0, 1.0, 1), ("SIG", "nominal", 1, 7.0, 1.0, 1)]
    table = spark.createDataFrame([(s, "os", "m", v, b, 0, w, w2, n) for s, v, b, w, w2, n in rows],
                                  "sample string, cut string, variable string, variation string, bin int, biny int, sumw double, sumw2 double, n long")
    other = table.withColumn("cut", F.lit("elsewhere"))      # a cut that no target asks for
    out = histops.varied_transfer(table.unionByName(other), "DATA", ["BKG"], "flip", {"os": "ss"}, {"effUp": "flipUp", "effDown": "flipDown"})
    got = {(r["variation"], r["bin"]): (r["sumw"], r["sumw2"], r["n"]) for r in out.collect()}
    assert got == {("nominal", 1): (6.0, 13.0, 8), ("nominal", 3): (-1.0, 0.5, 2), ("flipUp", 1): (7.0, 14.0, 8), ("flipUp", 2): (2.0, 2.0, 1),
                   ("flipUp", 3): (-1.0, 0.5, 2)}
    assert {(r["cut"], r["sample"]) for r in out.collect()} == {("ss", "flip")}


def test_cards_without_alternative_signals(spark):
    rows = [(0, "data", 0, 1), (1, "b1", 0, 0), (2, "s1", 1, 0), (3, "b2", 0, 0), (4, "s2", 1, 0)]
    table = spark.createDataFrame(rows, "key int, sample string, is_signal int, is_data int")
    got = [tuple(r) for r in cards.card_processes(table, "key").orderBy("position").select("card", "sample", "process_id", "position").collect()]
    assert got == [("", "s1", 0, 0), ("", "s2", -1, 1), ("", "b1", 1, 2), ("", "b2", 2, 3)]


def drawn(df, **options):
    return {r["id"]: r["copies"] for r in resample.bootstrap(df, "id", "w", 0.7, seed=1, **options).collect()}


def test_bootstrap_draws_exactly_and_by_weight(spark):
    df = spark.createDataFrame([(i, 1000.0 if i == 5 else 1.0 + i % 3) for i in range(1, 1001)], "id long, w double")
    copies = drawn(df)
    assert sum(copies.values()) == 700
    share = 1000 / (1000 + sum(1.0 + i % 3 for i in range(1, 1001) if i != 5))
    assert abs(copies[5] - 700 * share) < 5 * math.sqrt(700 * share)


def test_bootstrap_is_one_draw_however_rows_are_dealt(spark):
    """Three levels of the tree; partitions and batches do not matter."""
    df = spark.createDataFrame([(i, 0.1 * (1 + i % 7), "x" if i % 3 else None) for i in range(20_000)], "id long, w double, s string")
    first = drawn(df.repartition(3), leaf_rows=2)
    assert sum(first.values()) == 14_000
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        assert drawn(df.repartition(16, "w"), leaf_rows=2) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])
    by = {k: sum(n for i, n in first.items() if i % 7 == k) for k in range(7)}
    for k, n in by.items():
        p = (1 + k) / 28
        assert abs(n - 14_000 * p) < 5 * math.sqrt(14_000 * p)


def test_bootstrap_of_equal_rows_and_of_none(spark):
    df = spark.createDataFrame([(1, 2.0)] * 600 + [(i, 0.0) for i in range(2, 302)] + [(400, 1200.0)] * 1, "id long, w double")
    copies = drawn(df)
    assert set(copies) == {1, 400} and sum(copies.values()) == int(0.7 * 901)
    assert drawn(df.limit(0)) == {} and drawn(df.where("w = 0")) == {}


def test_duplicates_and_missing(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, c string")
    assert [tuple(r) for r in quality.duplicates(a, ["k"]).collect()] == [(1, 2)]
    exp = spark.createDataFrame([(k, "x" if k < 3 else "y") for k in range(5)], "k int, c string")
    assert sorted(r["k"] for r in quality.missing(exp, a, ["k"]).collect()) == [0, 3, 4]
    rates = {r["c"]: (r["expected"], r["missing"]) for r in quality.failure_rates(exp, a, ["k"], "c").collect()}
    assert rates == {"x": (3, 1), "y": (2, 2)}


def test_products_per_event_ignore_order(spark):
    rows = [(1, 40.0, 0.5, 5, True), (1, 60.0, 1.0, 4, False), (1, 20.0, 1.0, 5, True), (2, 40.0, 0.1, 0, False)]
    jets = spark.createDataFrame(rows, "event int, pt double, eta double, flavour int, tag boolean")
    sf, eff = {f: one_cell(0.9, 0.05) for f in (0, 4, 5)}, {f: one_cell(0.5) for f in (0, 4, 5)}
    got = {r["event"]: (r["bc"], r["up"], r["light"]) for r in tagging.fixed_wp_weights(
        jets, "event", F.col("tag"), sf, eff, {"bc": ((5, 4), 0), "up": ((5, 4), 1), "light": ((0,), 0)}).collect()}
    assert got[1] == pytest.approx((0.9 * 1.1, 0.95 * 1.05, 1.0)) and got[2] == pytest.approx((1.0, 1.0, 1.1))


@pytest.mark.parametrize("name", ["q_overlap_removal", "q_dressing", "q_fiducial", "q_jet_stage", "q_gen_dphi"])
def test_queries_with_salted_keys(spark, sf, monkeypatch, name):
    """The salted plan gives the same rows as the SQL, whichever keys count as heavy."""
    monkeypatch.setattr(joins, "heavy_keys", lambda *a, **k: list(range(0, 1500, 3)))
    result, _ = compare(spark, duck(sf), name, sf)
    assert result.startswith("ok"), result


def test_one_event_with_a_third_of_all_objects(spark):
    """Ranking, counting and products on a hot event against pandas."""
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"event": np.where(rng.random(n) < 1 / 3, 1, rng.integers(2, 600, n)), "id": np.arange(n),
                        "pt": rng.uniform(0, 100, n), "f": rng.uniform(0.99, 1.01, n)})
    df = spark.createDataFrame(pdf).repartition(16)
    top = rank_objects(df, ["event"], ["-pt", "id"], 2)
    want = pdf.sort_values(["pt", "id"], ascending=[False, True]).groupby("event").head(2)
    assert sorted(r["id"] for r in top.collect()) == sorted(want.id)
    got = {r["event"]: (r["n"], r["p"]) for r in df.groupBy("event").agg(
        F.count_if(F.col("pt") > 30).alias("n"), F.product("f").alias("p")).collect()}
    for event, rows in pdf.groupby("event"):
        assert got[event][0] == (rows.pt > 30).sum() and got[event][1] == pytest.approx(rows.f.prod())
