"""Table algebra on histograms, measured rates and efficiencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.config import Cut, Edges, Nuisance, Uniform, Variable
from binloom.functions.bins import bin_index
from binloom.operators import histops, rates
from binloom.operators.analysis import Analysis
from binloom.operators.fill import fill
from binloom.plans.q_core import PT20, SUMS
from binloom.plans.registry import bin_sql, edges_sql, query, r, rs, with_ctes
from binloom.sources import driver_tables as T

TIGHT = "score > 0.5"
AXIS = Uniform(8, 10.0, 50.0)
CUTS = [Cut("loose", "true"), Cut("tight", TIGHT), Cut("os", "pdgId > 0"), Cut("ss", "pdgId < 0")]


def leading(spark, sf_dir):
    """Events flattened with their leading lepton."""
    rec = T.records(spark, sf_dir, want={"lep": 1}, fields=["pt", "eta", "pdgId", "score"]).filter(F.size("lep") == 1)
    return rec.select("event", "sample", "dataset", "weight", "total", F.inline("lep")).drop("idx")


def hists(spark, sf_dir):
    return fill(leading(spark, sf_dir), CUTS, [Variable("pt", "pt", PT20)])


LEAD = {"lead": "SELECT ev.*, pt, eta, pdgId, score FROM ev JOIN obj USING (event) WHERE kind = 'lepton' AND idx = 0",
        "cuts": """SELECT *, 'loose' AS cut FROM lead UNION ALL SELECT *, 'tight' FROM lead WHERE score > 0.5
          UNION ALL SELECT *, 'os' FROM lead WHERE pdgId > 0 UNION ALL SELECT *, 'ss' FROM lead WHERE pdgId < 0""",
        "h": f"""SELECT sample, cut, 'pt' AS variable, 'nominal' AS variation, {bin_sql('pt', 20, 20.0, 100.0)} AS bin,
          CAST(0 AS INT) AS biny, {SUMS} FROM cuts GROUP BY ALL"""}
K = "cut, variable, variation, bin, biny"


@query("q_hist_arith", with_ctes(f"""
SELECT {K}, 'rest' AS sample, sum(c*sumw) AS sumw, sum(c*c*sumw2) AS sumw2, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT *, CASE sample WHEN 'DATA' THEN CAST(1 AS DOUBLE) WHEN 'BKG' THEN CAST(-1 AS DOUBLE)
  ELSE CAST(-0.5 AS DOUBLE) END AS c FROM h) GROUP BY ALL""", "ev", "obj", **LEAD))
def hist_arith(spark, sf_dir):
    return histops.combine(hists(spark, sf_dir), {"DATA": 1.0, "BKG": -1.0, "SIG": -0.5}, "rest")


@query("q_hist_ratio", with_ctes(f"""
SELECT {K}, {rs('a/nullif(b,0)', 8)} AS ratio, {rs('sqrt((a2 + a/nullif(b,0)*a/nullif(b,0)*b2)/nullif(b*b,0))', 8)} AS error FROM (
  SELECT {K}, sum(sumw) FILTER (sample='SIG') AS a, sum(sumw2) FILTER (sample='SIG') AS a2,
    sum(sumw) FILTER (sample='BKG') AS b, sum(sumw2) FILTER (sample='BKG') AS b2 FROM h WHERE sample IN ('SIG','BKG') GROUP BY ALL)""",
    "ev", "obj", **LEAD))
def hist_ratio(spark, sf_dir):
    out = histops.ratio(hists(spark, sf_dir), "SIG", "BKG")
    return out.withColumns({"ratio": r("ratio", 8), "error": r("error", 8)})


@query("q_region_transfer", with_ctes(f"""
SELECT CASE cut WHEN 'os' THEN 'flip_ss' ELSE 'flip_tight' END AS cut, variable, variation, bin, biny, 'flip' AS sample,
  sum(c*sumw) AS sumw, sum(c*c*sumw2) AS sumw2, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT *, CASE sample WHEN 'DATA' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS c FROM h WHERE cut IN ('os','tight')) GROUP BY ALL""",
    "ev", "obj", **LEAD))
def region_transfer(spark, sf_dir):
    return histops.region_transfer(hists(spark, sf_dir), "DATA", ["BKG", "SIG"], "flip",
                                   {"os": "flip_ss", "tight": "flip_tight"})


# weights exact in binary, so that sums agree to the last bit
FLIP = ("CASE WHEN pt > 40 THEN 1.25D ELSE 1.5D END", "CASE WHEN pt > 40 THEN 0.75D ELSE 0.5D END")
FLIP_NAMES = {"effUp": "flip_effUp", "effDown": "flip_effDown"}


@query("q_region_transfer_syst", with_ctes(f"""
SELECT CASE cut WHEN 'os' THEN 'flip_ss' ELSE 'flip_tight' END AS cut, variable, variation, bin, biny, 'flip' AS sample,
  sum(c*sumw) AS sumw, sum(c*c*sumw2) AS sumw2, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT *, CAST(1 AS DOUBLE) AS c FROM d UNION ALL
  SELECT b.* REPLACE (v.variation AS variation), CAST(-1 AS DOUBLE) FROM hn b, (SELECT DISTINCT variation FROM d) v WHERE b.sample <> 'DATA') WHERE cut IN ('os','tight')
GROUP BY ALL""", "ev", "obj", **LEAD, hn=LEAD["h"].replace("FROM cuts", "FROM cuts WHERE weight <> 0"), d=" UNION ALL ".join(
    f"""SELECT sample, cut, 'pt' AS variable, '{v}' AS variation, {bin_sql('pt', 20, 20.0, 100.0)} AS bin, CAST(0 AS INT) AS biny,
      sum(weight * ({w})) AS sumw, sum(weight * ({w}) * weight * ({w})) AS sumw2, count(*) AS n FROM cuts WHERE sample = 'DATA' AND weight <> 0 GROUP BY ALL"""
    for v, w in (("nominal", "1"), *zip(FLIP_NAMES.values(), (w.replace("D ", " ") for w in FLIP))))))
def region_transfer_syst(spark, sf_dir):
    """Opposite-sign data with a varied flip weight, minus the nominal other processes."""
    run = Analysis(cuts=CUTS, variables=[Variable("pt", "pt", PT20)], nuisances=[Nuisance("eff", "weight", *FLIP, samples=("DATA",))])
    return histops.varied_transfer(run.histograms(leading(spark, sf_dir)), "DATA", ["BKG", "SIG"], "flip",
                                   {"os": "flip_ss", "tight": "flip_tight"}, FLIP_NAMES)


@query("q_plot_groups", with_ctes(f"""
SELECT {K}, CASE sample WHEN 'DATA' THEN 'data' ELSE 'simulation' END AS grp, sum(sumw) AS sumw, sum(sumw2) AS sumw2,
  CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL""", "ev", "obj", **LEAD))
def plot_groups(spark, sf_dir):
    return histops.group_map(hists(spark, sf_dir), {"DATA": "data", "SIG": "simulation", "BKG": "simulation"})


@query("q_stack_totals", with_ctes("""
SELECT kind, sample, sum(sumw) AS total, CAST(grouping(kind)*2 + grouping(sample) AS BIGINT) AS level
FROM (SELECT *, CASE sample WHEN 'SIG' THEN 'signal' ELSE 'background' END AS kind FROM h
      WHERE sample <> 'DATA' AND bin BETWEEN 1 AND 20) GROUP BY ROLLUP (kind, sample)""", "ev", "obj", **LEAD))
def stack_totals(spark, sf_dir):
    return histops.stack_totals(hists(spark, sf_dir), {"SIG": "signal", "BKG": "background"}, {"pt": 20})


@query("q_cum_stack", with_ctes("""
SELECT *, CASE sample WHEN 'BKG' THEN 1 ELSE 2 END AS rank, sum(sumw) OVER (PARTITION BY cut, variable, variation, bin, biny
  ORDER BY CASE sample WHEN 'BKG' THEN 1 ELSE 2 END ROWS UNBOUNDED PRECEDING) AS stacked FROM h WHERE sample <> 'DATA'""",
    "ev", "obj", **LEAD))
def cum_stack(spark, sf_dir):
    return histops.cumulative_stack(hists(spark, sf_dir), ["BKG", "SIG"])


@query("q_rebin", with_ctes(f"""
SELECT sample, {K.replace('bin, biny', '')} CAST(CASE WHEN bin = 0 THEN 0 WHEN bin <= 5 THEN 1 WHEN bin <= 12 THEN 2 WHEN bin <= 20 THEN 3 ELSE 4 END AS INT) AS bin,
  biny, sum(sumw) AS sumw, sum(sumw2) AS sumw2, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL""", "ev", "obj", **LEAD))
def rebin(spark, sf_dir):
    return histops.rebin_to_edges(hists(spark, sf_dir), PT20.edges(), [20.0, 40.0, 68.0, 100.0])


RATE_X, RATE_Y = (10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 1000.0), (0.0, 1.479, 2.6)


def rate_hists(spark, sf_dir):
    v = Variable("pt_eta", "pt", Edges(RATE_X), "abs(eta)", Edges(RATE_Y))
    return fill(leading(spark, sf_dir), CUTS[:2], [v])


RATE_SQL = {**{k: LEAD[k] for k in ("lead",)}, "c": f"""
SELECT {edges_sql('pt', RATE_X)} AS bin, {edges_sql('abs(eta)', RATE_Y)} AS biny,
  sum(weight) FILTER (sample='DATA' AND score > 0.5) AS td, sum(weight) FILTER (sample='BKG' AND score > 0.5) AS tb,
  sum(weight) FILTER (sample='DATA') AS ld, sum(weight) FILTER (sample='BKG') AS lb FROM lead GROUP BY ALL""",
  "d": "SELECT bin, biny, coalesce(td,0) AS td, coalesce(tb,0) AS tb, coalesce(ld,0) AS ld, coalesce(lb,0) AS lb FROM c"}


def _rate_cols(t, low):
    return (f"{t} AS tight, {low} AS loose, {rs(f'CASE WHEN {low} > 0 THEN {t}/{low} ELSE 0 END', 8)} AS rate, "
            f"{rs(f'CASE WHEN {low} > 0 AND {t} > 0 THEN {t}/{low}*sqrt(1/{t}+1/{low}) ELSE 0 END', 8)} AS error")


@query("q_fake_rate", with_ctes(f"SELECT 'pt_eta' AS variable, 'nominal' AS variation, bin, biny, {_rate_cols('td', 'ld')} FROM d", "ev", "obj", **RATE_SQL))
def fake_rate(spark, sf_dir):
    out = rates.fake_rate(rate_hists(spark, sf_dir), "loose", "tight", "DATA")
    return out.withColumns({c: r(c, 8) for c in ("rate", "error")})


def _tmpl(scale):
    t, low = f"(td - CAST({scale} AS DOUBLE)*tb)", f"(ld - CAST({scale} AS DOUBLE)*lb)"
    return rs(f"CASE WHEN {low} > 0 THEN (CASE WHEN {t} >= 0 THEN {t}/{low} ELSE 0 END) WHEN ld-lb > 0 THEN (td-tb)/(ld-lb) ELSE 0 END", 8)


@query("q_fake_rate_ewk", with_ctes(f"""
SELECT 'pt_eta' AS variable, 'nominal' AS variation, bin, biny, {_rate_cols('(td-tb)', '(ld-lb)')}, {_tmpl(1.1)} AS ewk_up, {_tmpl(0.9)} AS ewk_down FROM d""",
    "ev", "obj", **RATE_SQL))
def fake_rate_ewk(spark, sf_dir):
    out = rates.fake_rate(rate_hists(spark, sf_dir), "loose", "tight", "DATA", ["BKG"],
                          {"ewk_up": 1.1, "ewk_down": 0.9})
    return out.withColumns({c: r(c, 8) for c in ("rate", "error", "ewk_up", "ewk_down")})


@query("q_fake_rate_variables", with_ctes(f"""
SELECT variable, 'nominal' AS variation, bin, CAST(0 AS INTEGER) AS biny, {_rate_cols('coalesce(t, 0)', 'coalesce(l, 0)')} FROM (
  SELECT * FROM (SELECT variable, bin, sum(weight) FILTER (score > 0.5) AS t, sum(weight) AS l FROM (
    SELECT 'pt' AS variable, {bin_sql('pt', 20, 20.0, 100.0)} AS bin, weight, score FROM lead WHERE sample = 'DATA' UNION ALL
    SELECT 'total', {bin_sql('total', 8, 10.0, 50.0)}, weight, score FROM lead WHERE sample = 'DATA') GROUP BY ALL) WHERE coalesce(t, 0) <> 0 OR l <> 0)""",
    "ev", "obj", lead=LEAD["lead"]))
def fake_rate_variables(spark, sf_dir):
    """Rates against two variables from one histogram table; their bins stay apart."""
    h = fill(leading(spark, sf_dir), CUTS[:2], [Variable("pt", "pt", PT20), Variable("total", "total", AXIS)])
    out = rates.fake_rate(h, "loose", "tight", "DATA").filter("tight <> 0 OR loose <> 0 OR rate <> 0")
    return out.withColumns({c: r(c, 8) for c in ("rate", "error")})


@query("q_prompt_rate", with_ctes(" UNION ALL ".join(f"""
SELECT '{s}' AS sample, 'pt_eta' AS variable, 'nominal' AS variation, bin, biny, {_rate_cols('t', 'l')} FROM (
  SELECT {edges_sql('pt', RATE_X)} AS bin, {edges_sql('abs(eta)', RATE_Y)} AS biny,
    coalesce(sum(weight) FILTER (score > 0.5), 0) AS t, sum(weight) AS l FROM lead WHERE sample = '{s}' GROUP BY ALL)"""
    for s in ("DATA", "SIG")), "ev", "obj", lead=LEAD["lead"]))
def prompt_rate(spark, sf_dir):
    """The same measurement in data and in simulation."""
    h = rate_hists(spark, sf_dir).filter(F.col("sample").isin("DATA", "SIG"))
    out = rates.own_rate(h, "loose", "tight", ["sample"])
    return out.withColumns({c: r(c, 8) for c in ("rate", "error")})


EFF_X, EFF_Y = (20.0, 40.0, 60.0, 90.0, 200.0), (0.0, 0.75, 1.75, 2.6)


@query("q_eff_map", with_ctes(f"""
SELECT flavour, ix, iy, num, den, {rs('coalesce(num/nullif(den,0),0)', 8)} AS eff FROM (
  SELECT flavour, {edges_sql('pt', EFF_X)} AS ix, {edges_sql('abs(eta)', EFF_Y)} AS iy,
    sum(CASE WHEN score > 0.6 THEN weight ELSE 0 END) AS num, sum(weight) AS den
  FROM items JOIN ev USING (event) WHERE kind = 'jet' AND pt > 20 GROUP BY ALL)""", "items", "ev"))
def eff_map(spark, sf_dir):
    out = rates.efficiency_map(weighted_jets(spark, sf_dir).filter("pt > 20"), {
        "flavour": F.col("flavour"), "ix": bin_index(F.col("pt"), Edges(EFF_X)),
        "iy": bin_index(F.abs("eta"), Edges(EFF_Y))}, F.col("score") > 0.6, F.col("weight"))
    return out.withColumn("eff", r("eff", 8))


def weighted_jets(spark, sf_dir):
    """All jets with their event's weight (both sides are scans, so Spark may split a hot key)."""
    jets = T.items(spark, sf_dir).filter("kind = 'jet'")
    return jets.join(T.ev(spark, sf_dir).select("event", "sample", "weight"), "event")


@query("q_sf_ratio", with_ctes(f"""
SELECT flavour, {rs('sum(b)', 4)} AS before, {rs('sum(a)', 4)} AS after, {rs('sum(b)/sum(a)', 6)} AS ratio FROM (
  SELECT 'all' AS flavour, weight AS b, weight*p AS a FROM e UNION ALL SELECT 'b', weight, weight*pb FROM e WHERE hb
  UNION ALL SELECT 'c', weight, weight*pc FROM e WHERE hc UNION ALL SELECT 'light', weight, weight*pl FROM e WHERE hl) GROUP BY ALL""",
    "items", "ev", e="""
SELECT event, weight, coalesce(p, 1) AS p, pb, pc, pl, coalesce(hb, false) AS hb, coalesce(hc, false) AS hc, coalesce(hl, false) AS hl
FROM ev LEFT JOIN (SELECT event, product(sf) AS p, product(CASE flavour WHEN 5 THEN sf ELSE 1 END) AS pb,
  product(CASE flavour WHEN 4 THEN sf ELSE 1 END) AS pc, product(CASE flavour WHEN 0 THEN sf ELSE 1 END) AS pl,
  bool_or(flavour=5) AS hb, bool_or(flavour=4) AS hc, bool_or(flavour=0) AS hl
  FROM (SELECT event, flavour, CAST(0.8 AS DOUBLE) + CAST(0.4 AS DOUBLE)*score AS sf FROM items WHERE kind='jet' AND score > 0)
  GROUP BY event) USING (event)"""))
def sf_ratio(spark, sf_dir):
    sf = F.when(F.col("score") > 0, 0.8 + 0.4 * F.col("score")).otherwise(F.lit(0.0))
    jets = T.items(spark, sf_dir).filter("kind = 'jet'")
    out = rates.sf_norm_ratio(T.ev(spark, sf_dir), jets, "event", "weight", sf, "flavour", {"b": 5, "c": 4, "light": 0})
    return out.select("flavour", r("before", 4).alias("before"), r("after", 4).alias("after"), r("ratio").alias("ratio"))


@query("q_combine_norm", with_ctes(f"""
SELECT 'SIG' AS sample, dataset, n, sumw, {rs('xs/total', 10)} AS new_base, {rs('xs/total/base', 10)} AS factor FROM d, (
  SELECT sum(sumw) AS total, arg_min(base*sumw, (n, dataset)) AS xs FROM d)""", "ev", d="""
SELECT dataset, count(*) AS n, sum(weight) AS sumw, min(CAST(0.25 AS DOUBLE)*(dataset+1)) AS base FROM ev WHERE sample='SIG' GROUP BY ALL"""))
def combine_norm(spark, sf_dir):
    runs = T.ev(spark, sf_dir).filter("sample = 'SIG'").withColumn("base", 0.25 * (F.col("dataset") + 1))
    out = rates.combine_norm(runs, "sample", "dataset", "weight", "base")
    return out.withColumns({c: r(c, 10) for c in ("new_base", "factor")})


@query("q_roc_points", with_ctes(f"""
SELECT a.cut, 'pt' AS variable, 'nominal' AS variation, {rs('a.s/b.s', 8)} AS sig_eff, {rs('1 - a.b/b.b', 8)} AS bkg_rejection FROM t a, t b
WHERE b.cut = 'loose' AND a.cut IN ('tight','os')""", "ev", "obj", **LEAD, t="""
SELECT cut, sum(sumw) FILTER (sample='SIG') AS s, sum(sumw) FILTER (sample='BKG') AS b FROM h GROUP BY cut"""))
def roc_points(spark, sf_dir):
    out = rates.roc_points(hists(spark, sf_dir), "loose", ["tight", "os"], ["SIG"], ["BKG"])
    return out.withColumns({c: r(c, 8) for c in ("sig_eff", "bkg_rejection")})


@query("q_normalise_rows", with_ctes(f"""
SELECT event, {rs('coalesce(a/nullif(a+b+c,0),0)', 8)} AS a, {rs('coalesce(b/nullif(a+b+c,0),0)', 8)} AS b,
  {rs('coalesce(c/nullif(a+b+c,0),0)', 8)} AS c FROM (
  SELECT event, coalesce(sum(pt) FILTER (flavour=5), 0) AS a, coalesce(sum(pt) FILTER (flavour=4), 0) AS b,
    coalesce(sum(pt) FILTER (flavour=0), 0) AS c FROM items GROUP BY event)""", "items"))
def normalise_rows(spark, sf_dir):
    widths = T.items(spark, sf_dir).groupBy("event").agg(*[
        F.sum(F.when(F.col("flavour") == f, F.col("pt")).otherwise(0.0)).alias(n)
        for n, f in (("a", 5), ("b", 4), ("c", 0))])
    out = histops.normalise_rows(widths, ["a", "b", "c"])
    return out.withColumns({c: r(c, 8) for c in ("a", "b", "c")})
