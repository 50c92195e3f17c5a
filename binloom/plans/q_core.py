"""Fused fills: histograms in one and two dimensions, folding, scopes, merging, yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from binloom.config import Alias, Cut, Edges, Sample, Uniform, Variable
from binloom.operators import histops
from binloom.operators.analysis import Analysis
from binloom.operators.collect import rank_objects
from binloom.operators.fill import fill
from binloom.plans.registry import bin_sql, edges_sql, query, with_ctes
from binloom.sources import driver_tables as T

PT20 = Uniform(20, 20.0, 100.0)
PAIR_CUTS = [Cut("sr", "p1.pt > 25 AND p2.pt > 13",
                 {"os": "p1.pdgId * p2.pdgId < 0", "ss": "p1.pdgId * p2.pdgId > 0"})]
PAIR_SQL = {"pair": """
SELECT ev.*, p1.pt AS pt1, p2.pt AS pt2, p1.eta AS eta1, p2.eta AS eta2, p1.pdgId AS id1, p2.pdgId AS id2
FROM ev JOIN obj p1 ON ev.event = p1.event AND p1.kind = 'lepton' AND p1.idx = 0
        JOIN obj p2 ON ev.event = p2.event AND p2.kind = 'lepton' AND p2.idx = 1"""}


def leading_pairs(spark, sf_dir) -> DataFrame:
    """Events with their two leading items of either kind, as structs p1 and p2."""
    top = rank_objects(T.items(spark, sf_dir), ["event"], T.ORDER, 2)
    obj = F.struct(*T.FIELDS)
    pairs = top.groupBy("event").agg(
        F.max(F.when(F.col("idx") == 0, obj)).alias("p1"),
        F.max(F.when(F.col("idx") == 1, obj)).alias("p2")).filter("p2 IS NOT NULL")
    return T.ev(spark, sf_dir).join(pairs, "event")


@query("q_minimum_slice", with_ctes(f"""
SELECT sample, CASE WHEN p1.pdgId * p2.pdgId < 0 THEN 'sr_os' ELSE 'sr_ss' END AS cut,
       'pt1' AS variable, 'nominal' AS variation,
       CAST(least(greatest(floor((p1.pt - 20) / 4) + 1, 1), 20) AS INT) AS bin, CAST(0 AS INT) AS biny,
       sum(weight) AS sumw, sum(weight * weight) AS sumw2, count(*) AS n
FROM ev JOIN rk p1 ON ev.event = p1.event AND p1.k = 0 JOIN rk p2 ON ev.event = p2.event AND p2.k = 1
WHERE p1.pt > 25 AND p2.pt > 13 AND abs(weight) > 0
GROUP BY ALL""", "items", "ev", rk="""
SELECT *, row_number() OVER (PARTITION BY event ORDER BY pt DESC, line, part, supp, ship) - 1 AS k FROM items"""))
def minimum_slice(spark, sf_dir):
    run = Analysis(cuts=PAIR_CUTS, variables=[Variable("pt1", "p1.pt", PT20, fold=3)])
    return run.histograms(leading_pairs(spark, sf_dir))


def lepton_pairs(spark, sf_dir) -> DataFrame:
    """Events with two leptons; the columns most core queries need."""
    return T.records(spark, sf_dir, want={"lep": 2}, fields=["pt", "eta", "pdgId"]).filter(F.size("lep") >= 2).select(
        "event", "sample", "dataset", "weight", "total", "priority",
        *[F.get("lep", F.lit(i))[f].alias(f"{n}{i + 1}")
          for n, f in (("pt", "pt"), ("eta", "eta"), ("id", "pdgId")) for i in range(2)])


HEAD = "sample, 'all' AS cut, '{v}' AS variable, 'nominal' AS variation"
SUMS = "sum(weight) AS sumw, sum(weight*weight) AS sumw2, count(*) AS n"
ALL = [Cut("all", "true")]


@query("q_hist1d", with_ctes(f"""
SELECT {HEAD.format(v='pt1')}, {bin_sql('pt1', 20, 20.0, 100.0)} AS bin, CAST(0 AS INT) AS biny, {SUMS}
FROM pair GROUP BY ALL""", "ev", "obj", **PAIR_SQL))
def hist1d(spark, sf_dir):
    return fill(lepton_pairs(spark, sf_dir), ALL, [Variable("pt1", "pt1", PT20)])


@query("q_hist2d", with_ctes(f"""
SELECT {HEAD.format(v='pt1_pt2')}, {bin_sql('pt1', 10, 0.0, 100.0)} AS bin, {bin_sql('pt2', 8, 0.0, 80.0)} AS biny, {SUMS}
FROM pair GROUP BY ALL""", "ev", "obj", **PAIR_SQL))
def hist2d(spark, sf_dir):
    v = Variable("pt1_pt2", "pt1", Uniform(10, 0.0, 100.0), "pt2", Uniform(8, 0.0, 80.0))
    return fill(lepton_pairs(spark, sf_dir), ALL, [v])


VAR_EDGES = (10.0, 20.0, 35.0, 60.0, 100.0)


@query("q_hist_varbins", with_ctes(f"""
SELECT {HEAD.format(v='pt2')}, {edges_sql('pt2', VAR_EDGES)} AS bin, CAST(0 AS INT) AS biny, {SUMS}
FROM pair GROUP BY ALL""", "ev", "obj", **PAIR_SQL))
def hist_varbins(spark, sf_dir):
    return fill(lepton_pairs(spark, sf_dir), ALL, [Variable("pt2", "pt2", Edges(VAR_EDGES))])


@query("q_fold", with_ctes(" UNION ALL ".join(f"""
SELECT sample, 'all' AS cut, 'pt1_fold{m}' AS variable, 'nominal' AS variation,
  CAST({e.format(b=bin_sql('pt1', 6, 30.0, 90.0))} AS INTEGER) AS bin, CAST(0 AS INT) AS biny, {SUMS}
FROM pair GROUP BY ALL""" for m, e in ((0, "{b}"), (1, "greatest({b},1)"), (2, "least({b},6)"),
                                        (3, "least(greatest({b},1),6)"))), "ev", "obj", **PAIR_SQL))
def fold(spark, sf_dir):
    axis = Uniform(6, 30.0, 90.0)
    return fill(lepton_pairs(spark, sf_dir), ALL,
                [Variable(f"pt1_fold{m}", "pt1", axis, fold=m) for m in range(4)])


CAT_CUTS = [Cut("sr", "pt1 > 25 AND pt2 > 13", {"0j": "njet = 0", "1j": "njet = 1", "2j": "njet >= 2"}),
            Cut("incl", "pt1 > 25")]


def with_jet_count(spark, sf_dir) -> DataFrame:
    """Lepton pairs and the number of all jets above 30 of the event (a combined aggregate)."""
    jets = T.items(spark, sf_dir).filter("kind = 'jet' AND pt > 30").groupBy("event").agg(
        F.count(F.lit(1)).alias("njet"))
    return lepton_pairs(spark, sf_dir).join(jets, "event", "left").fillna(0, ["njet"])


NJ_SQL = {**PAIR_SQL, "nj": "SELECT event, count(*) AS njet FROM items WHERE kind='jet' AND pt > 30 GROUP BY event",
          "pj": "SELECT pair.*, coalesce(njet, 0) AS njet FROM pair LEFT JOIN nj USING (event)"}


@query("q_cut_categories", with_ctes(f"""
SELECT sample, cut, 'yield' AS variable, 'nominal' AS variation, CAST(1 AS INT) AS bin, CAST(0 AS INT) AS biny, {SUMS}
FROM (SELECT *, 'sr_0j' AS cut FROM pj WHERE pt1 > 25 AND pt2 > 13 AND njet = 0
  UNION ALL SELECT *, 'sr_1j' FROM pj WHERE pt1 > 25 AND pt2 > 13 AND njet = 1
  UNION ALL SELECT *, 'sr_2j' FROM pj WHERE pt1 > 25 AND pt2 > 13 AND njet >= 2
  UNION ALL SELECT *, 'incl' FROM pj WHERE pt1 > 25) WHERE abs(weight) > 0 GROUP BY ALL""",
    "ev", "obj", **NJ_SQL))
def cut_categories(spark, sf_dir):
    run = Analysis(cuts=CAT_CUTS, variables=[Variable("yield", "1", Uniform(1, 0.0, 2.0))])
    return run.histograms(with_jet_count(spark, sf_dir))


@query("q_var_scope", with_ctes(f"""
SELECT sample, 'incl' AS cut, 'pt1' AS variable, 'nominal' AS variation, {bin_sql('pt1', 20, 20.0, 100.0)} AS bin,
  CAST(0 AS INT) AS biny, {SUMS} FROM pj WHERE pt1 > 25 AND abs(weight) > 0 GROUP BY ALL
UNION ALL SELECT sample, 'sr_2j', 'pt2', 'nominal', {bin_sql('pt2', 20, 20.0, 100.0)}, CAST(0 AS INT), {SUMS}
FROM pj WHERE pt1 > 25 AND pt2 > 13 AND njet >= 2 AND abs(weight) > 0 GROUP BY ALL""", "ev", "obj", **NJ_SQL))
def var_scope(spark, sf_dir):
    run = Analysis(cuts=CAT_CUTS, variables=[Variable("pt1", "pt1", PT20, cuts=("incl",)),
                                             Variable("pt2", "pt2", PT20, cuts=("sr_2j",))])
    return run.histograms(with_jet_count(spark, sf_dir))


@query("q_preselection", with_ctes(f"""
SELECT sample, count(*) AS n, sum(weight) AS sumw FROM pair
WHERE pt1 > 25 AND pt2 > 13 AND abs(weight) > 0 GROUP BY ALL""", "ev", "obj", **PAIR_SQL))
def preselection(spark, sf_dir):
    return (lepton_pairs(spark, sf_dir).filter("pt1 > 25 AND pt2 > 13 AND abs(weight) > 0")
            .groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("sumw")))


@query("q_cutflow", with_ctes("""
SELECT sample, count(*) AS all_events, count(*) FILTER (abs(weight) > 0) AS nonzero,
  count(*) FILTER (abs(weight) > 0 AND pt1 > 25) AS lead,
  count(*) FILTER (abs(weight) > 0 AND pt1 > 25 AND pt2 > 13) AS trail,
  count(*) FILTER (abs(weight) > 0 AND pt1 > 25 AND pt2 > 13 AND id1*id2 < 0) AS opposite
FROM pair GROUP BY ALL""", "ev", "obj", **PAIR_SQL))
def cutflow(spark, sf_dir):
    steps = [("nonzero", "abs(weight) > 0"), ("lead", "pt1 > 25"), ("trail", "pt2 > 13"),
             ("opposite", "id1 * id2 < 0")]
    return histops.cutflow(lepton_pairs(spark, sf_dir), steps, ["sample"])


SAMPLES = [Sample("DATA", "priority IS NOT NULL AND sample0 = 'DATA'", is_data=True),
           Sample("DY", "sample0 = 'BKG'", "f", subsamples={"hard": "total > 150", "soft": "total <= 200"}),
           Sample("SIG", "sample0 = 'SIG'", "f", dataset_weights={0: "0.5D", 1: "2D"})]


@query("q_subsamples", with_ctes("""
SELECT sample, count(*) AS n, sum(w) AS sumw FROM (
  SELECT 'DATA' AS sample, CAST(1 AS DOUBLE) AS w FROM ev WHERE sample = 'DATA'
  UNION ALL SELECT 'DY_hard', weight FROM ev WHERE sample = 'BKG' AND total > 150
  UNION ALL SELECT 'DY_soft', weight FROM ev WHERE sample = 'BKG' AND total <= 200
  UNION ALL SELECT 'SIG', weight * CASE dataset WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE)
     ELSE CAST(1 AS DOUBLE) END FROM ev WHERE sample = 'SIG') GROUP BY ALL""", "ev"))
def subsamples(spark, sf_dir):
    df = T.ev(spark, sf_dir).withColumnRenamed("sample", "sample0").withColumn("f", F.col("weight") / T.LUMI)
    out = Analysis(samples=SAMPLES, lumi=T.LUMI).events(df.drop("weight"))
    return out.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("sumw"))


@query("q_hist_merge", with_ctes(f"""
SELECT {HEAD.format(v='pt1')}, {bin_sql('pt1', 20, 20.0, 100.0)} AS bin, CAST(0 AS INT) AS biny, {SUMS}
FROM pair GROUP BY ALL""", "ev", "obj", **PAIR_SQL))
def hist_merge(spark, sf_dir):
    parts = fill(lepton_pairs(spark, sf_dir), ALL, [Variable("pt1", "pt1", PT20)], by=["sample", "dataset"])
    return histops.merge(parts, over=["dataset"])


@query("q_yields", with_ctes("""
SELECT sample, cut, 'pt1' AS variable, 'nominal' AS variation, sum(weight) AS yield, sum(weight*weight) AS yield2 FROM (
  SELECT *, 'sr_2j' AS cut FROM pj WHERE pt1 > 25 AND pt2 > 13 AND njet >= 2
  UNION ALL SELECT *, 'sr_1j' FROM pj WHERE pt1 > 25 AND pt2 > 13 AND njet = 1
  UNION ALL SELECT *, 'sr_0j' FROM pj WHERE pt1 > 25 AND pt2 > 13 AND njet = 0
  UNION ALL SELECT *, 'incl' FROM pj WHERE pt1 > 25)
WHERE abs(weight) > 0 AND pt1 >= 20 AND pt1 < 100 GROUP BY ALL""", "ev", "obj", **NJ_SQL))
def yields(spark, sf_dir):
    run = Analysis(cuts=CAT_CUTS, variables=[Variable("pt1", "pt1", PT20)])
    return histops.yields(run.histograms(with_jet_count(spark, sf_dir)), size={"pt1": 20})


@query("q_blinding", with_ctes(f"""
SELECT * EXCLUDE (hide) REPLACE (CASE WHEN hide THEN 0 ELSE sumw END AS sumw,
  CASE WHEN hide THEN 0 ELSE sumw2 END AS sumw2, CASE WHEN hide THEN 0 ELSE n END AS n)
FROM (SELECT sample, cut, sample = 'DATA' AND cut = 'sr_os' AS hide, 'pt1' AS variable, 'nominal' AS variation,
        {bin_sql('pt1', 20, 20.0, 100.0)} AS bin, CAST(0 AS INT) AS biny, {SUMS}
      FROM (SELECT *, CASE WHEN id1*id2 < 0 THEN 'sr_os' ELSE 'sr_ss' END AS cut FROM pair WHERE abs(weight) > 0)
      GROUP BY ALL)""", "ev", "obj", **PAIR_SQL))
def blinding(spark, sf_dir):
    run = Analysis(cuts=[Cut("sr", "true", {"os": "id1*id2 < 0", "ss": "id1*id2 > 0"})],
                   variables=[Variable("pt1", "pt1", PT20, blind=("sr_os",))])
    return run.histograms(lepton_pairs(spark, sf_dir))


@query("q_scoped_alias", with_ctes("""
SELECT sample, count(*) AS n, count(gen) AS n_gen, round(coalesce(sum(gen), 0), 4) AS sum_gen,
  sum(CASE WHEN late > 1 THEN 1 ELSE 0 END)::BIGINT AS n_late
FROM (SELECT *, CASE WHEN sample IN ('SIG','BKG') THEN pt1 * 2 END AS gen,
             pt1 / (CASE WHEN pt2 > 20 THEN pt2 ELSE 20 END) AS late FROM pair) GROUP BY ALL""",
    "ev", "obj", **PAIR_SQL))
def scoped_alias(spark, sf_dir):
    run = Analysis(aliases=[Alias("floor2", "CASE WHEN pt2 > 20 THEN pt2 ELSE 20 END"),
                            Alias("gen", "pt1 * 2", samples=("SIG", "BKG")),
                            Alias("late", "pt1 / floor2", after_nuisances=True)])
    return run.events(lepton_pairs(spark, sf_dir)).groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"), F.count("gen").alias("n_gen"),
        F.round(F.coalesce(F.sum("gen"), F.lit(0.0)), 4).alias("sum_gen"),
        F.count_if(F.col("late") > 1).alias("n_late"))
