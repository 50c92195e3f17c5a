"""Derived columns and predicates on events and their objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.config import Sample
from binloom.functions import arrays as A, kinematics as K, select as S
from binloom.functions.lookup import BinnedMap
from binloom.operators import veto
from binloom.operators.define import event_weight
from binloom.plans.registry import mass_sql, map_sql, query, r, rs, with_ctes, wrap_sql
from binloom.sources import driver_tables as T

FACTOR = {"1-URGENT": 1.5, "5-LOW": -0.5, "4-NOT SPECIFIED": 0.0}
FACTOR_EXPR = "CASE priority " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in FACTOR.items()) + " ELSE 1D END"


@query("q_event_weight", with_ctes("SELECT event, sample, weight FROM ev", "ev"))
def q_event_weight(spark, sf_dir):
    samples = [Sample("DATA", is_data=True), Sample("SIG", weight=FACTOR_EXPR), Sample("BKG", weight=FACTOR_EXPR)]
    df = T.ev(spark, sf_dir).drop("weight")
    return event_weight(df, samples, lumi=2.0).select("event", "sample", "weight")


@query("q_dataset_weight", with_ctes("""
SELECT event, sample, dataset, CASE WHEN sample = 'DATA' THEN CAST(1 AS DOUBLE) ELSE weight *
  CASE WHEN sample = 'SIG' AND dataset = 0 THEN CAST(0.5 AS DOUBLE)
       WHEN sample = 'SIG' AND dataset = 1 AND total > 200 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS weight
FROM ev""", "ev"))
def q_dataset_weight(spark, sf_dir):
    samples = [Sample("DATA", is_data=True), Sample("BKG", weight=FACTOR_EXPR),
               Sample("SIG", weight=FACTOR_EXPR, dataset_weights={
                   0: "0.5D", 1: "CASE WHEN total > 200 THEN 0D ELSE 1D END"})]
    df = T.ev(spark, sf_dir).drop("weight")
    return event_weight(df, samples, lumi=2.0).select("event", "sample", "dataset", "weight")


def jet_summary(spark, sf_dir):
    """Per event, sums over all its jets; combined map-side, whatever the number of jets."""
    jets = T.items(spark, sf_dir).filter("kind = 'jet'")
    central = F.abs("eta") < 2.2
    return jets.groupBy("event").agg(
        F.count_if(F.col("pt") > 30).alias("n30"),
        F.count_if((F.col("pt") > 20) & central & (F.col("score") > 0.7)).alias("nb20"),
        F.count_if((F.col("pt") > 30) & central & (F.col("score") > 0.7)).alias("nb30"),
        F.count_if((F.abs("eta") > 1.2) & (F.abs("eta") < 1.8) & (F.col("pt") < 50)).alias("nhorn"))


JS = """SELECT event, count(*) FILTER (pt > 30) AS n30,
  count(*) FILTER (pt > 20 AND abs(eta) < 2.2 AND score > 0.7) AS nb20,
  count(*) FILTER (pt > 30 AND abs(eta) < 2.2 AND score > 0.7) AS nb30,
  count(*) FILTER (abs(eta) > 1.2 AND abs(eta) < 1.8 AND pt < 50) AS nhorn
  FROM items WHERE kind = 'jet' GROUP BY event"""


@query("q_multiplicity", with_ctes("""
SELECT event, coalesce(n30, 0) AS n30, coalesce(nb20, 0) AS nb20, coalesce(nb30, 0) AS nb30, coalesce(nhorn, 0) AS nhorn
FROM ev LEFT JOIN js USING (event)""", "ev", "items", js=JS))
def q_multiplicity(spark, sf_dir):
    return (T.ev(spark, sf_dir).select("event").join(jet_summary(spark, sf_dir), "event", "left")
            .fillna(0, ["n30", "nb20", "nb30", "nhorn"]))


@query("q_bveto", with_ctes("""
SELECT event, coalesce(nb20, 0) = 0 AS bveto, coalesce(nb30, 0) >= 1 AS breq, coalesce(nhorn, 0) = 0 AS hornveto
FROM ev LEFT JOIN js USING (event)""", "ev", "items", js=JS))
def q_bveto(spark, sf_dir):
    counts = q_multiplicity(spark, sf_dir)
    return counts.select("event", (F.col("nb20") == 0).alias("bveto"), (F.col("nb30") >= 1).alias("breq"),
                         (F.col("nhorn") == 0).alias("hornveto"))


PAIR_COLS = {"mll": mass_sql("l1", "l2")}


def dilepton(spark, sf_dir):
    """Events with two leptons and the event-level kinematics the regions use."""
    rec = T.records(spark, sf_dir, want={"lep": 2}, fields=["pt", "eta", "phi", "mass", "pdgId"]).filter(F.size("lep") == 2)
    a, b = (K.P4.of(F.get("lep", F.lit(i))) for i in (0, 1))
    ll = a + b
    # the event's missing momentum: magnitude from its total, along the first axis
    met = F.col("total") / 4.0
    return rec.select("event", "sample", "weight", ll.mass().alias("mll"), ll.pt().alias("ptll"),
                      K.transverse_mass(ll.pt(), ll.phi(), met, F.lit(0.0)).alias("mth"),
                      K.transverse_mass(b.pt(), b.phi(), met, F.lit(0.0)).alias("mtw2"))


def _ll(i):
    pt, phi, eta = f"l{i}_pt", f"l{i}_phi", f"l{i}_eta"
    return f"({pt}*cos({phi}))", f"({pt}*sin({phi}))"


(PX1, PY1), (PX2, PY2) = _ll(1), _ll(2)
DILEP_SQL = {
    "ll0": f"SELECT event, sample, weight, {mass_sql('l1', 'l2')} AS mll, {PX1}+{PX2} AS px, {PY1}+{PY2} AS py, "
           f"{PX2} AS px2, {PY2} AS py2, total/CAST(4 AS DOUBLE) AS met FROM rec WHERE nlep >= 2",
    "ll": "SELECT event, sample, weight, mll, sqrt(px*px+py*py) AS ptll, "
          "sqrt(2*sqrt(px*px+py*py)*met*(1-cos(atan2(py,px)))) AS mth, "
          "sqrt(2*sqrt(px2*px2+py2*py2)*met*(1-cos(atan2(py2,px2)))) AS mtw2 FROM ll0"}


@query("q_mt", with_ctes(f"""
SELECT event, {rs('mll', 4)} AS mll, {rs('ptll')} AS ptll, {rs('mth')} AS mth, {rs('mtw2')} AS mtw2 FROM ll""",
    "rec", **DILEP_SQL))
def q_mt(spark, sf_dir):
    return dilepton(spark, sf_dir).select("event", r("mll", 4).alias("mll"),
                                         *[r(c).alias(c) for c in ("ptll", "mth", "mtw2")])


@query("q_region_flags", with_ctes("""
SELECT event, mth > 60 AND mtw2 > 30 AND bveto AS sr,
  mll > 50 AND ((zerojet AND NOT bveto) OR breq) AND mtw2 > 30 AS topcr,
  mth < 60 AND mll > 30 AND mll < 80 AND bveto AND mtw2 > 30 AS dycr,
  mth > 60 AND mtw2 > 30 AND mll > 100 AND bveto AS wwcr
FROM (SELECT ll.*, coalesce(nb20, 0) = 0 AS bveto, coalesce(nb30, 0) >= 1 AS breq, coalesce(n30, 0) = 0 AS zerojet
      FROM ll LEFT JOIN js USING (event))""", "rec", js=JS, **DILEP_SQL))
def q_region_flags(spark, sf_dir):
    return region_flags(spark, sf_dir).select("event", "sr", "topcr", "dycr", "wwcr")


def region_flags(spark, sf_dir):
    df = (dilepton(spark, sf_dir).join(jet_summary(spark, sf_dir), "event", "left")
          .fillna(0, ["n30", "nb20", "nb30", "nhorn"]))
    flags = {
        "bveto": "nb20 = 0", "breq": "nb30 >= 1", "zerojet": "n30 = 0",
        "sr": "mth > 60 AND mtw2 > 30 AND bveto",
        "topcr": "mll > 50 AND ((zerojet AND NOT bveto) OR breq) AND mtw2 > 30",
        "dycr": "mth < 60 AND mll > 30 AND mll < 80 AND bveto AND mtw2 > 30",
        "wwcr": "mth > 60 AND mtw2 > 30 AND mll > 100 AND bveto",
    }
    for name, e in flags.items():
        df = df.withColumn(name, F.expr(e))
    return df


@query("q_jet_bins", with_ctes("""
SELECT event, coalesce(j1_pt, 0) < 30 AS zerojet, coalesce(j1_pt, 0) >= 30 AND coalesce(j2_pt, 0) < 30 AS onejet,
  coalesce(j2_pt, 0) >= 30 AS multijet FROM ev LEFT JOIN wide USING (event)""", "ev", "wide"))
def q_jet_bins(spark, sf_dir):
    rec = T.records(spark, sf_dir, "left", want={"jet": 2}, fields=["pt"])
    pt = F.col("jet.pt")
    j1, j2 = A.alt(pt, 0, 0.0), A.alt(pt, 1, 0.0)
    return rec.select("event", (j1 < 30).alias("zerojet"), ((j1 >= 30) & (j2 < 30)).alias("onejet"),
                      (j2 >= 30).alias("multijet"))


UNROLL = (0.0, 0.2, 0.5, 0.8, 1.0)


def _cell_sql(v):
    return "(CASE " + " ".join(
        f"WHEN {v} > CAST({a} AS DOUBLE) AND {v} < CAST({b} AS DOUBLE) THEN {i}"
        for i, (a, b) in enumerate(zip(UNROLL, UNROLL[1:]))) + " END)"


@query("q_unroll2d", with_ctes(f"""
SELECT event, CAST(coalesce(4 * {_cell_sql('s1')} + {_cell_sql('s2')} + 1, 0) AS INTEGER) AS cell
FROM (SELECT event, l1_score AS s1, coalesce(l2_score, CAST(0.5 AS DOUBLE)) AS s2 FROM rec WHERE nlep >= 1)""", "rec"))
def q_unroll2d(spark, sf_dir):
    rec = T.records(spark, sf_dir, want={"lep": 2}, fields=["pt", "score"]).filter(F.size("lep") >= 1)
    s = F.col("lep.score")
    return rec.select("event", S.unroll2d(A.alt(s, 0, 0.0), A.alt(s, 1, 0.5), UNROLL, UNROLL).alias("cell"))


@query("q_argmax_class", """
SELECT vec_id, e[1] > e[2] AND e[1] > e[3] AND e[1] > e[4] AS vbf, e[2] > e[1] AND e[2] > e[3] AND e[2] > e[4] AS ggh,
  e[3] > e[1] AND e[3] > e[2] AND e[3] > e[4] AS top, e[4] > e[1] AND e[4] > e[2] AND e[4] > e[3] AS ww
FROM (SELECT vec_id, embedding AS e FROM embeddings)""")
def q_argmax_class(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings")
    scores = {n: F.get("embedding", F.lit(i)) for i, n in enumerate(("vbf", "ggh", "top", "ww"))}
    return e.select("vec_id", *[c.alias(n) for n, c in S.strict_winner(scores).items()])


@query("q_masked_variable", with_ctes(f"""
SELECT event, {rs('CASE WHEN p > 30 THEN e ELSE e - CAST(9999.9 AS DOUBLE) END')} AS under,
  {rs('CASE WHEN p > 30 THEN e ELSE 0 END')} AS zeroed
FROM (SELECT event, coalesce(j1_eta, -99) AS e, coalesce(j1_pt, 0) AS p FROM ev LEFT JOIN wide USING (event))""", "ev", "wide"))
def q_masked_variable(spark, sf_dir):
    rec = T.records(spark, sf_dir, "left", want={"jet": 1}, fields=["pt", "eta"])
    eta, pt = A.alt(F.col("jet.eta"), 0, -99.0), A.alt(F.col("jet.pt"), 0, 0.0)
    return rec.select("event", r(S.shifted_unless(eta, pt > 30)).alias("under"),
                      r(S.masked(eta, pt > 30, 0.0)).alias("zeroed"))


@query("q_filter_then_index", with_ctes("""
SELECT ev.event, coalesce(max(CASE WHEN k = 1 THEN pt END), -1) AS first, coalesce(max(CASE WHEN k = 2 THEN pt END), -1) AS second
FROM ev LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event ORDER BY idx) AS k FROM obj
                   WHERE kind = 'jet' AND abs(eta) < 1.2) USING (event) GROUP BY ev.event""", "ev", "obj"))
def q_filter_then_index(spark, sf_dir):
    """The mask is applied before ranking, so the pair is found among all jets of the event."""
    from binloom.operators.collect import rank_objects
    central = T.items(spark, sf_dir).filter("kind = 'jet'").filter(F.abs("eta") < 1.2)
    top = rank_objects(central, ["event"], T.ORDER, 2).groupBy("event").agg(
        *[F.max(F.when(F.col("idx") == i, F.col("pt"))).alias(n) for i, n in enumerate(("first", "second"))])
    return T.ev(spark, sf_dir).select("event").join(top, "event", "left").fillna(-1.0, ["first", "second"])


@query("q_nested_gather", with_ctes("""
SELECT event, coalesce(CASE i WHEN 0 THEN j1_pt WHEN 1 THEN j2_pt WHEN 2 THEN j3_pt WHEN 3 THEN j4_pt END, -2) AS near
FROM (SELECT *, CASE WHEN nlep >= 1 THEN l1_flavour - 2 ELSE -1 END AS i FROM ev LEFT JOIN wide USING (event))""", "ev", "wide"))
def q_nested_gather(spark, sf_dir):
    rec = T.records(spark, sf_dir, "left", fields=["pt", "flavour"])
    i = F.coalesce(F.get("lep", F.lit(0))["flavour"] - 2, F.lit(-1))
    return rec.select("event", A.alt(F.col("jet.pt"), i, -2.0).alias("near"))


@query("q_flag_product", with_ctes("""
SELECT event, coalesce(total > 50 AND priority <> '3-MEDIUM' AND weight >= 0 AND l1_pt > 20, false) AS good
FROM ev LEFT JOIN wide USING (event)""", "ev", "wide"))
def q_flag_product(spark, sf_dir):
    rec = T.records(spark, sf_dir, "left", want={"lep": 1}, fields=["pt"])
    good = ((F.col("total") > 50) & (F.col("priority") != "3-MEDIUM") & (F.col("weight") >= 0)
            & (A.alt(F.col("lep.pt"), 0, 0.0) > 20))
    return rec.select("event", good.alias("good"))


@query("q_trigger_priority", """
SELECT CASE WHEN emu THEN 'MuonEG' WHEN mu THEN 'Muon' WHEN el THEN 'EGamma' END AS stream, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT value, event_type IN ('purchase', 'signup') AS emu, event_type IN ('signup', 'click') OR value > 100 AS mu,
        event_type IN ('click', 'view') AND value > 20 AS el FROM events)
WHERE emu OR mu OR el GROUP BY ALL""")
def q_trigger_priority(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    stream = S.trigger_priority([("MuonEG", kind.isin("purchase", "signup")),
                                 ("Muon", kind.isin("signup", "click") | (value > 100)),
                                 ("EGamma", kind.isin("click", "view") & (value > 20))])
    return e.select(stream.alias("stream"), "value").filter("stream IS NOT NULL").groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


VETO = BinnedMap((-5.2, -1.8, -0.3, 1.3, 5.2), (-3.2, -1.0, 0.9, 3.2),
                 ((0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0)))


@query("q_veto_map", with_ctes(f"""
SELECT event, sample FROM ev WHERE event NOT IN (SELECT event FROM items WHERE kind = 'jet' AND score < 0.9 AND pt > 15
  AND {map_sql(VETO, 'greatest(least(eta, 5.19), -5.19)', 'greatest(least(phi, CAST(3.1415 AS DOUBLE)), CAST(-3.1415 AS DOUBLE))')} <> 0)""",
    "ev", "items"))
def q_veto_map(spark, sf_dir):
    jets = T.items(spark, sf_dir).filter("kind = 'jet'")
    hit = veto.map_hit(jets, VETO, F.col("score"))
    return veto.veto_events(T.ev(spark, sf_dir).select("event", "sample"), jets, hit, "event")


@query("q_hole_veto", with_ctes("""
SELECT event, sample FROM ev WHERE event NOT IN (SELECT event FROM items
  WHERE kind = 'lepton' AND eta > -2.3 AND eta < -1.2 AND phi > -1.57 AND phi < -0.87)""", "ev", "items"))
def q_hole_veto(spark, sf_dir):
    leptons = T.items(spark, sf_dir).filter("kind = 'lepton'")
    hit = S.in_box(F.col("eta"), F.col("phi"), -2.3, -1.2, -1.57, -0.87)
    return veto.veto_events(T.ev(spark, sf_dir).select("event", "sample"), leptons, hit, "event")


@query("q_lepton_wp", with_ctes("""
SELECT event, ((abs(l1_pdgId) = 13 AND l1_score > 0.82) OR (abs(l1_pdgId) = 11 AND l1_score > 0.9)) AS wp1,
  ((abs(l1_pdgId) = 13 AND l1_score > 0.82) OR (abs(l1_pdgId) = 11 AND l1_score > 0.9))
  AND ((abs(l2_pdgId) = 13 AND l2_score > 0.82) OR (abs(l2_pdgId) = 11 AND l2_score > 0.9)) AS wp2
FROM rec WHERE nlep >= 2""", "rec"))
def q_lepton_wp(spark, sf_dir):
    rec = T.records(spark, sf_dir, want={"lep": 2}, fields=["pt", "pdgId", "score"]).filter(F.size("lep") == 2)
    wp = [S.flavour_threshold(F.get("lep", F.lit(i))["pdgId"], F.get("lep", F.lit(i))["score"], 0.90, 0.82) for i in (0, 1)]
    return rec.select("event", wp[0].alias("wp1"), (wp[0] & wp[1]).alias("wp2"))


@query("q_hardjets", with_ctes("""
SELECT event, j1_flavour >= 4 AND j2_flavour >= 4 AND j1_pt > 25 AND j2_pt > 25 AS hard,
  NOT (j1_flavour >= 4 AND j2_flavour >= 4 AND j1_pt > 25 AND j2_pt > 25) AS pileup, nh AS n_hard
FROM rec JOIN (SELECT event, count(*) FILTER (flavour >= 4 AND pt > 25) AS nh FROM items WHERE kind='jet' GROUP BY event) USING (event)
WHERE njet >= 2""", "rec"))
def q_hardjets(spark, sf_dir):
    """Leading pair matched to generator jets above 25, and the number of matched jets."""
    rec = T.records(spark, sf_dir, want={"jet": 2}, fields=["pt", "flavour"]).filter(F.size("jet") == 2)
    matched = F.forall("jet", lambda j: (j["flavour"] >= 4) & (j["pt"] > 25))
    n = T.items(spark, sf_dir).filter("kind = 'jet'").groupBy("event").agg(
        F.count_if((F.col("flavour") >= 4) & (F.col("pt") > 25)).alias("n_hard"))
    return rec.select("event", matched.alias("hard"), (~matched).alias("pileup")).join(n, "event")
