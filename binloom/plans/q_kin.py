"""Kinematics of leading objects, cleaning, dressing and fiducial selection."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from binloom.functions import arrays as A, events as E, kinematics as K
from binloom.operators import objects as O
from binloom.operators.ancestry import mother_pt as shared_mother, with_ancestor
from binloom.operators.collect import rank_objects
from binloom.operators.joins import clean_objects
from binloom.plans.registry import dr2_sql, mass_sql, p4_sql, query, r, rs, with_ctes, wrap_sql
from binloom.session import stage
from binloom.sources import driver_tables as T

KIN = ["pt", "eta", "phi"]


def rec(spark, sf_dir, nlep=0, njet=0, fields=None, how="inner", **want):
    df = T.records(spark, sf_dir, how, want=want or {"lep": 3, "jet": 4}, fields=fields or KIN)
    if nlep:
        df = df.filter(F.size("lep") >= nlep)
    if njet:
        df = df.filter(F.size("jet") >= njet)
    return df


def m0(*objs):
    """Mass of massless objects; the shared SQL uses the mass column, so give it as zero."""
    s = mass_sql(*objs)
    for o in objs:
        s = s.replace(f"{o}_mass*{o}_mass", "0")
    return s


def columns(df, arr, names, digits=6):
    return df.select("event", *[r(F.get(arr, F.lit(i)), digits).alias(n) for i, n in enumerate(names)])


LJ = ["l1j1", "l1j2", "l2j1", "l2j2"]


def mlj(lep, jet):
    return mass_sql(lep, jet).replace(f"{lep}_mass*{lep}_mass", "0")


@query("q_pair_mass", with_ctes("SELECT event, " + ", ".join(
    f"{rs(mlj(n[:2], n[2:]), 4)} AS {n}" for n in LJ) + " FROM rec WHERE nlep >= 2 AND njet >= 2", "rec"))
def pair_mass(spark, sf_dir):
    return columns(rec(spark, sf_dir, 2, 2, KIN + ["mass"], lep=2, jet=2), E.mass_grid(F.col("lep"), F.col("jet")), LJ, 4)


@query("q_dr_grid", with_ctes("SELECT event, " + ", ".join(
    f"{rs('sqrt(' + dr2_sql(n[:2], n[2:], wrap=False) + ')')} AS {n}" for n in LJ) + " FROM rec WHERE nlep >= 2 AND njet >= 2", "rec"))
def dr_grid(spark, sf_dir):
    return columns(rec(spark, sf_dir, 2, 2, lep=2, jet=2), E.dr_grid(F.col("lep"), F.col("jet")), LJ)


@query("q_away_jet", with_ctes("SELECT event, " + ", ".join(
    f"{rs(f'CASE WHEN nlep >= 1 AND njet >= 1 AND j1_pt > {t} AND abs(j1_eta) < 2.5 THEN sqrt({dr2_sql(chr(106) + chr(49), chr(108) + chr(49))}) ELSE -999 END')} AS dr_{t}"
    for t in (15, 25, 35, 45)) + " FROM every", "every"))
def away_jet(spark, sf_dir):
    df = rec(spark, sf_dir, how="left", lep=1, jet=1)
    return df.select("event", *[r(E.away_jet_dr(F.col("lep"), F.col("jet"), t)).alias(f"dr_{t}") for t in (15, 25, 35, 45)])


def _proxy(i):
    v = p4_sql(f"l{i}")
    e = f"({v['e'].replace(f'l{i}_mass*l{i}_mass', '0')} + met)"
    m2 = f"({e}*{e} - ({v['px']}+met)*({v['px']}+met) - {v['py']}*{v['py']} - {v['pz']}*{v['pz']})"
    return rs(f"CASE WHEN {m2} >= 0 THEN sqrt(abs({m2})) ELSE -sqrt(abs({m2})) END", 3)


@query("q_proxy_mass", with_ctes(f"""
SELECT event, {_proxy(1)} AS m1, {_proxy(2)} AS m2 FROM (SELECT *, total/CAST(4 AS DOUBLE) AS met FROM rec WHERE nlep >= 2)""", "rec"))
def proxy_mass(spark, sf_dir):
    df = rec(spark, sf_dir, 2, lep=2)
    return columns(df, E.proxy_masses(F.col("lep"), F.col("total") / 4.0, F.lit(0.0)), ["m1", "m2"], 3)


SGN = "(sign(l1_pdgId) + sign(l2_pdgId) + sign(l3_pdgId))"
OK3 = f"(nlep >= 3 AND abs({SGN}) <= 1)"


@query("q_trilepton", with_ctes(f"""
SELECT event, CAST(CASE WHEN {OK3} THEN {SGN} ELSE -9999 END AS DOUBLE) AS charge,
  {rs(f"CASE WHEN {OK3} THEN {m0('l1', 'l2', 'l3')} ELSE -9999 END", 4)} AS mass FROM every""", "every"))
def trilepton(spark, sf_dir):
    df = rec(spark, sf_dir, how="left", fields=KIN + ["pdgId"], lep=3)
    return df.select("event", E.trilepton_charge(F.col("lep")).alias("charge"), r(E.trilepton_mass(F.col("lep")), 4).alias("mass"))


PAIRS = [("l1", "l2"), ("l1", "l3"), ("l2", "l3")]


@query("q_best_pair", with_ctes(f"""
SELECT event, {rs("CASE WHEN " + OK3 + " THEN least(9999, " + ", ".join(
        f"CASE WHEN {a}_pdgId + {b}_pdgId = 0 THEN abs({m0(a, b)} - 91.1876) ELSE 9999 END" for a, b in PAIRS) + ") ELSE 9999 END", 3)} AS zdist,
  {OK3} AND ({" OR ".join(f"{a}_pdgId + {b}_pdgId = 0" for a, b in PAIRS)}) AS ossf FROM every WHERE nlep >= 3
UNION ALL SELECT event, CAST(9999 AS DOUBLE), false FROM every WHERE nlep < 3""", "every"))
def best_pair(spark, sf_dir):
    df = rec(spark, sf_dir, how="left", fields=KIN + ["pdgId"], lep=3)
    return df.select("event", r(E.z_distance(F.col("lep")), 3).alias("zdist"), E.has_ossf(F.col("lep")).alias("ossf"))


@query("q_os_masses", with_ctes("SELECT event, " + ", ".join(
    f"{rs(f'CASE WHEN {OK3} AND {a}_pdgId * {b}_pdgId < 0 THEN {m0(a, b)} ELSE -9999 END', 3)} AS m{i}"
    for i, (a, b) in enumerate(PAIRS)) + " FROM every", "every"))
def os_masses(spark, sf_dir):
    df = rec(spark, sf_dir, how="left", fields=KIN + ["pdgId"], lep=3)
    return columns(df, E.opposite_sign_masses(F.col("lep")), ["m0", "m1", "m2"], 3)


DPHI = f"CASE WHEN njet > 1 THEN {wrap_sql('(CASE WHEN j1_eta > j2_eta THEN j1_phi - j2_phi ELSE j2_phi - j1_phi END)')} ELSE -9999 END"


@query("q_signed_dphi", with_ctes(f"SELECT event, {rs(DPHI)} AS dphi FROM every", "every"))
def signed_dphi(spark, sf_dir):
    return rec(spark, sf_dir, how="left", jet=2).select("event", r(E.signed_dphi(F.col("jet"))).alias("dphi"))


@query("q_gaussian", with_ctes(f"""
SELECT event, line, part, supp, {rs('exp(-((pt - 45) / 15) * ((pt - 45) / 15) / 2)', 9)} AS near FROM items WHERE kind = 'lepton'""", "items"))
def gaussian(spark, sf_dir):
    """How near each lepton's momentum is to a peak: a Gaussian of height 1."""
    leps = T.items(spark, sf_dir).filter("kind = 'lepton'")
    return leps.select("event", "line", "part", "supp", r(K.gaussian(F.col("pt"), 45.0, 15.0), 9).alias("near"))


@query("q_dphi_wrap", with_ctes(f"""
SELECT event, {rs(wrap_sql('(l1_phi - l2_phi)'))} AS dphi_ll, {rs('sqrt(' + dr2_sql('l1', 'l2') + ')')} AS dr_ll FROM rec WHERE nlep >= 2""", "rec"))
def dphi_wrap(spark, sf_dir):
    a, b = (F.get("lep", F.lit(i)) for i in (0, 1))
    return rec(spark, sf_dir, 2, lep=2).select(
        "event", r(K.delta_phi(a["phi"], b["phi"])).alias("dphi_ll"), r(F.sqrt(K.dr2_objects(a, b))).alias("dr_ll"))


# a lepton points into its flavour's collection by (flavour code - 3); jets play the collections
IDX = "({o}_flavour - 3)"


def _gather(o, which, missing):
    e = " ".join(f"WHEN {i} THEN j{i + 1}_{{f}}" for i in range(4))
    src = {"e": e.format(f="score"), "m": e.format(f="eta")}
    i = IDX.format(o=o)
    return (f"CASE WHEN {o}_pt IS NULL THEN NULL WHEN abs({o}_pdgId) = 11 THEN coalesce(CASE {i} {src['e']} END, {missing}) "
            f"ELSE coalesce(CASE {i} {src['m']} END, {missing}) END")


def _by_flavour(missing):
    return E.by_flavour(F.col("lep"), F.transform("jet", lambda j: j["score"]), F.transform("jet", lambda j: j["eta"]),
                        missing, lambda x: x["flavour"] - 3)


LJ_FIELDS = KIN + ["pdgId", "flavour", "score"]


@query("q_flavour_gather", with_ctes(f"""
SELECT event, {rs(_gather('l1', 'e', -9999))} AS s1, {rs(f"coalesce({_gather('l2', 'e', -9999)}, -1)")} AS s2
FROM rec WHERE nlep >= 1""", "rec"))
def flavour_gather(spark, sf_dir):
    df = rec(spark, sf_dir, 1, fields=LJ_FIELDS).withColumn("v", _by_flavour(-9999.0))
    return df.select("event", r(A.alt(F.col("v"), 0, -1.0)).alias("s1"), r(A.alt(F.col("v"), 1, -1.0)).alias("s2"))


@query("q_conept", with_ctes(f"""
SELECT event, {rs(f"CAST(0.9 AS DOUBLE)*l1_pt*(1+{_gather('l1', 'e', 0)})", 9)} AS c1,
  {rs(f"coalesce(CAST(0.9 AS DOUBLE)*l2_pt*(1+{_gather('l2', 'e', 0)}), -1)", 9)} AS c2 FROM rec WHERE nlep >= 1""", "rec"))
def conept(spark, sf_dir):
    df = rec(spark, sf_dir, 1, fields=LJ_FIELDS).withColumn("iso", _by_flavour(0.0))
    cone = F.zip_with("lep", "iso", lambda x, iso: E.cone_pt(x["pt"], iso))
    return df.select("event", r(A.alt(cone, 0, -1.0), 9).alias("c1"), r(A.alt(cone, 1, -1.0), 9).alias("c2"))


GAP, SPREAD = "abs(j1_eta - j2_eta)", "(abs(2*l1_eta - j1_eta - j2_eta) + abs(2*l2_eta - j1_eta - j2_eta))"


@query("q_centrality", with_ctes(f"""
SELECT event, {rs('0.5e0*abs((l1_eta + l2_eta) - (j1_eta + j2_eta))')} AS zepp_ll,
  {rs(f'coalesce((l1_eta - 0.5e0*(j1_eta + j2_eta))/nullif({GAP}, 0), -99)')} AS zepp_lead,
  {rs(f'CASE WHEN {GAP} <> 0 AND {SPREAD} > 0 THEN ln({SPREAD}/nullif({GAP},0)) WHEN {GAP} <> 0 THEN -99 ELSE -1 END')} AS ctot
FROM rec WHERE nlep >= 2 AND njet >= 2""", "rec"))
def q_centrality(spark, sf_dir):
    df = rec(spark, sf_dir, 2, 2, ["pt", "eta"], lep=2, jet=2)
    l1, l2, j1, j2 = (F.get(c, F.lit(i))["eta"] for c in ("lep", "jet") for i in (0, 1))
    return df.select("event", r(0.5 * F.abs((l1 + l2) - (j1 + j2))).alias("zepp_ll"),
                     r(F.coalesce(E.zeppenfeld(l1, j1, j2), F.lit(-99.0))).alias("zepp_lead"),
                     r(F.coalesce(E.centrality(l1, l2, j1, j2), F.lit(-99.0))).alias("ctot"))


@query("q_pt_ratio", with_ctes(f"""
SELECT event, {rs('l1_pt*l2_pt/(j1_pt*j2_pt)')} AS rpt FROM rec WHERE nlep >= 2 AND njet >= 2""", "rec"))
def pt_ratio(spark, sf_dir):
    l1, l2, j1, j2 = (F.get(c, F.lit(i))["pt"] for c in ("lep", "jet") for i in (0, 1))
    return rec(spark, sf_dir, 2, 2, ["pt"], lep=2, jet=2).select("event", r(F.try_divide(l1 * l2, j1 * j2)).alias("rpt"))


@query("q_lhe_mjj", with_ctes(f"""
SELECT event, {rs('sqrt(2*j1_pt*j2_pt*(cosh(j1_eta - j2_eta) - cos(j1_phi - j2_phi)))', 3)} AS mjj FROM rec WHERE njet >= 2""", "rec"))
def lhe_mjj(spark, sf_dir):
    a, b = (F.get("jet", F.lit(i)) for i in (0, 1))
    return rec(spark, sf_dir, 0, 2, jet=2).select("event", r(E.pair_mass_massless(a, b), 3).alias("mjj"))


def jets_flat(spark, sf_dir):
    return T.items(spark, sf_dir).filter("kind = 'jet'")


def cleaned_jets(spark, sf_dir, cone):
    leptons = T.items(spark, sf_dir).filter("kind = 'lepton' AND pt >= 10").select("event", "eta", "phi")
    return clean_objects(jets_flat(spark, sf_dir).select("event", *KIN, "mass", "score", "line", "part", "supp", "ship"),
                         leptons, "event", cone)


OVERLAP = """SELECT j.* FROM items j WHERE j.kind = 'jet' AND NOT EXISTS (SELECT 1 FROM items lep WHERE lep.event = j.event
  AND lep.kind = 'lepton' AND lep.pt >= 10 AND {d} < {c})"""
_D = dr2_sql("L", "J").replace("L_eta", "lep.eta").replace("L_phi", "lep.phi").replace("J_eta", "j.eta").replace("J_phi", "j.phi")


@query("q_overlap_removal", with_ctes("""
SELECT event, count(*) AS njet, max(pt) AS lead, round(sum(pt), 6) AS ht FROM clean GROUP BY event""",
    "lep", clean=OVERLAP.format(d=_D, c=0.09)))
def overlap_removal(spark, sf_dir):
    return cleaned_jets(spark, sf_dir, 0.3).groupBy("event").agg(
        F.count(F.lit(1)).alias("njet"), F.max("pt").alias("lead"), F.round(F.sum("pt"), 6).alias("ht"))


@query("q_gen_dphi", with_ctes(f"""
SELECT ev.event, {rs(f"CASE WHEN e2 IS NULL THEN -9999 ELSE {wrap_sql('(CASE WHEN e1 > e2 THEN p1 - p2 ELSE p2 - p1 END)')} END")} AS dphi FROM ev LEFT JOIN (
  SELECT event, max(CASE WHEN k=1 THEN eta END) AS e1, max(CASE WHEN k=2 THEN eta END) AS e2,
    max(CASE WHEN k=1 THEN phi END) AS p1, max(CASE WHEN k=2 THEN phi END) AS p2 FROM (
    SELECT *, row_number() OVER (PARTITION BY event ORDER BY pt DESC, line, part, supp, ship) AS k FROM clean WHERE pt >= 30) GROUP BY event) USING (event)""",
    "ev", "items", clean=OVERLAP.format(d=_D, c=0.16)))
def gen_dphi(spark, sf_dir):
    """Leading pair of the jets left after cleaning; ranked after cleaning, so none is lost.  Every event has its row."""
    two = rank_objects(cleaned_jets(spark, sf_dir, 0.4).filter("pt >= 30"), ["event"], T.ORDER, 2)
    jets = two.groupBy("event").agg(F.sort_array(F.collect_list(F.struct("idx", *KIN))).alias("jet"))
    return T.ev(spark, sf_dir).select("event").join(jets, "event", "left").select("event", r(E.signed_dphi(F.col("jet"))).alias("dphi"))


_DP = dr2_sql("L", "P").replace("L_eta", "l.eta").replace("L_phi", "l.phi").replace("P_eta", "p.eta").replace("P_phi", "p.phi")
_V = {k: v.replace("o_", "") for k, v in p4_sql("o").items()}
DRESSED = dict(
    al="SELECT * FROM obj WHERE kind = 'lepton'",
    near=f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY event, line, part, supp, ship, pt, eta, phi, mass ORDER BY d2, l) AS k FROM (
      SELECT p.*, l.idx AS l, {_DP} AS d2 FROM (SELECT * FROM items WHERE kind='jet' AND flavour=0) p JOIN al l ON l.event = p.event)) WHERE k = 1 AND d2 < 0.09""",
    parts=f"""SELECT event, l AS idx, {_V['px']} AS px, {_V['py']} AS py, {_V['pz']} AS pz FROM near
      UNION ALL SELECT event, idx, {_V['px']}, {_V['py']}, {_V['pz']} FROM al""",
    drl="""SELECT event, idx, sqrt(px*px+py*py) AS pt, atan2(py,px) AS phi, asinh(pz/sqrt(px*px+py*py)) AS eta FROM (
      SELECT event, idx, sum(px) AS px, sum(py) AS py, sum(pz) AS pz FROM parts GROUP BY ALL)""")


def dressed_leptons(spark, sf_dir):
    """All leptons of an event, with photons (jets without flavour) within 0.3 added to the nearest."""
    objects = T.items(spark, sf_dir).select("event", *KIN, "mass", "kind", "flavour", *T.ORDER[1:])
    leptons = objects.filter("kind = 'lepton'").drop("kind", "flavour")
    return O.dress(leptons, objects.filter("kind = 'jet' AND flavour = 0"), "event", T.ORDER, 0.09)


@query("q_dressed_leptons", with_ctes(f"""
SELECT event, count(*) AS n, {rs('max(pt)')} AS lead, {rs('sum(pt)')} AS ht, {rs('sum(eta)')} AS eta, {rs('sum(pt * cos(phi))')} AS px FROM drl GROUP BY event""",
    "obj", **DRESSED))
def dressed(spark, sf_dir):
    return dressed_leptons(spark, sf_dir).groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), r(F.max("pt")).alias("lead"), r(F.sum("pt")).alias("ht"), r(F.sum("eta")).alias("eta"),
        r(F.sum(F.col("pt") * F.cos("phi"))).alias("px"))


@query("q_dressing", with_ctes("""
SELECT ev.event, coalesce(n_jets, 0) AS n_jets FROM ev LEFT JOIN (
  SELECT j.event, count(*) FILTER (NOT EXISTS (SELECT 1 FROM drl d WHERE d.event = j.event AND d.pt >= 10
    AND ((d.eta-j.eta)*(d.eta-j.eta) + """ + wrap_sql("(d.phi-j.phi)") + "*" + wrap_sql("(d.phi-j.phi)") + """) < 0.016)) AS n_jets
  FROM items j WHERE j.kind = 'jet' AND j.flavour <> 0 AND j.pt >= 30 GROUP BY j.event) USING (event)""", "ev", "obj", **DRESSED))
def dressing(spark, sf_dir):
    """Jets above 30 away from every dressed lepton; every event has its row."""
    others = dressed_leptons(spark, sf_dir).filter("pt >= 10")
    jets = jets_flat(spark, sf_dir).filter("flavour <> 0 AND pt >= 30").select("event", *KIN)
    kept = clean_objects(jets, others, "event", math.sqrt(0.016), cut2=0.016).groupBy("event").agg(F.count(F.lit(1)).alias("n_jets"))
    return T.ev(spark, sf_dir).select("event").join(kept, "event", "left").select("event", F.coalesce("n_jets", F.lit(0)).alias("n_jets"))


# the whole event as a generator record, in falling pt; a mother stands before her daughters
GEN = """SELECT *, CASE part % 4 WHEN 0 THEN 23 WHEN 1 THEN -pdgId WHEN 2 THEN pdgId ELSE 15 END AS id,
    CASE WHEN i = 0 THEN -1 ELSE supp % (i + 1) - 1 END AS mother, supp % 32 AS flags
  FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY pt DESC, line, part, supp, ship) - 1 AS i FROM items)"""


def gen_record(spark, sf_dir, *more):
    """Flat records: event, idx, pt, pdgId, mother, flags."""
    rank = F.row_number().over(Window.partitionBy("event").orderBy(F.desc("pt"), *T.ORDER[1:])) - 1
    gen = T.items(spark, sf_dir).withColumn("lepton", F.expr("kind = 'lepton'")).withColumn("idx", rank)
    return gen.select("event", "idx", "pt", *more, F.expr("CASE part % 4 WHEN 0 THEN 23 WHEN 1 THEN -pdgId WHEN 2 THEN pdgId ELSE 15 END").alias("id"),
                      F.expr("IF(idx = 0, -1, cast(supp % (idx + 1) - 1 as int))").alias("mother"), (F.col("supp") % 32).cast("int").alias("flags"))


FID_V = {f"l{i}": p4_sql(f"l{i}") for i in (1, 2)}
TAU = dict(g=GEN, anc="""SELECT event, i, mother AS a FROM g WHERE mother >= 0
    UNION ALL SELECT anc.event, anc.i, g.mother FROM anc JOIN g ON g.event = anc.event AND g.i = anc.a WHERE g.mother >= 0""",
    tau="SELECT DISTINCT anc.event, anc.i FROM anc JOIN g ON g.event = anc.event AND g.i = anc.a WHERE abs(g.id) = 15")


@query("q_tau_ancestor", with_ctes("""
SELECT g.event, count(*) AS n, count(tau.i) AS n_tau, CAST(coalesce(min(CASE WHEN tau.i IS NULL AND g.kind = 'lepton' THEN g.i END), -1) AS INTEGER) AS first_prompt
FROM g LEFT JOIN tau ON tau.event = g.event AND tau.i = g.i GROUP BY g.event""", "items", **TAU).replace("WITH", "WITH RECURSIVE", 1))
def tau_ancestor(spark, sf_dir):
    """Particles that come from a tau, over any number of generations."""
    rec = with_ancestor(gen_record(spark, sf_dir, "kind"), "event", F.abs("id") == 15, "tau")
    return rec.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count_if("tau").alias("n_tau"),
                                    F.coalesce(F.min(F.when(~F.col("tau") & (F.col("kind") == "lepton"), F.col("idx"))), F.lit(-1)).alias("first_prompt"))


@query("q_fiducial", with_ctes(f"""
SELECT event, CAST(CASE WHEN l2_pt IS NULL OR j2_pt IS NULL OR l1_pdgId * l2_pdgId <> -143 THEN -9999
  WHEN l1_pt > 25 AND l2_pt > 13 AND coalesce(l3_pt, -1) < 10 AND {mass_sql('l1', 'l2')} > 12 AND sqrt(px*px+py*py) > 30
   AND j1_pt > 30 AND j2_pt > 30 AND {mass_sql('j1', 'j2')} > 120 AND abs(j1_eta) < 4.7 AND abs(j2_eta) < 4.7
   AND abs(l1_eta) < 2.5 AND abs(l2_eta) < 2.5 AND sqrt(2*sqrt(px*px+py*py)*met*(1-cos(atan2(py,px)))) >= 60 THEN 1 ELSE 0 END AS INTEGER) AS fid
FROM (SELECT ev.event, w.* EXCLUDE (event), c.* EXCLUDE (event), total/CAST(4 AS DOUBLE) AS met, {FID_V['l1']['px']} + {FID_V['l2']['px']} AS px, {FID_V['l1']['py']} + {FID_V['l2']['py']} AS py
  FROM ev LEFT JOIN lw w USING (event) LEFT JOIN cj c USING (event))""", "ev", "items", **TAU,
    pl="""SELECT *, row_number() OVER (PARTITION BY event ORDER BY i) AS k FROM g WHERE kind = 'lepton'
      AND NOT EXISTS (SELECT 1 FROM tau WHERE tau.event = g.event AND tau.i = g.i)""",
    lw="SELECT event, " + ", ".join(f"max(CASE WHEN k={i} THEN {f} END) AS l{i}_{f}" for i in (1, 2, 3) for f in KIN + ["mass", "pdgId"]) + " FROM pl GROUP BY event",
    clean=OVERLAP.format(d=_D, c=0.16).replace("items lep", "pl lep").replace("items j", "g j"),
    cj="SELECT event, " + ", ".join(f"max(CASE WHEN k={i} THEN {f} END) AS j{i}_{f}" for i in (1, 2) for f in KIN + ["mass"]) + """ FROM (
      SELECT *, row_number() OVER (PARTITION BY event ORDER BY i) AS k FROM clean WHERE pt >= 30) GROUP BY event""").replace("WITH", "WITH RECURSIVE", 1))
def fiducial(spark, sf_dir):
    """Leptons that come from a tau do not count; every event has its row.  lineitem is scanned once.

    Two leptons decide first: only where they are an electron and a muon of opposite charge are the event's jets cleaned.
    """
    rec = stage(gen_record(spark, sf_dir, *KIN[1:], "pdgId", "lepton").drop("flags"), "record")
    leptons = with_ancestor(rec, "event", F.abs("id") == 15, "tau", of=F.col("lepton"), staged=True).filter("NOT tau")
    event = Window.partitionBy("event")
    order = event.orderBy("idx")
    placed = leptons.select("event", *KIN, "pdgId", (F.row_number().over(order) - 1).alias("place"), (F.col("pdgId") * F.lead("pdgId").over(order)).alias("pair"))
    pair = F.max(F.when(F.col("place") == 0, F.col("pair"))).over(event)
    leptons = stage(placed.withColumn("pair", pair).filter("pair = -11 * 13 AND (place < 3 OR pt >= 10)").drop("pair"), "leptons")
    jets = rec.filter("NOT lepton AND pt >= 30").select("event", "idx", *KIN).join(leptons.filter("place = 0").select("event"), "event", "left_semi")
    jets = rank_objects(clean_objects(jets, leptons.filter("pt >= 10"), "event", 0.4), ["event"], ["idx"], 2, "place")

    def leading(objects, name, *more):
        return objects.groupBy("event").agg(F.sort_array(F.collect_list(F.struct("place", *KIN, F.expr(T.MASS).alias("mass"), *more))).alias(name))

    df = T.ev(spark, sf_dir).select("event", "total").join(leading(leptons.filter("place < 3"), "lep", "pdgId"), "event", "left").join(leading(jets, "jet"), "event", "left")
    return df.select("event", O.fiducial_flag(F.col("lep"), F.col("jet"), F.col("total") / 4.0, F.lit(0.0)).alias("fid"))


@query("q_mother_pt", with_ctes("""
SELECT ev.event, coalesce((SELECT m.pt FROM c a JOIN g m ON m.event = a.event AND m.i = a.mother
    WHERE a.event = ev.event AND (CASE WHEN z.has THEN a.mid = 23 ELSE a.mother = 0 END)
      AND EXISTS (SELECT 1 FROM c b WHERE b.event = a.event AND b.i > a.i AND b.mother = a.mother)
    ORDER BY a.i LIMIT 1), ev.total) AS zpt
FROM ev LEFT JOIN (SELECT event, bool_or(mid = 23) AS has FROM c GROUP BY event) z USING (event)""", "ev", "items", g=GEN,
    c="""SELECT a.*, coalesce(m.id, 0) AS mid FROM g a LEFT JOIN g m ON m.event = a.event AND m.i = a.mother
      WHERE abs(a.id) IN (11, 13, 15) AND a.flags & 29 <> 0"""))
def mother_pt(spark, sf_dir):
    """Records of any length; the mother is an index into the same record.  Every event has its row."""
    found = shared_mother(gen_record(spark, sf_dir).withColumnRenamed("id", "pdgId"), "event")
    return T.ev(spark, sf_dir).join(found, "event", "left").select("event", F.coalesce("mother_pt", "total").alias("zpt"))


@query("q_leading_rank", with_ctes("SELECT event, pt, eta, CAST(idx AS INTEGER) AS idx FROM lep", "lep"))
def leading_rank(spark, sf_dir):
    leptons = T.items(spark, sf_dir).filter("kind = 'lepton'")
    return rank_objects(leptons, ["event"], T.ORDER, 3).select("event", "pt", "eta", "idx")
