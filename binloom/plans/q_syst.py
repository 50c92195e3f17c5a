"""Systematic variations: filled in the same pass, then combined as tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from binloom.config import Alias, Cut, Nuisance, Sample, Uniform, Variable

from binloom.functions.kinematics import transverse_mass
from binloom.functions.lookup import Curve
from binloom.functions.poisson import poisson_interval
from binloom.operators import histops, rates, variations as V
from binloom.operators.analysis import Analysis
from binloom.operators.collect import rank_objects, varied_collections, varied_leaders
from binloom.plans.q_hist import LEAD, hists, leading
from binloom.plans.registry import bin_sql, query, r, rs, with_ctes
from binloom.sources import driver_tables as T

AX = Uniform(10, 20.0, 120.0)
NB = AX.n
# weight factors exact in binary, so that sums agree to the last bit
WT = ("CASE WHEN score > 0.5 THEN 1.25D ELSE 0.75D END", "CASE WHEN score > 0.5 THEN 0.75D ELSE 1.25D END")
ENV = [f"CASE WHEN eta > {c} THEN {a}D ELSE {b}D END" for c, a, b in
       ((-1.3, 1.5, 0.5), (0.2, 0.5, 1.25), (0.7, 1.125, 0.875), (1.3, 2.0, 0.5))]
PDF = [f"CASE WHEN score > {c} THEN {1 + d}D ELSE {1 - d}D END" for c, d in
       ((0.1, 0.125), (0.3, 0.25), (0.45, -0.125), (0.55, 0.5), (0.7, -0.25), (0.9, 0.0625))]
NUIS = [Nuisance("scale", "suffix", "up", "do"), Nuisance("wt", "weight", *WT),
        Nuisance("qcd", "envelope", weights=tuple(ENV), samples=("SIG", "BKG")),
        Nuisance("pdf", "rms", weights=tuple(PDF), samples=("SIG",))]
CUTS = [Cut("sr", "hard > 60", {"plus": "pdgId < 0", "minus": "pdgId > 0"})]


def varied_events(spark, sf_dir):
    return leading(spark, sf_dir).withColumns({"pt_up": F.col("pt") * 1.02, "pt_do": F.col("pt") * 0.98})


def analysis(nuisances):
    return Analysis(aliases=[Alias("hard", "pt * 2")], cuts=CUTS, variables=[Variable("pt", "pt", AX, fold=3)],
                    nuisances=nuisances, preselection="pt > 15")


def syst_hists(spark, sf_dir, nuisances=None):
    return analysis(NUIS if nuisances is None else nuisances).histograms(varied_events(spark, sf_dir))


def _one(variation, pt="pt", factor="CAST(1 AS DOUBLE)", where="true"):
    w = f"weight * ({factor.replace('D ', ' ').replace('D', '') if 'CASE' in factor else factor})"
    if "CASE" in factor:
        w = "weight * (" + factor.replace("D ELSE", " ELSE").replace("D END", " END") + ")"
    return (f"SELECT sample, CASE WHEN pdgId < 0 THEN 'sr_plus' ELSE 'sr_minus' END AS cut, 'pt' AS variable, '{variation}' AS variation, "
            f"least(greatest({bin_sql(pt, NB, 20.0, 120.0)},1),{NB}) AS bin, CAST(0 AS INT) AS biny, "
            f"CAST(sum({w}) AS DOUBLE) AS sumw, CAST(sum(({w})*({w})) AS DOUBLE) AS sumw2, count(*) AS n "
            f"FROM lead WHERE {pt} > 15 AND abs(weight) > 0 AND {pt}*2 > 60 AND {where} GROUP BY ALL")


UP, DO = "(pt * CAST(1.02 AS DOUBLE))", "(pt * CAST(0.98 AS DOUBLE))"
P_NOM = [_one("nominal")]
P_SCALE = [_one("scaleUp", UP), _one("scaleDown", DO)]
P_WT = [_one("wtUp", factor=WT[0]), _one("wtDown", factor=WT[1])]
P_ENV = [_one(f"qcd_{i}", factor=f, where="sample <> 'DATA'") for i, f in enumerate(ENV)]
P_PDF = [_one(f"pdf_{i}", factor=f, where="sample = 'SIG'") for i, f in enumerate(PDF)]
ALL_V = P_NOM + P_SCALE + P_WT + P_ENV + P_PDF


def hv(*parts):
    return {"lead": LEAD["lead"], "hv": " UNION ALL ".join(p for group in parts for p in group)}


B = "sample, cut, variable, bin, biny"


@query("q_syst_suffix", with_ctes("SELECT * FROM hv", "ev", "obj", **hv(P_NOM, P_SCALE)))
def syst_suffix(spark, sf_dir):
    return syst_hists(spark, sf_dir, NUIS[:1])


@query("q_syst_weight", with_ctes("SELECT * FROM hv", "ev", "obj", **hv(P_NOM, P_WT)))
def syst_weight(spark, sf_dir):
    return syst_hists(spark, sf_dir, NUIS[1:2])


@query("q_syst_all", with_ctes("SELECT * FROM hv", "ev", "obj", **hv(ALL_V)))
def syst_all(spark, sf_dir):
    """Shape, weight, envelope and replica variations from one pass."""
    return syst_hists(spark, sf_dir)


def _by_weight(variation, pt="pt"):
    """One variation where the pt decides the signal's weight and the background's part."""
    return (f"SELECT CASE WHEN sample = 'SIG' THEN 'SIG' WHEN p > 40 THEN 'BKG_hard' ELSE 'BKG_soft' END AS sample, 'all' AS cut, 'pt' AS variable, "
            f"'{variation}' AS variation, least(greatest({bin_sql('p', NB, 20.0, 120.0)},1),{NB}) AS bin, CAST(0 AS INT) AS biny, "
            f"sum(w) AS sumw, sum(w*w) AS sumw2, count(*) AS n FROM (SELECT *, CASE WHEN sample = 'SIG' THEN floor(p / 16) ELSE CAST(1 AS DOUBLE) END AS w "
            f"FROM (SELECT *, {pt} AS p FROM lead WHERE sample IN ('SIG', 'BKG'))) WHERE p > 15 AND w <> 0 GROUP BY ALL")


@query("q_syst_process", with_ctes(" UNION ALL ".join([_by_weight("nominal"), _by_weight("scaleUp", UP), _by_weight("scaleDown", DO)]),
                                   "ev", "obj", lead=LEAD["lead"]))
def syst_process(spark, sf_dir):
    """A shape variation that changes the event weight of one process and the sub-sample of another."""
    samples = [Sample("SIG", "kind = 'SIG'", weight="floor(pt / 16)"),
               Sample("BKG", "kind = 'BKG'", subsamples={"hard": "pt > 40", "soft": "pt <= 40"})]
    run = Analysis(samples=samples, cuts=[Cut("all", "true")], variables=[Variable("pt", "pt", AX, fold=3)],
                   nuisances=NUIS[:1], preselection="pt > 15")
    return run.histograms(varied_events(spark, sf_dir).withColumnRenamed("sample", "kind").drop("weight"))


_SIG, _BKG = "sample = 'SIG'", "sample = 'BKG'"
P_OWN = [_one("wtUp", factor=WT[0], where=_SIG), _one("wtDown", factor=WT[1], where=_SIG),
         _one("wtUp", factor="CAST(1.5 AS DOUBLE)", where=_BKG), _one("wtDown", factor="CAST(0.5 AS DOUBLE)", where=_BKG),
         _one("scaleUp", UP, where=_SIG), _one("scaleDown", DO, where=_SIG),
         _one("scaleUp", f"({UP} * CAST(1.5 AS DOUBLE))", where=_BKG), _one("scaleDown", f"({DO} * CAST(0.5 AS DOUBLE))", where=_BKG)]


@query("q_syst_by_sample", with_ctes("SELECT * FROM hv", "ev", "obj", **hv(P_NOM, P_OWN)))
def syst_by_sample(spark, sf_dir):
    """Each process with its own weight factors and its own scale of the varied columns."""
    return syst_hists(spark, sf_dir, [
        Nuisance("wt", "weight", by_sample={"SIG": WT, "BKG": ("1.5D", "0.5D")}),
        Nuisance("scale", "suffix", "up", "do", by_sample={"SIG": (1.0, 1.0), "BKG": (1.5, 0.5)})])


@query("q_syst_envelope", with_ctes(f"""
SELECT {B}, 'qcdUp' AS variation, max(sumw) AS sumw, coalesce(sum(sumw2) FILTER (variation='nominal'), 0) AS sumw2 FROM hv GROUP BY ALL
UNION ALL SELECT {B}, 'qcdDown', min(sumw), coalesce(sum(sumw2) FILTER (variation='nominal'), 0) FROM hv GROUP BY ALL""",
    "ev", "obj", **hv(P_NOM, P_ENV)))
def syst_envelope(spark, sf_dir):
    return V.envelope(syst_hists(spark, sf_dir, [NUIS[2]]), "qcd")


@query("q_syst_rms", with_ctes(f"""
SELECT {B}, variation, {rs('sumw', 8)} AS sumw, sumw2 FROM (
  SELECT {B}, 'pdfUp' AS variation, nom + d AS sumw, q AS sumw2 FROM t UNION ALL SELECT {B}, 'pdfDown', nom - d, q FROM t)""",
    "ev", "obj", **hv(P_NOM, P_PDF), t=f"""
SELECT {B}, n.sumw AS nom, n.sumw2 AS q, coalesce(sqrt(avg((v.sumw - n.sumw)*(v.sumw - n.sumw))), 0) AS d
FROM hv n LEFT JOIN hv v USING ({B}) WHERE n.variation = 'nominal' AND (v.variation LIKE 'pdf_%' OR (n.sample <> 'SIG' AND v.variation = 'nominal'))
GROUP BY ALL"""))
def syst_rms(spark, sf_dir):
    return V.rms(syst_hists(spark, sf_dir, [NUIS[3]]), "pdf").withColumn("sumw", r("sumw", 8))


# a hundred replica weights per event as one array; factors exact in binary
REPLICAS = 100
PDF_ARRAY = "transform(sequence(0, 99), i -> 1D + ((i * 37) % 64 - 32) / 256D * IF(score > (i % 10) / 10D, 1, -1))"
_PDF_I = ("(CAST(1 AS DOUBLE) + ((i * 37) % 64 - 32) / CAST(256 AS DOUBLE) * (CASE WHEN score > (i % 10) / CAST(10 AS DOUBLE) THEN 1 ELSE -1 END))")
P_HUNDRED = [_one("nominal"), _one("", factor=_PDF_I, where="sample = 'SIG'").replace("'' AS variation", "'pdf_' || i AS variation")
             .replace("FROM lead", "FROM lead, range(100) u(i)")]


@query("q_replicas", with_ctes("SELECT * FROM hv", "ev", "obj", **hv(P_HUNDRED)))
def replicas(spark, sf_dir):
    """Histograms of a hundred replicas from an array column of the event, one pass."""
    return replica_hists(spark, sf_dir)


def replica_hists(spark, sf_dir):
    events = varied_events(spark, sf_dir).withColumn("pdf", F.expr(PDF_ARRAY))
    factors = tuple(f"coalesce(get(pdf, {i}), 1D)" for i in range(REPLICAS))
    return analysis([Nuisance("pdf", "rms", weights=factors, samples=("SIG",))]).histograms(events)


@query("q_syst_rms_100", with_ctes(f"""
SELECT {B}, variation, {rs('sumw', 8)} AS sumw, sumw2 FROM (
  SELECT {B}, 'pdfUp' AS variation, nom + d AS sumw, q AS sumw2 FROM t UNION ALL SELECT {B}, 'pdfDown', nom - d, q FROM t)""",
    "ev", "obj", **hv(P_HUNDRED), t=f"""
SELECT {B}, n.sumw AS nom, n.sumw2 AS q, coalesce(sqrt(avg((v.sumw - n.sumw)*(v.sumw - n.sumw))), 0) AS d
FROM hv n LEFT JOIN hv v USING ({B}) WHERE n.variation = 'nominal' AND (v.variation LIKE 'pdf_%' OR (n.sample <> 'SIG' AND v.variation = 'nominal'))
GROUP BY ALL"""))
def syst_rms_100(spark, sf_dir):
    """nominal -/+ root mean square about it over a hundred replicas."""
    return V.rms(replica_hists(spark, sf_dir), "pdf").withColumn("sumw", r("sumw", 8))


TURN_ON = Curve((20.0, 60.0, 100.0), (0.5, 1.0, 0.8))


def _function_sql(variation, pt):
    x = "least(greatest(p, CAST(20 AS DOUBLE)), CAST(100 AS DOUBLE))"
    eff = " ".join(f"WHEN {x} <= {x1} THEN CAST({y0} AS DOUBLE) + ({x} - CAST({x0} AS DOUBLE)) * CAST({(y1 - y0) / (x1 - x0)!r} AS DOUBLE)"
                   for x0, x1, y0, y1 in zip(TURN_ON.xs, TURN_ON.xs[1:], TURN_ON.ys, TURN_ON.ys[1:]))
    values = {"mt": ("sqrt(2 * p * total * (1 - cos(eta)))", (12, 0.0, 240.0)), "eff": ("eff", (10, 0.5, 1.0))}
    return " UNION ALL ".join(
        f"SELECT sample, 'on' AS cut, '{v}' AS variable, '{variation}' AS variation, {bin_sql(f'({e})', *axis)} AS bin, CAST(0 AS INT) AS biny, "
        f"sum(weight) AS sumw, sum(weight*weight) AS sumw2, count(*) AS n FROM (SELECT *, CASE {eff} END AS eff FROM (SELECT *, {pt} AS p FROM lead)) "
        f"WHERE eff > 0.6 AND abs(weight) > 0 GROUP BY ALL" for v, (e, axis) in values.items())


@query("q_function_alias", with_ctes(" UNION ALL ".join(_function_sql(*v) for v in (("nominal", "pt"), ("scaleUp", UP), ("scaleDown", DO))),
                                     "ev", "obj", lead=LEAD["lead"]))
def function_alias(spark, sf_dir):
    """Aliases given as column functions, varied with the columns they ask for."""
    run = Analysis(aliases=[Alias("eff", lambda c: TURN_ON.at(c("pt"))),
                            Alias("mt", lambda c: transverse_mass(c("pt"), c("eta"), c("total"), F.lit(0.0)))],
                   cuts=[Cut("on", "eff > 0.6")], nuisances=NUIS[:1],
                   variables=[Variable("mt", "mt", Uniform(12, 0.0, 240.0)), Variable("eff", "eff", Uniform(10, 0.5, 1.0))])
    return run.histograms(varied_events(spark, sf_dir))


def nominal_yields(spark, sf_dir):
    return histops.yields(hists(spark, sf_dir), {"pt": 20})


YS = {**LEAD, "y": """SELECT sample, cut, variable, variation, sum(sumw) AS yield, sum(sumw2) AS yield2 FROM h
      WHERE bin BETWEEN 1 AND 20 GROUP BY ALL"""}
LNN = {"lumi": {"SIG": "1.025", "BKG": "1.025"}, "xs": {"SIG": "1.25/0.75"}}


@query("q_lnn", with_ctes(f"""
SELECT y.*, nuisance, {rs('yield*u', 8)} AS up, {rs('yield*d', 8)} AS down FROM y JOIN (VALUES
  ('lumi','SIG',CAST(1.025 AS DOUBLE),CAST(1 AS DOUBLE)/CAST(1.025 AS DOUBLE)),
  ('lumi','BKG',CAST(1.025 AS DOUBLE),CAST(1 AS DOUBLE)/CAST(1.025 AS DOUBLE)),
  ('xs','SIG',CAST(1.25 AS DOUBLE),CAST(0.75 AS DOUBLE))) f(nuisance, sample, u, d) USING (sample)""", "ev", "obj", **YS))
def lnn(spark, sf_dir):
    out = V.lnn(nominal_yields(spark, sf_dir), LNN)
    return out.withColumns({"up": r("up", 8), "down": r("down", 8)})


@query("q_lnn_as_shape", with_ctes(f"""
SELECT {B}, variation, {rs('sumw*f', 8)} AS sumw, {rs('sumw2*f*f', 8)} AS sumw2 FROM (SELECT * EXCLUDE (variation) FROM h) JOIN (VALUES
  ('SIG','xsUp',CAST(1.25 AS DOUBLE)), ('SIG','xsDown',CAST(0.75 AS DOUBLE)), ('BKG','xsUp',CAST(1.5 AS DOUBLE)),
  ('BKG','xsDown',1/CAST(1.5 AS DOUBLE))) f(sample, variation, f) USING (sample)""", "ev", "obj", **LEAD))
def lnn_as_shape(spark, sf_dir):
    out = V.lnn_as_shape(hists(spark, sf_dir), "xs", {"SIG": "1.25/0.75", "BKG": "1.5"})
    return out.withColumns({c: r(c, 8) for c in ("sumw", "sumw2")})


YV = {"yv": "SELECT sample, cut, variable, variation, sum(sumw) AS yield FROM hv WHERE bin BETWEEN 1 AND 10 GROUP BY ALL",
      "yp": """SELECT sample, cut, variable, coalesce(sum(yield) FILTER (variation='nominal'),0) AS nom,
        coalesce(sum(yield) FILTER (variation LIKE '%Up'),0) AS up, coalesce(sum(yield) FILTER (variation LIKE '%Down'),0) AS down
        FROM yv GROUP BY ALL"""}


def varied_yields(spark, sf_dir, which):
    return histops.yields(syst_hists(spark, sf_dir, [NUIS[which]]), {"pt": NB})


@query("q_shape_as_lnn", with_ctes(f"""
SELECT sample, cut, variable, CASE WHEN dull THEN NULL ELSE {rs('fu', 8)} END AS f_up, CASE WHEN dull THEN NULL ELSE {rs('fd', 8)} END AS f_down
FROM (SELECT *, abs(fu-1) < 5e-4 AND abs(fd-1) < 5e-4 AS dull FROM (
  SELECT sample, cut, variable, CASE WHEN nom > 0 AND up > 0 THEN 1 + (up-nom)/nom ELSE 1 END AS fu,
    CASE WHEN nom > 0 AND down > 0 THEN 1 + (down-nom)/nom ELSE 1 END AS fd FROM yp))""", "ev", "obj", **hv(P_NOM, P_SCALE), **YV))
def shape_as_lnn(spark, sf_dir):
    out = V.shape_as_lnn(varied_yields(spark, sf_dir, 0), "scale")
    return out.withColumns({c: r(c, 8) for c in ("f_up", "f_down")})


@query("q_shape_as_lnn_symm", with_ctes(f"""
SELECT sample, cut, variable, {rs('1+h', 8)} AS f_up, {rs('1-h', 8)} AS f_down FROM (
  SELECT *, ((CASE WHEN nom>0 AND up>0 THEN (up-nom)/nom/2 ELSE 0 END) - (CASE WHEN nom>0 AND down>0 THEN (down-nom)/nom/2 ELSE 0 END))/2 AS h FROM yp)""",
    "ev", "obj", **hv(P_NOM, P_WT), **YV))
def shape_as_lnn_symm(spark, sf_dir):
    out = V.shape_as_lnn(varied_yields(spark, sf_dir, 1), "wt", divisor=2.0, symmetrise=True)
    return out.withColumns({c: r(c, 8) for c in ("f_up", "f_down")})


WIDE = {"w": f"""SELECT {B}, coalesce(sum(sumw) FILTER (variation='nominal'),0) AS nom, coalesce(sum(sumw2) FILTER (variation='nominal'),0) AS q,
  coalesce(sum(sumw) FILTER (variation LIKE '%Up'),0) AS up, coalesce(sum(sumw) FILTER (variation LIKE '%Down'),0) AS down FROM hv GROUP BY ALL"""}


@query("q_symmetrise", with_ctes(f"""
SELECT {B}, 'scaleUp' AS variation, nom + (up-down)*0.5e0 AS sumw, q AS sumw2 FROM w
UNION ALL SELECT {B}, 'scaleDown', nom - (up-down)*0.5e0, q FROM w""", "ev", "obj", **hv(P_NOM, P_SCALE), **WIDE))
def symmetrise(spark, sf_dir):
    return V.symmetrise(syst_hists(spark, sf_dir, [NUIS[0]]), "scale")


@query("q_syst_scope", with_ctes("""
SELECT * FROM hv WHERE variation = 'nominal' OR (variation LIKE 'wt%' AND ((sample = 'SIG' AND cut = 'sr_plus') OR sample = 'BKG'))""",
    "ev", "obj", **hv(P_NOM, P_WT)))
def syst_scope(spark, sf_dir):
    declared = spark.createDataFrame(
        [("wt", "SIG", "sr_plus"), ("wt", "BKG", "sr_plus"), ("wt", "BKG", "sr_minus")], "nuisance string, sample string, cut string")
    return V.scope(syst_hists(spark, sf_dir, [NUIS[1]]), declared)


@query("q_rateparam", with_ctes("""
SELECT 'topnorm' AS parameter, cut, variable, sample, CAST(1.5 AS DOUBLE) AS initial, yield * 1.5e0 AS scaled FROM y WHERE sample='BKG' AND cut IN ('os','ss')
UNION ALL SELECT 'signorm', cut, variable, sample, CAST(1 AS DOUBLE), yield FROM y WHERE sample='SIG'""", "ev", "obj", **YS))
def rateparam(spark, sf_dir):
    return V.rate_parameters(nominal_yields(spark, sf_dir), {
        "topnorm": ({"BKG": 1.5}, ("os", "ss")), "signorm": ({"SIG": 1.0}, None)})


@query("q_stat_bbb", with_ctes(f"""
SELECT {B}, sample || '_ibin_' || bin || '_stat' AS nuisance, {rs('sumw + sqrt(sumw2)', 8)} AS up, {rs('sumw - sqrt(sumw2)', 8)} AS down
FROM h WHERE sample IN ('SIG','BKG') AND bin BETWEEN 1 AND 20""", "ev", "obj", **LEAD))
def stat_bbb(spark, sf_dir):
    out = V.stat_bin_by_bin(hists(spark, sf_dir), ["SIG", "BKG"], 20)
    return out.withColumns({c: r(c, 8) for c in ("up", "down")})


@query("q_stat_bbb_correlated", with_ctes(f"""
SELECT {B}, o || '_ibin_' || bin || '_stat' AS nuisance, {rs('sumw + sqrt(sumw2)', 8)} AS up, {rs('sumw - sqrt(sumw2)', 8)} AS down
FROM h JOIN (VALUES ('SIG','SIG'), ('BKG','BKG'), ('BKG','SIG')) c(s, o) ON h.sample = c.s WHERE bin BETWEEN 1 AND 20""", "ev", "obj", **LEAD))
def stat_bbb_correlated(spark, sf_dir):
    """The background's bins also move with the signal's nuisances."""
    out = V.stat_bin_by_bin(hists(spark, sf_dir), ["SIG", "BKG"], 20, {"SIG": ["BKG"]})
    return out.withColumns({c: r(c, 8) for c in ("up", "down")})


@query("q_stat_uni", with_ctes(f"""
SELECT {B}, sample || '_statUp' AS variation, {rs('sumw + sqrt(sumw2)', 8)} AS sumw, sumw2 FROM h WHERE sample = 'SIG'
UNION ALL SELECT {B}, sample || '_statDown', {rs('sumw - sqrt(sumw2)', 8)}, sumw2 FROM h WHERE sample = 'SIG'""", "ev", "obj", **LEAD))
def stat_uni(spark, sf_dir):
    return V.stat_unified(hists(spark, sf_dir), ["SIG"]).withColumn("sumw", r("sumw", 8))


@query("q_stat_auto", with_ctes(f"""
SELECT cut, variable, bin, biny, sumw, sumw2, {rs('n_eff', 8)} AS n_eff, CASE WHEN n_eff > 10 THEN 'gauss' ELSE 'poisson' END AS treatment
FROM (SELECT *, sumw*sumw/nullif(sumw2,0) AS n_eff FROM (SELECT cut, variable, bin, biny, sum(sumw) AS sumw, sum(sumw2) AS sumw2
  FROM h WHERE sample <> 'DATA' GROUP BY ALL))""", "ev", "obj", **LEAD))
def stat_auto(spark, sf_dir):
    return V.stat_auto(hists(spark, sf_dir), 10.0, ["SIG", "BKG"]).withColumn("n_eff", r("n_eff", 8))


@query("q_linear_template", with_ctes(f"""
SELECT 'SIG' AS sample, cut, variable, bin, biny, s.v AS variation, {rs("b + s.f*o", 8)} AS sumw, {rs('b2 + s.f*s.f*o2', 8)} AS sumw2 FROM (
  SELECT cut, variable, bin, biny, coalesce(sum(sumw) FILTER (sample='SIG'),0) AS b, coalesce(sum(sumw2) FILTER (sample='SIG'),0) AS b2,
    coalesce(sum(sumw) FILTER (sample='BKG'),0) AS o, coalesce(sum(sumw2) FILTER (sample='BKG'),0) AS o2 FROM h WHERE sample <> 'DATA' GROUP BY ALL),
  (VALUES ('vetoUp', CAST(0.1 AS DOUBLE)), ('vetoDown', CAST(-0.1 AS DOUBLE))) s(v, f)""", "ev", "obj", **LEAD))
def linear_template(spark, sf_dir):
    out = V.linear_template(hists(spark, sf_dir), "SIG", "BKG", 0.1, "veto")
    return out.withColumns({c: r(c, 8) for c in ("sumw", "sumw2")})


@query("q_rename_nuis", with_ctes("""
SELECT * FROM hv UNION ALL SELECT * REPLACE (replace(variation, 'wt', 'wt_2022') AS variation) FROM hv WHERE variation <> 'nominal'""",
    "ev", "obj", **hv(P_NOM, P_WT)))
def rename_nuis(spark, sf_dir):
    return V.rename(syst_hists(spark, sf_dir, [NUIS[1]]), {"wt": "wt_2022"}, keep_old=True)


@query("q_decorrelate", with_ctes("""
SELECT * REPLACE (CASE variation WHEN 'wtUp' THEN 'wt_' || cut || 'Up' WHEN 'wtDown' THEN 'wt_' || cut || 'Down' ELSE variation END AS variation) FROM hv""",
    "ev", "obj", **hv(P_NOM, P_WT)))
def decorrelate(spark, sf_dir):
    return V.decorrelate_by_cut(syst_hists(spark, sf_dir, [NUIS[1]]), ["wt"])


BAND = {"t": """SELECT cut, variable, bin, biny, coalesce(sum(sumw) FILTER (variation='nominal'),0) AS total,
  coalesce(sum(sumw2) FILTER (variation='nominal'),0) AS stat,
  coalesce(sum(sumw) FILTER (variation='scaleUp'),0) AS su, coalesce(sum(sumw) FILTER (variation='scaleDown'),0) AS sd,
  coalesce(sum(sumw) FILTER (variation='wtUp'),0) AS wu, coalesce(sum(sumw) FILTER (variation='wtDown'),0) AS wd
  FROM hv WHERE sample <> 'DATA' GROUP BY ALL""",
        "band": """SELECT cut, variable, bin, biny, total,
  sqrt(stat + CASE WHEN su > total THEN (su-total)*(su-total) ELSE (sd-total)*(sd-total) END + CASE WHEN wu > total THEN (wu-total)*(wu-total) ELSE (wd-total)*(wd-total) END) AS eu,
  sqrt(stat + CASE WHEN su > total THEN (sd-total)*(sd-total) ELSE (su-total)*(su-total) END + CASE WHEN wu > total THEN (wd-total)*(wd-total) ELSE (wu-total)*(wu-total) END) AS ed FROM t"""}


def band(spark, sf_dir):
    return V.error_band(syst_hists(spark, sf_dir, NUIS[:2]), ["scale", "wt"], ["SIG", "BKG"])


@query("q_error_band", with_ctes(f"SELECT cut, variable, bin, biny, total, {rs('eu', 8)} AS err_up, {rs('ed', 8)} AS err_down FROM band",
                                 "ev", "obj", **hv(P_NOM, P_SCALE, P_WT), **BAND))
def error_band(spark, sf_dir):
    return band(spark, sf_dir).withColumns({c: r(c, 8) for c in ("err_up", "err_down")})


@query("q_rel_band", with_ctes(f"""
SELECT cut, variable, bin, biny, {rs('CASE WHEN total<>0 THEN eu/total ELSE 0 END', 8)} AS rel_up,
  {rs('CASE WHEN total<>0 THEN ed/total ELSE 0 END', 8)} AS rel_down FROM band""",
    "ev", "obj", **hv(P_NOM, P_SCALE, P_WT), **BAND))
def rel_band(spark, sf_dir):
    out = V.relative_band(band(spark, sf_dir))
    return out.select("cut", "variable", "bin", "biny", *[r(c, 8).alias(c) for c in ("rel_up", "rel_down")])


@query("q_poisson_interval")
def q_poisson_interval(spark, sf_dir):
    data = hists(spark, sf_dir).filter("sample = 'DATA'").select("cut", "variable", "bin", "n")
    return poisson_interval(data, "n")


@query("q_syst_compare", with_ctes(f"""
SELECT {B}, nom AS nominal, up, down, {rs('up/nullif(nom,0)', 8)} AS ratio_up, {rs('down/nullif(nom,0)', 8)} AS ratio_down
FROM w WHERE NOT (cut = 'sr_plus' AND sample = 'DATA')""", "ev", "obj", **hv(P_NOM, P_WT), **WIDE))
def syst_compare(spark, sf_dir):
    out = V.compare(syst_hists(spark, sf_dir, [NUIS[1]]), "wt", (F.col("cut") == "sr_plus") & (F.col("sample") == "DATA"))
    return out.withColumns({c: r(c, 8) for c in ("ratio_up", "ratio_down")})


@query("q_variation_fallback", with_ctes("""
SELECT * FROM hv UNION ALL SELECT * REPLACE (v.variation AS variation) FROM (SELECT * FROM hv WHERE variation='nominal' AND sample='DATA') h,
  (VALUES ('qcd_0'), ('qcd_1')) v(variation)""", "ev", "obj", **hv(P_NOM, P_ENV[:2])))
def variation_fallback(spark, sf_dir):
    """Data have no alternative weights, so their varied histograms are the nominal ones."""
    only = Nuisance("qcd", "envelope", weights=tuple(ENV[:2]), samples=("SIG", "BKG"))
    return V.fallback_to_nominal(syst_hists(spark, sf_dir, [only]), ["qcd_0", "qcd_1"])


@query("q_clip_negative", with_ctes("SELECT * REPLACE (greatest(sumw, 0) AS sumw) FROM h", "ev", "obj", **LEAD))
def clip_negative(spark, sf_dir):
    return histops.clip_negative(hists(spark, sf_dir))


@query("q_remove_stat", with_ctes("SELECT * REPLACE (CASE WHEN sample='BKG' THEN 0 ELSE sumw2 END AS sumw2) FROM h", "ev", "obj", **LEAD))
def remove_stat(spark, sf_dir):
    return histops.remove_stat(hists(spark, sf_dir), ["BKG"])


@query("q_quadrature", with_ctes(f"""
SELECT cut, bin, {rs('sqrt(a*a + b*b)', 8)} AS error FROM (SELECT cut, bin, coalesce(sqrt(sum(sumw2) FILTER (sample='SIG')),0) AS a,
  coalesce(sqrt(sum(sumw2) FILTER (sample='BKG')),0) AS b FROM h GROUP BY ALL)""", "ev", "obj", **LEAD))
def quadrature(spark, sf_dir):
    def err(s):
        return F.coalesce(F.sqrt(F.sum(F.when(F.col("sample") == s, F.col("sumw2")))), F.lit(0.0))
    wide = hists(spark, sf_dir).groupBy("cut", "bin").agg(err("SIG").alias("a"), err("BKG").alias("b"))
    return wide.select("cut", "bin", r(histops.quadrature(F.col("a"), F.col("b")), 8).alias("error"))


NF = f"""SELECT sample, cut, variable, 'wt' AS nuisance, nom/nullif(up,0) AS norm_up, nom/nullif(down,0) AS norm_down FROM yp"""


@query("q_norm_factors", with_ctes(f"""
SELECT sample, cut, variable, nuisance, {rs('norm_up', 8)} AS norm_up, {rs('norm_down', 8)} AS norm_down FROM nf""",
    "ev", "obj", **hv(P_NOM, P_WT), **YV, nf=NF))
def norm_factors(spark, sf_dir):
    out = rates.norm_factors(varied_yields(spark, sf_dir, 1))
    return out.withColumns({c: r(c, 8) for c in ("norm_up", "norm_down")})


V_SQL = WT[0].replace("D ELSE", " ELSE").replace("D END", " END")


@query("q_norm_preserving_syst", with_ctes(f"""
SELECT sample, cut, {rs('sum(weight*v*norm_up)', 6)} AS up, {rs('sum(weight*(2-v)*norm_down)', 6)} AS down, sum(weight) AS nominal
FROM (SELECT *, CASE WHEN pdgId < 0 THEN 'sr_plus' ELSE 'sr_minus' END AS cut, {V_SQL} AS v FROM lead
  WHERE pt > 15 AND abs(weight) > 0 AND pt*2 > 60) JOIN nf USING (sample, cut) GROUP BY ALL""",
    "ev", "obj", **hv(P_NOM, P_WT), **YV, nf=NF))
def norm_preserving_syst(spark, sf_dir):
    """Second pass over events with the factors measured in the first."""
    norms = rates.norm_factors(varied_yields(spark, sf_dir, 1)).select("sample", "cut", "norm_up", "norm_down")
    rows = varied_events(spark, sf_dir).filter("pt > 15 AND abs(weight) > 0 AND pt * 2 > 60").select(
        "sample", "weight", F.expr("CASE WHEN pdgId < 0 THEN 'sr_plus' ELSE 'sr_minus' END").alias("cut"), F.expr(WT[0]).alias("v"))
    out = V.norm_preserving_yields(rows, "v", "weight", norms, ["sample", "cut"])
    return out.select("sample", "cut", r("up").alias("up"), r("down").alias("down"), "nominal")


# jet-energy sources with factors exact in binary: all jets, b jets, forward jets
SOURCES = {"Absolute": ("1.25D", "0.75D"), "FlavorQCD": ("IF(flavour = 5, 1.5D, 1D)", "IF(flavour = 5, 0.5D, 1D)"),
           "BBEC1": ("IF(abs(eta) > 1.3, 1.125D, 1D)", "IF(abs(eta) > 1.3, 0.875D, 1D)")}
SIDES = [("nominal", "1D")] + [(f"{n}{side}", f) for n, pair in SOURCES.items() for side, f in zip(("up", "do"), pair)]
JES_SQL = {"jes": "SELECT *, row_number() OVER (PARTITION BY event, variation ORDER BY v DESC, idx) AS k FROM (" + " UNION ALL ".join(
    f"SELECT event, eta, idx, '{n}' AS variation, pt * (" + re.sub(r"([\d.]+)D", r"CAST(\1 AS DOUBLE)", re.sub(r"IF\((.*?), (.*?), (.*?)\)$", r"CASE WHEN \1 THEN \2 ELSE \3 END", f))
    + ") AS v FROM obj WHERE kind = 'jet'" for n, f in SIDES) + ")"}


def jes(spark, sf_dir, collect=varied_collections):
    """The two leading jets by every source and side, with their nominal rank."""
    jets = T.ranked(spark, sf_dir, "jet").select("event", "idx", "pt", "eta", "flavour")
    factors = {n: (F.expr(up), F.expr(down)) for n, (up, down) in SOURCES.items()}
    return collect(jets, "event", "pt", factors, ["pt", "eta", "idx"], ["idx"], 2)


@query("q_jes_sources", with_ctes(f"""
SELECT event, variation, max(CASE WHEN k=1 THEN {rs('v', 8)} END) AS pt1, max(CASE WHEN k=1 THEN eta END) AS eta1, CAST(max(CASE WHEN k=1 THEN idx END) AS INTEGER) AS idx1,
  coalesce(max(CASE WHEN k=2 THEN {rs('v', 8)} END), 0) AS pt2, CAST(coalesce(max(CASE WHEN k=2 THEN idx END), -1) AS INTEGER) AS idx2
FROM jes GROUP BY ALL""", "obj", **JES_SQL))
def jes_sources(spark, sf_dir):
    a, b = (F.get("objects", F.lit(i)) for i in (0, 1))
    return jes(spark, sf_dir).select("event", "variation", r(a["pt"], 8).alias("pt1"), a["eta"].alias("eta1"), a["idx"].alias("idx1"),
                                     F.coalesce(r(b["pt"], 8), F.lit(0.0)).alias("pt2"), F.coalesce(b["idx"], F.lit(-1)).alias("idx2"))


@query("q_jes_hist", with_ctes(" UNION ALL ".join(
    f"SELECT sample, 'two' AS cut, 'lead' AS variable, '{label}' AS variation, {bin_sql('v1', 10, 20.0, 120.0)} AS bin, CAST(0 AS INT) AS biny, "
    f"sum(weight) AS sumw, sum(weight*weight) AS sumw2, count(*) AS n FROM t WHERE variation = '{v}' AND v2 > 20 AND weight <> 0 GROUP BY ALL"
    for v, label in [("nominal", "nominal")] + [(f"{n}{s}", f"JES_{n}{t}") for n in SOURCES for s, t in (("up", "Up"), ("do", "Down"))]), "ev", "obj", **JES_SQL,
    t="SELECT event, variation, any_value(sample) AS sample, any_value(weight) AS weight, max(CASE WHEN k=1 THEN v END) AS v1, max(CASE WHEN k=2 THEN v END) AS v2 "
      "FROM jes JOIN ev USING (event) GROUP BY event, variation"))
def jes_hist(spark, sf_dir):
    """Leading jets of three sources, each up and down, as companions of the nominal columns, filled in one pass."""
    names = [n for n, _ in SIDES]
    column = lambda c, n: c if n == "nominal" else f"{c}_{n}"
    jets = jes(spark, sf_dir, varied_leaders).select("event", *[
        F.get(F.col("varied")[n], F.lit(i))["pt"].alias(column(f"pt{i + 1}", n)) for n in names for i in (0, 1)])
    events = T.ev(spark, sf_dir).select("event", "sample", "weight").join(jets, "event")
    run = Analysis(cuts=[Cut("two", "pt2 > 20")], variables=[Variable("lead", "pt1", Uniform(10, 20.0, 120.0))],
                   nuisances=[Nuisance(f"JES_{n}", "suffix", f"{n}up", f"{n}do") for n in SOURCES])
    return run.histograms(events)


@query("q_resort_variation", with_ctes(f"""
SELECT event, max(CASE WHEN k=1 THEN {rs('v', 8)} END) AS pt1, max(CASE WHEN k=1 THEN eta END) AS eta1, CAST(coalesce(max(CASE WHEN k=1 THEN idx END), -1) AS INTEGER) AS idx1,
  max(CASE WHEN k=2 THEN {rs('v', 8)} END) AS pt2, max(CASE WHEN k=2 THEN eta END) AS eta2, CAST(coalesce(max(CASE WHEN k=2 THEN idx END), -1) AS INTEGER) AS idx2
FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY v DESC, idx) AS k FROM (
  SELECT event, eta, idx, pt * (CASE WHEN flavour = 5 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END) AS v FROM obj WHERE kind = 'jet')) GROUP BY event""", "obj"))
def resort_variation(spark, sf_dir):
    """The two leading of all an event's jets by varied pt, with every attribute, and the nominal rank, moving along."""
    jets = T.ranked(spark, sf_dir, "jet").withColumn("pt", F.col("pt") * F.when(F.col("flavour") == 5, 1.5).otherwise(0.75))
    jet = F.struct("pt", "eta", "idx")
    out = rank_objects(jets, ["event"], ["-pt", "idx"], 2, "place").groupBy("event").agg(
        F.array(*[F.max(F.when(F.col("place") == i, jet)) for i in (0, 1)]).alias("jet"))
    return out.select("event", *[c for i in (0, 1) for j in (F.get("jet", F.lit(i)),) for c in (
        r(j["pt"], 8).alias(f"pt{i + 1}"), j["eta"].alias(f"eta{i + 1}"), F.coalesce(j["idx"], F.lit(-1)).alias(f"idx{i + 1}"))])
