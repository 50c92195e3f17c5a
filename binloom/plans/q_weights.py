"""Event reweighting: fake leptons, charge flips, scale factors, theory weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.config import Edges
from binloom.functions import events as E, kinematics as K, weights as W
from binloom.functions.bins import bin_index
from binloom.functions.lookup import BinnedMap, Curve, ShapeTable, map_from_rows
from binloom.operators import rates, reweight, tagging, veto
from binloom.operators.joins import clean_objects
from binloom.plans.q_hist import rate_hists, weighted_jets
from binloom.plans.q_select import DILEP_SQL, JS, VETO, region_flags
from binloom.plans.registry import dr2_sql, edges_sql, map_sql, query, r, rs, with_ctes
from binloom.sources import driver_tables as T

PT = (10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0)
ETA = (0.0, 1.479, 2.6)


def _map(x, y, base, dx, dy, err=0.0):
    v = tuple(tuple(round(base + dx * i + dy * j, 4) for i in range(len(x) - 1)) for j in range(len(y) - 1))
    e = tuple(tuple(round(err * (1 + i + j), 4) for i in range(len(x) - 1)) for j in range(len(y) - 1))
    return BinnedMap(x, y, v, e)


PROMPT = {11: _map(PT, ETA, 0.80, 0.015, -0.03), 13: _map(PT, ETA, 0.85, 0.012, -0.02)}
FAKE = {11: _map(PT, ETA, 0.10, 0.02, 0.05, 0.004), 13: _map(PT, ETA, 0.15, 0.015, 0.03, 0.003)}
# maps per jet-pt threshold, and the electroweak variations of those the nominal weights read
JET_E = {j: _map(PT, ETA, 0.05 + j / 500, 0.02, 0.05, 0.004) for j in (25, 35, 45)} | {
    (35, "EWK5Up"): _map(PT, ETA, 0.115, 0.021, 0.05), (35, "EWK5Down"): _map(PT, ETA, 0.125, 0.019, 0.05)}
JET_M = {j: _map(PT, ETA, 0.1 + j / 400, 0.015, 0.03, 0.003) for j in (15, 25, 35, 45)} | {
    (j, n): _map(PT, ETA, 0.1 + j / 400 + d, 0.015, 0.03) for j in (25, 35) for n, d in (("EWK5Up", -0.01), ("EWK5Down", 0.01))}
LEP = ["pt", "eta", "pdgId", "score"]


def _rates_sql(fake, shift=None):
    def by(maps, cap, what="values"):
        e, m = (map_sql(maps[f], f"least(pt, {cap})", "abs(eta)", what) for f in (11, 13))
        return f"CASE WHEN abs(pdgId) = 11 THEN {e} ELSE {m} END"
    f = by(fake, "CAST(35 AS DOUBLE)")
    for flavour, k in (shift or {}).items():
        e = map_sql(fake[flavour], "least(pt, CAST(35 AS DOUBLE))", "abs(eta)", "errors")
        f = f"({f}) + CASE WHEN abs(pdgId) = {flavour} THEN {k} * {e} ELSE 0 END"
    return (f"SELECT event, idx, score > 0.5 AS t, {by(PROMPT, 'CAST(47.5 AS DOUBLE)')} AS p, {f} AS f FROM lep")


def prob_sql(name, fake=FAKE, shift=None):
    return {f"{name}r": _rates_sql(fake, shift),
            name: f"SELECT event, idx, t, CASE WHEN t THEN p*(1-f)/(p-f) ELSE p*f/(p-f) END AS pr, "
                  f"CASE WHEN t THEN f*(1-p)/(p-f) ELSE f*p/(p-f) END AS fk FROM {name}r"}


W2 = """SELECT a.event, CASE WHEN (CASE WHEN a.t THEN 1 ELSE 0 END + CASE WHEN b.t THEN 1 ELSE 0 END) = 1
  THEN a.pr*b.fk + a.fk*b.pr - a.fk*b.fk ELSE -a.pr*b.fk - a.fk*b.pr + a.fk*b.fk END AS w
  FROM {n} a JOIN {n} b ON a.event = b.event AND a.idx = 0 AND b.idx = 1"""


def _tight(n):
    return [E.at(F.col("lep"), i)["score"] > 0.5 for i in range(n)]


def leptons(spark, sf_dir, n, fields=LEP):
    return T.collections(spark, sf_dir, {"lep": n}, fields).filter(F.size("lep") >= n)


@query("q_fake_weight_2l", with_ctes(f"SELECT event, {rs('w', 7)} AS w FROM w2", "lep", **prob_sql("n"), w2=W2.format(n="n")))
def fake_weight_2l(spark, sf_dir):
    out = reweight.fake_weights(leptons(spark, sf_dir, 2), "lep", _tight(2), PROMPT, {"w": (FAKE, {})})
    return out.select("event", r("w", 7).alias("w"))


W3 = """SELECT event, CASE WHEN nt IN (1,3) THEN -PPF-PFP-FPP+PFF+FPF+FFP-FFF ELSE PPF+PFP+FPP-PFF-FPF-FFP+FFF END AS w FROM (
  SELECT a.event, CASE WHEN a.t THEN 1 ELSE 0 END + CASE WHEN b.t THEN 1 ELSE 0 END + CASE WHEN c.t THEN 1 ELSE 0 END AS nt,
    a.pr*b.pr*c.fk AS PPF, a.pr*b.fk*c.pr AS PFP, a.fk*b.pr*c.pr AS FPP, a.pr*b.fk*c.fk AS PFF, a.fk*b.pr*c.fk AS FPF,
    a.fk*b.fk*c.pr AS FFP, a.fk*b.fk*c.fk AS FFF
  FROM {n} a JOIN {n} b ON a.event=b.event AND a.idx=0 AND b.idx=1 JOIN {n} c ON c.event=a.event AND c.idx=2)"""


@query("q_fake_weight_3l", with_ctes(f"SELECT event, {rs('w', 7)} AS w FROM w3", "lep", **prob_sql("n"), w3=W3.format(n="n")))
def fake_weight_3l(spark, sf_dir):
    out = reweight.fake_weights(leptons(spark, sf_dir, 3), "lep", _tight(3), PROMPT, {"w": (FAKE, {})})
    return out.select("event", r("w", 7).alias("w"))


def ratios_sql(n):
    """Every variation's weight over the nominal one, for n leptons."""
    combine, parts = (W2, W3)[n - 2], {}
    variants = reweight.fake_variants(JET_E, JET_M, n)
    for i, (maps, shift) in enumerate(variants.values()):
        parts |= prob_sql(f"v{i}", maps, shift)
        parts[f"x{i}"] = combine.format(n=f"v{i}")
    shown = ", ".join(f"{rs(f'CASE WHEN x0.w = 0 THEN 0 ELSE x{i}.w/x0.w END', 6)} AS \"{name}\"" for i, name in enumerate(variants) if i)
    joins = " ".join(f"JOIN x{i} USING (event)" for i in range(1, len(variants)))
    return with_ctes(f"SELECT event, {rs('x0.w', 7)} AS nominal, {shown} FROM x0 {joins}", "lep", **parts)


def fake_ratios(spark, sf_dir, n):
    out = reweight.fake_ratios(leptons(spark, sf_dir, n), "lep", _tight(n), PROMPT, JET_E, JET_M)
    names = [c for c in reweight.fake_variants(JET_E, JET_M, n) if c != "nominal"]
    return out.select("event", r("nominal", 7).alias("nominal"), *[r(c, 6).alias(c) for c in names])


@query("q_fake_weight_var", ratios_sql(2))
def fake_weight_var(spark, sf_dir):
    """Ten variations of the two-lepton weight: thresholds and statistics by flavour, electroweak subtraction."""
    return fake_ratios(spark, sf_dir, 2)


@query("q_fake_weight_var_3l", ratios_sql(3))
def fake_weight_var_3l(spark, sf_dir):
    """The same for three leptons, whose nominal muon map is another."""
    return fake_ratios(spark, sf_dir, 3)


MX = (10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 1000.0)


@query("q_rate_feedback", with_ctes(f"""
SELECT event, {rs('coalesce(m.rate, 0)', 8)} AS rate, {rs('coalesce(m.error, 0)', 8)} AS error FROM lep LEFT JOIN m ON m.bin BETWEEN 1 AND 8 AND m.biny BETWEEN 1 AND 2 AND m.bin = {edges_sql('least(pt, CAST(35 AS DOUBLE))', MX)}
  AND m.biny = {edges_sql('abs(eta)', (0.0, 1.479, 2.6))} WHERE lep.idx = 0""", "lep", "ev",
    m=f"""SELECT bin, biny, CASE WHEN l > 0 THEN t/l ELSE 0 END AS rate, CASE WHEN l > 0 AND t > 0 THEN t/l*sqrt(1/t+1/l) ELSE 0 END AS error FROM (
      SELECT {edges_sql('pt', MX)} AS bin, {edges_sql('abs(eta)', (0.0, 1.479, 2.6))} AS biny, coalesce(sum(weight) FILTER (score > 0.5), 0) AS t,
        sum(weight) AS l FROM lep JOIN ev USING (event) WHERE idx = 0 AND sample = 'DATA' GROUP BY ALL)"""))
def rate_feedback(spark, sf_dir):
    """Rates measured in a first pass and looked up per event in a second one."""
    measured = rates.fake_rate(rate_hists(spark, sf_dir), "loose", "tight", "DATA")
    m = map_from_rows(measured.withColumnsRenamed({"bin": "ix", "biny": "iy"}), MX, (0.0, 1.479, 2.6), "rate", "error")
    lead = leptons(spark, sf_dir, 1, ["pt", "eta"])
    o = E.at(F.col("lep"), 0)
    pt, eta = F.least(o["pt"], F.lit(35.0)), F.abs(o["eta"])
    return lead.select("event", r(m.value(pt, eta), 8).alias("rate"), r(m.error(pt, eta), 8).alias("error"))


FLIP_X, FLIP_Y = (0.0, 0.75, 1.479, 2.5), (10.0, 25.0, 50.0, 200.0)
FLIP = _map(FLIP_X, FLIP_Y, 0.002, 0.004, 0.001)
FLIP_SYS = _map(FLIP_X, FLIP_Y, 0.0004, 0.0003, 0.0002)
_FX, _FY = "least(abs(eta), CAST(2.49 AS DOUBLE))", "least(greatest(pt, 10), 199)"


@query("q_charge_flip", with_ctes(f"""
SELECT ev.event, coalesce(prob, 1) AS prob, coalesce(err, 0) AS err FROM ev LEFT JOIN (SELECT event, {rs('CASE n WHEN 1 THEN p1 WHEN 2 THEN p1*(1-p2)+(1-p1)*p2 ELSE 1 END', 9)} AS prob,
  {rs('CASE n WHEN 1 THEN e1 WHEN 2 THEN sqrt((1-2*p2)*e1*(1-2*p2)*e1 + (1-2*p1)*e2*(1-2*p1)*e2) ELSE 0 END', 9)} AS err FROM (
  SELECT event, count(p) AS n, max(CASE WHEN k=1 THEN p END) AS p1, max(CASE WHEN k=1 THEN e END) AS e1,
    max(CASE WHEN k=2 THEN p END) AS p2, max(CASE WHEN k=2 THEN e END) AS e2 FROM (
    SELECT *, row_number() OVER (PARTITION BY event, p IS NULL ORDER BY idx) AS k FROM (
      SELECT event, idx, CASE WHEN abs(pdgId)=11 THEN {map_sql(FLIP, _FX, _FY)} END AS p, CASE WHEN abs(pdgId)=11 THEN {map_sql(FLIP_SYS, _FX, _FY)} END AS e
      FROM lep WHERE idx < 2)) GROUP BY event)) USING (event)""", "ev", "lep"))
def charge_flip(spark, sf_dir):
    out = reweight.charge_flip(T.collections(spark, sf_dir, {"lep": 2}, LEP[:3]).filter(F.size("lep") >= 1), "lep", FLIP, FLIP_SYS)
    out = T.ev(spark, sf_dir).select("event").join(out, "event", "left")
    return out.select("event", r(F.coalesce("flip", F.lit(1.0)), 9).alias("prob"), r(F.coalesce("flip_err", F.lit(0.0)), 9).alias("err"))


SX, SY = (-2.6, -1.479, 0.01, 1.479, 2.6), (10.0, 30.0, 60.0, 120.0, 500.0)
SF = {11: (_map(SX, SY, 0.95, 0.01, 0.005), _map(SX, SY, 0.01, 0.001, 0.002), _map(SX, SY, 0.02, 0.002, 0.001)),
      13: (_map(SX, SY, 0.98, 0.004, 0.002), _map(SX, SY, 0.005, 0.001, 0.001), _map(SX, SY, 0.01, 0.001, 0.001))}


def _sf_col(k):
    def one(f):
        lo, hi, plo, phi = reweight.SF_LIMITS[f]
        x = f"least(greatest(eta, CAST({lo} AS DOUBLE)), CAST({hi} AS DOUBLE))"
        y = f"least(greatest(pt, CAST({plo} AS DOUBLE)), CAST({phi} AS DOUBLE))"
        return map_sql(SF[f][k], x, y)
    return f"CASE WHEN abs(pdgId) = 11 THEN {one(11)} ELSE {one(13)} END"


@query("q_lepton_sf", with_ctes(f"""
SELECT event, {rs('product(sf)', 7)} AS nominal, {rs('product(CASE WHEN e THEN (sf+err)/sf ELSE 1 END)', 7)} AS "eleUp",
  {rs('product(CASE WHEN e THEN (sf-err)/sf ELSE 1 END)', 7)} AS "eleDown", {rs('product(CASE WHEN NOT e THEN (sf+err)/sf ELSE 1 END)', 7)} AS "muUp",
  {rs('product(CASE WHEN NOT e THEN (sf-err)/sf ELSE 1 END)', 7)} AS "muDown"
FROM (SELECT event, abs(pdgId)=11 AS e, {_sf_col(0)} AS sf, sqrt(({_sf_col(1)})*({_sf_col(1)}) + ({_sf_col(2)})*({_sf_col(2)})) AS err FROM lep WHERE idx < 2)
GROUP BY event HAVING count(*) = 2""", "lep"))
def lepton_sf(spark, sf_dir):
    out = reweight.lepton_sf(leptons(spark, sf_dir, 2, LEP[:3]), "lep", SF)
    return out.select("event", *[r(n, 7).alias(n) for n in ("nominal", "eleUp", "eleDown", "muUp", "muDown")])


@query("q_sf_table", with_ctes(f"""
SELECT ix, iy, data, mc, {rs('CASE WHEN mc <> 0 THEN data/mc ELSE 1 END', 8)} AS sf,
  {rs('CASE WHEN mc <> 0 THEN sqrt((sd/mc)*(sd/mc) + (data*sm/(mc*mc))*(data*sm/(mc*mc))) ELSE 0 END', 8)} AS err FROM (
  SELECT *, sqrt(data)/2 AS sd, sqrt(abs(mc))/2 AS sm FROM (
    SELECT {edges_sql('eta', SX)} AS ix, {edges_sql('pt', SY)} AS iy, coalesce(sum(weight) FILTER (sample='DATA'),0) AS data,
      coalesce(sum(weight) FILTER (sample='SIG'),0) AS mc FROM lep JOIN ev USING (event) WHERE idx=0 GROUP BY ALL))""", "lep", "ev"))
def sf_table(spark, sf_dir):
    """Scale factors derived from measured cells with their errors propagated."""
    lead = T.records(spark, sf_dir, want={"lep": 1}, fields=["pt", "eta"]).withColumn("o", E.at(F.col("lep"), 0))
    cells = lead.groupBy(bin_index(F.col("o.eta"), Edges(SX)).alias("ix"), bin_index(F.col("o.pt"), Edges(SY)).alias("iy")).agg(
        *[F.sum(F.when(F.col("sample") == s, F.col("weight")).otherwise(0.0)).alias(n) for n, s in (("data", "DATA"), ("mc", "SIG"))])
    sf, err = W.efficiency_sf(F.col("data"), F.col("mc"), F.sqrt("data") / 2, F.sqrt(F.abs("mc")) / 2)
    return cells.select("ix", "iy", "data", "mc", r(sf, 8).alias("sf"), r(err, 8).alias("err"))


BX, BY = (30.0, 50.0, 80.0, 200.0), (0.0, 1.2, 2.6)
BSF = {5: _map(BX, BY, 0.96, 0.01, 0.02, 0.01), 4: _map(BX, BY, 0.92, 0.02, 0.01, 0.02), 0: _map(BX, BY, 1.05, 0.03, 0.02, 0.03)}
BEFF = {5: _map(BX, BY, 0.70, 0.05, -0.05), 4: _map(BX, BY, 0.20, 0.05, -0.02), 0: _map(BX, BY, 0.02, 0.01, 0.005)}


def _btag_sql(flavours, shift=0):
    def pick(maps, what="values"):
        return "CASE flavour " + " ".join(f"WHEN {f} THEN {map_sql(maps[f], 'pt', 'abs(eta)', what)}" for f in flavours) + " END"
    sf = f"({pick(BSF)})" + (f" + {shift}*({pick(BSF, 'errors')})" if shift else "")
    return f"""SELECT event, product(CASE WHEN score > 0.6 THEN s WHEN e = 1 THEN 1 ELSE (1-e*s)/(1-e) END) AS w FROM (
      SELECT event, score, {sf} AS s, {pick(BEFF)} AS e FROM items WHERE kind='jet' AND pt > 30 AND abs(eta) < 2.5
      AND flavour IN ({','.join(map(str, flavours))})) GROUP BY event"""


@query("q_btag_weight", with_ctes(f"""
SELECT event, {rs('coalesce(b.w,1)', 7)} AS bc, {rs('coalesce(u.w,1)', 7)} AS bc_up, {rs('coalesce(l.w,1)', 7)} AS light
FROM ev LEFT JOIN b USING (event) LEFT JOIN u USING (event) LEFT JOIN l USING (event)""", "ev", "items",
    b=_btag_sql((5, 4)), u=_btag_sql((5, 4), 1), l=_btag_sql((0,))))
def btag_weight(spark, sf_dir):
    jets = T.items(spark, sf_dir).filter("kind = 'jet'").select("event", "pt", "eta", "flavour", "score")
    w = tagging.fixed_wp_weights(jets, "event", F.col("score") > 0.6, BSF, BEFF,
                                 {"bc": ((5, 4), 0), "bc_up": ((5, 4), 1), "light": ((0,), 0)})
    out = T.ev(spark, sf_dir).select("event").join(w, "event", "left").fillna(1.0, ["bc", "bc_up", "light"])
    return out.select("event", *[r(c, 7).alias(c) for c in ("bc", "bc_up", "light")])


@query("q_syst_lookup", with_ctes("SELECT event, flavour, wp, syst, " + rs(
    "CASE flavour " + " ".join(f"WHEN {f} THEN {map_sql(BSF[f], 'pt', 'abs(eta)')} + d*{map_sql(BSF[f], 'pt', 'abs(eta)', 'errors')}" for f in (5, 4, 0)) + " END", 8) + """ AS sf
FROM (SELECT event, flavour, pt, eta, CASE WHEN score > 0.6 THEN 'M' ELSE 'L' END AS wp FROM items WHERE kind='jet' AND pt > 30 AND pt < 200) ,
  (VALUES ('central', 0), ('up', 1), ('down', -1)) s(syst, d) WHERE wp = 'M'""", "items"))
def syst_lookup(spark, sf_dir):
    """Look-up keyed by working point, systematic and flavour, on a dimension table of fixed size."""
    jets = T.items(spark, sf_dir).filter("kind = 'jet' AND pt > 30 AND pt < 200 AND score > 0.6").withColumn("wp", F.lit("M"))
    dim = tagging.dimension(spark, {("M", s, f): (BSF[f], d) for f in BSF for s, d in (("central", 0), ("up", 1), ("down", -1))})
    out = tagging.keyed_lookup(jets, dim, F.col("pt"), F.abs("eta"), BX, BY, ["wp", "flavour"])
    return out.select("event", "flavour", "wp", "syst", r("value", 8).alias("sf"))


@query("q_binned_lookup", with_ctes(f"""
SELECT event, line, part, supp, {rs(map_sql(FAKE[11], 'least(pt, CAST(47.5 AS DOUBLE))', 'abs(eta)'), 8)} AS value,
  {rs(map_sql(FAKE[11], 'least(pt, CAST(47.5 AS DOUBLE))', 'abs(eta)', 'errors'), 8)} AS error FROM items""", "items"))
def binned_lookup(spark, sf_dir):
    x, y = F.least("pt", F.lit(FAKE[11].last_centre_x())), F.abs("eta")
    out = FAKE[11].attach(T.items(spark, sf_dir), x, y, "value", "error")
    return out.select("event", "line", "part", "supp", r("value", 8).alias("value"), r("error", 8).alias("error"))


def _shape_cells(source, flavour):
    """Coefficients from a rule: every axis, flavour and source shows."""
    k, f = SHAPES.index(source), {0: 0, 4: 1, 5: 2}[flavour]
    return tuple((6 / 7 + e / 51 + p / 103 + s / 211 + f / 31, 0.2 - s / 33 + k / 97, k / 53 - e / 101)
                 for e in range(3) for p in range(4) for s in range(4))


SHAPES = ("central", "up_jes", "down_jes", "up_lf", "up_hf", "down_hfstats1", "up_cferr1", "down_cferr1")
SHAPE_TABLE = ShapeTable((0.0, 0.8, 1.6, 2.6), (20.0, 30.0, 50.0, 70.0, 1000.0), (0.0, 0.2, 0.5, 0.8, 1.01),
                         {(s, f): _shape_cells(s, f) for s in SHAPES for f in (0, 4, 5) if "cferr" not in s or f == 4})


def _shape_rows_sql():
    """The table as rows with the limits of their cells."""
    t, out = SHAPE_TABLE, []
    places = [(e, p, s) for e in range(3) for p in range(4) for s in range(4)]
    for f, i, *own in t.rows():
        limits = [(edges[k], edges[k + 1]) for edges, k in zip((t.eta_edges, t.pt_edges, t.score_edges), places[i])]
        numbers = [v for pair in limits for v in pair] + [v for c in own for v in (c or [None] * 3)]
        out.append(f"({f}, " + ", ".join("NULL" if v is None else f"{v!r}::DOUBLE" for v in numbers) + ")")
    names = ", ".join(f"{s}_{j}" for s in SHAPES for j in range(3))
    return f"SELECT * FROM (VALUES {', '.join(out)}) t(f, e_lo, e_hi, p_lo, p_hi, s_lo, s_hi, {names})"


def _shape_sql(s):
    skip = "pt < 20 OR abs(eta) > 2.2" + (" OR flavour <> 0" if "jes" in s else "") + (
        " OR flavour <> 4" if "cferr" in s else " OR flavour = 4" if "hf" in s or "lf" in s else "")
    return f"CASE WHEN {skip} THEN 1 ELSE {s}_0 + score * ({s}_1 + score * {s}_2) END"


_SHAPED = """SELECT items.*, tab.* FROM items LEFT JOIN tab ON flavour = f AND abs(eta) >= e_lo AND abs(eta) < e_hi AND pt >= p_lo AND pt < p_hi
  AND score >= s_lo AND score < s_hi WHERE kind = 'jet'"""


def shape_factors(jets):
    """The jets with their factor for each source; 1 where the source does not concern the jet."""
    c = {n: F.col(n) for n in ("flavour", "eta", "pt", "score")}
    found = SHAPE_TABLE.attach(jets, **c)
    return found.withColumns({s: W.shape_sf(s, F.col(s), c["flavour"], c["eta"], c["pt"], c["score"], 20.0, 2.2) for s in SHAPES})


@query("q_btag_shape", with_ctes("SELECT ev.event, " + ", ".join(f"coalesce({s}, 1) AS {s}" for s in SHAPES) + " FROM ev LEFT JOIN (SELECT event, "
    + ", ".join(f"{rs(f'product({_shape_sql(s)})', 7)} AS {s}" for s in SHAPES) + " FROM shaped GROUP BY event) USING (event)", "ev", "items",
    tab=_shape_rows_sql(), shaped=_SHAPED))
def btag_shape(spark, sf_dir):
    """Event factors from a table on three axes, with a polynomial in each cell, for every source at once."""
    jets = T.items(spark, sf_dir).filter("kind = 'jet'").select("event", "flavour", "eta", "pt", "score")
    found = shape_factors(jets).groupBy("event").agg(*[r(F.product(F.col(s)), 7).alias(s) for s in SHAPES])
    return T.ev(spark, sf_dir).select("event").join(found, "event", "left").select(
        "event", *[F.coalesce(s, F.lit(1.0)).alias(s) for s in SHAPES])


@query("q_shape_lookup", with_ctes(" UNION ALL ".join(
    f"SELECT event, line, part, supp, '{s}' AS source, {rs(_shape_sql(s), 8)} AS sf FROM shaped" for s in SHAPES), "items", tab=_shape_rows_sql(), shaped=_SHAPED))
def shape_lookup(spark, sf_dir):
    """The look-up keyed by source and flavour, a row for each jet and source, without a join."""
    jets = T.items(spark, sf_dir).filter("kind = 'jet'").select("event", "line", "part", "supp", "flavour", "eta", "pt", "score")
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), r(s, 8).alias("sf")) for s in SHAPES])).alias("o")
    return shape_factors(jets).select("event", "line", "part", "supp", one).select("event", "line", "part", "supp", "o.*")


@query("q_region_sf", with_ctes(f"""
SELECT event, {rs('CASE WHEN bveto OR (topcr AND zerojet) THEN v ELSE 0 END + CASE WHEN topcr AND NOT zerojet THEN q ELSE 0 END', 7)} AS sf FROM (
  SELECT f.event, bveto, zerojet, mll > 50 AND ((zerojet AND NOT bveto) OR breq) AND mtw2 > 30 AS topcr, coalesce(v, 1) AS v, coalesce(q, 1) AS q
  FROM (SELECT ll.*, coalesce(nb20, 0) = 0 AS bveto, coalesce(nb30, 0) >= 1 AS breq, coalesce(n30, 0) = 0 AS zerojet FROM ll LEFT JOIN js USING (event)) f
  LEFT JOIN pr USING (event))""", "rec", js=JS, **DILEP_SQL, pr="""
SELECT event, product(CASE WHEN pt > 20 AND abs(eta) < 2.2 THEN CAST(0.8 AS DOUBLE) + CAST(0.4 AS DOUBLE)*score ELSE 1 END) AS v,
  product(CASE WHEN pt > 30 AND abs(eta) < 2.2 THEN CAST(0.8 AS DOUBLE) + CAST(0.4 AS DOUBLE)*score ELSE 1 END) AS q
FROM items WHERE kind='jet' GROUP BY event"""))
def region_sf(spark, sf_dir):
    """Veto factor where b jets are vetoed, request factor where one is required, none elsewhere."""
    sf = 0.8 + 0.4 * F.col("score")
    prods = T.items(spark, sf_dir).filter("kind = 'jet'").groupBy("event").agg(*[
        F.product(F.when((F.col("pt") > t) & (F.abs("eta") < 2.2), sf).otherwise(1.0)).alias(n) for n, t in (("v", 20), ("q", 30))])
    df = region_flags(spark, sf_dir).join(prods, "event", "left").fillna(1.0, ["v", "q"])
    out = F.expr("IF(bveto OR (topcr AND zerojet), v, 0D) + IF(topcr AND NOT zerojet, q, 0D)")
    return df.select("event", r(out, 7).alias("sf"))


@query("q_top_pt", with_ctes(f"""
SELECT event, {rs('CASE WHEN a*b > 0 THEN sqrt((0.103e0*exp(-0.0118e0*a) - 0.000134e0*a + 0.973e0)*(0.103e0*exp(-0.0118e0*b) - 0.000134e0*b + 0.973e0)) ELSE 1 END', 8)} AS w
FROM (SELECT event, coalesce(l1_pt,0) AS a, coalesce(l2_pt,0) AS b FROM ev LEFT JOIN wide USING (event))""", "ev", "wide"))
def top_pt(spark, sf_dir):
    rec = T.records(spark, sf_dir, "left", want={"lep": 2}, fields=["pt"])
    a, b = (F.coalesce(E.at(F.col("lep"), i)["pt"], F.lit(0.0)) for i in (0, 1))
    return rec.select("event", r(W.top_pt_weight(a, b), 8).alias("w"))


def _erf_sql(x):
    """The same rational approximation, as one nested expression."""
    t = f"(1/(1+0.3275911e0*abs({x})))"
    return (f"(sign({x})*(1 - ((((1.061405429e0*{t} - 1.453152027e0)*{t} + 1.421413741e0)*{t} - 0.284496736e0)*{t} "
            f"+ 0.254829592e0)*{t}*exp(-({x})*({x}))))")


def _dy_sql(order):
    norm, amp, mid, width, slope, flat = (f"({v}e0)" for v in W.DY_PTLL[order])

    def curve(x):
        return f"({amp}*{_erf_sql(f'(({x} - {mid})/{width})')} + {slope}*{x})"
    return (f"CASE WHEN nj = 0 THEN {norm} * (CASE WHEN pt < 40 THEN {curve('pt')} - {curve('40e0')} + {flat} ELSE {flat} END) ELSE 1 END")


@query("q_dy_ptll", with_ctes(f"""
SELECT event, {rs(_dy_sql('NLO'), 8)} AS nlo, {rs(_dy_sql('LO'), 8)} AS lo
FROM (SELECT event, l1_pt AS pt, njet AS nj FROM rec WHERE nlep >= 1)""", "rec"))
def dy_ptll(spark, sf_dir):
    rec = T.records(spark, sf_dir, fields=["pt"], want={"lep": 1, "jet": 1}).filter(F.size("lep") >= 1)
    flat = rec.select("event", E.at(F.col("lep"), 0)["pt"].alias("pt"), F.size("jet").alias("nj"))
    return flat.select("event", *[r(W.dy_ptll_weight(F.col("pt"), F.col("nj"), o), 8).alias(o.lower()) for o in ("NLO", "LO")])


CURVES = {0: Curve((0.0, 20.0, 60.0, 125.0), (1.1, 1.0, 0.9, 0.75)), 1: Curve((0.0, 50.0, 625.0), (1.2, 1.0, 0.6)),
          2: Curve((0.0, 100.0, 800.0), (1.3, 1.05, 0.7))}


def curve_sql(c, x):
    x = f"least(greatest({x}, CAST({c.xs[0]} AS DOUBLE)), CAST({c.xs[-1]} AS DOUBLE))"
    seg = [f"WHEN {x} <= {x1} THEN CAST({y0} AS DOUBLE) + ({x} - {x0}) * (CAST({y1} AS DOUBLE) - CAST({y0} AS DOUBLE)) / ({x1} - {x0})"
           for x0, x1, y0, y1 in zip(c.xs, c.xs[1:], c.ys, c.ys[1:])]
    return "(CASE " + " ".join(seg) + " END)"


@query("q_curve_lookup", with_ctes(f"""
SELECT event, {rs('CASE njet ' + ' '.join(f'WHEN {n} THEN {curve_sql(c, "total")}' for n, c in CURVES.items()) + ' ELSE 1 END', 10)} AS w FROM rec""", "rec"))
def curve_lookup(spark, sf_dir):
    rec = T.records(spark, sf_dir, fields=["pt"])
    return rec.select("event", r(W.curve_by_category(F.size("jet"), CURVES, F.col("total")), 10).alias("w"))


KX = (0.0, 100.0, 200.0, 350.0, 600.0)
KNOM = Curve(KX, (1.6, 1.7, 1.75, 1.8, 1.9))
KUP = [Curve(KX, tuple(round(y * f, 4) for y in KNOM.ys)) for f in (1.03, 1.07, 1.01, 1.02)]
KDN = [Curve(KX, tuple(round(y * f, 4) for y in KNOM.ys)) for f in (0.96, 0.92, 0.99, 0.985)]


def _quad(cs):
    return "k*sqrt(" + " + ".join(f"(({curve_sql(c, 'total')}-k)/k)*(({curve_sql(c, 'total')}-k)/k)" for c in cs) + ")"


@query("q_kfactor", with_ctes(f"""
SELECT event, {rs('k', 10)} AS k, {rs('k + ' + _quad(KUP), 10)} AS up, {rs('k - ' + _quad(KDN), 10)} AS down
FROM (SELECT event, total, {curve_sql(KNOM, 'total')} AS k FROM ev)""", "ev"))
def q_kfactor(spark, sf_dir):
    k, up, down = W.kfactor(F.col("total"), KNOM, KUP, KDN)
    return T.ev(spark, sf_dir).select("event", r(k, 10).alias("k"), r(up, 10).alias("up"), r(down, 10).alias("down"))


def _ip(x, x1, y1, x2, y2):
    return f"(CASE WHEN {x} < {x1} THEN CAST({y1} AS DOUBLE) WHEN {x} > {x2} THEN {y2} ELSE {y1}e0 + ({y2}e0 - {y1}e0)*({x}-{x1})/({x2}-{x1}) END)"


_SIG = "(CASE least(nj,2) WHEN 0 THEN 30.117e0 WHEN 1 THEN 12.928e0 ELSE 5.475e0 - 0.630e0 END)"


def _src(a, b, c):
    return f"CASE WHEN v3 <> 0 THEN 0 ELSE (CASE least(nj,2) WHEN 0 THEN {a}e0 WHEN 1 THEN {b}e0 ELSE {c}e0 END)*(48.52e0/47.4e0)/{_SIG} END"


THEORY = {"ggH_mu": _src(1.12, .66, .42), "ggH_res": _src(.03, .57, .42), "ggH_mig01": _src(-1.22, 1, .21), "ggH_mig12": _src(0, -.86, .86),
          "ggH_pT60": "CASE WHEN stxs IN (101,102) THEN 0.2 ELSE 0 END", "ggH_pT120": "v3",
          "ggH_VBF2j": f"CASE WHEN nj = 0 THEN 0 WHEN nj = 1 THEN {_ip('pt', 20, -0.1, 100, 0.1)} ELSE {_ip('pt', 0, -0.1, 180, 0.1)} END",
          "ggH_VBF3j": f"CASE WHEN nj = 0 THEN 0 ELSE {_ip('pt', 90, -0.016, 160, 0.14)} END", "ggH_qmtop": _ip("pt", 160, 0.0, 500, 0.37)}


@query("q_theory_unc", with_ctes("SELECT event, " + ", ".join(f'{rs("1 + " + e, 10)} AS "{n}"' for n, e in THEORY.items()) + """
FROM (SELECT *, CASE stxs WHEN 101 THEN -0.32e0 WHEN 102 THEN 0.235e0 ELSE 0e0 END AS v3 FROM (
  SELECT event, total AS pt, njet AS nj, 100 + dataset AS stxs FROM rec))""", "rec"))
def theory_unc(spark, sf_dir):
    rec = T.records(spark, sf_dir, fields=["pt"])
    flat = rec.select("event", F.size("jet").alias("nj"), F.col("total").alias("pt"), (100 + F.col("dataset")).alias("stxs"))
    weights = W.ggf_weights(F.col("nj"), F.col("pt"), F.col("stxs"))
    return flat.select("event", *[r(c, 10).alias(n) for n, c in weights.items()])


@query("q_interpol", with_ctes(f"SELECT event, {rs(_ip('total', 90, -0.016, 160, 0.14), 9)} AS y FROM ev", "ev"))
def interpol(spark, sf_dir):
    return T.ev(spark, sf_dir).select("event", r(K.interpol(F.col("total"), 90.0, -0.016, 160.0, 0.14), 9).alias("y"))


@query("q_interference", f"""
SELECT vec_id, {rs('CASE WHEN s <> 0 THEN (b-a-c)/s ELSE 0 END', 5)} AS inter, {rs('CASE WHEN s <> 0 THEN b/s ELSE 1 END', 5)} AS total
FROM (SELECT vec_id, a, b, c, a+c AS s FROM (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) + 0.01e0 AS a,
  CAST(embedding[2] AS DOUBLE) AS b, abs(CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings))""")
def interference(spark, sf_dir):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    inter, total = W.interference_ratio(F.abs(e[0]) + 0.01, e[1], F.abs(e[2]))
    return T.table(spark, sf_dir, "embeddings").select("vec_id", r(inter, 5).alias("inter"), r(total, 5).alias("total"))


@query("q_coupling_reweight", f"""
SELECT vec_id, {rs('CAST(embedding[4] AS DOUBLE) * (0.75e0/1.25e0)', 9)} AS w FROM embeddings""")
def coupling_reweight(spark, sf_dir):
    """Stored hypothesis weight times the ratio of the two cross-sections."""
    return T.table(spark, sf_dir, "embeddings").select(
        "vec_id", r(F.get("embedding", F.lit(3)).cast("double") * F.lit(0.75 / 1.25), 9).alias("w"))


@query("q_weight_clip", f"SELECT event_id, {rs('CASE WHEN value < 100 THEN value ELSE 0 END / 1.3497498186057713e0', 8)} AS w FROM events")
def weight_clip(spark, sf_dir):
    # Fixed value: normalisation after clipping
    return T.table(spark, sf_dir, "events").select("event_id", r(W.clipped(F.col("value"), 100.0, 1.3497498186057713), 8).alias("w"))


@query("q_prescale_lumi", with_ctes("""
SELECT event, CASE WHEN e AND pt <= 25 THEN 6.412e0 WHEN e THEN 38.906e0 WHEN pt <= 20 THEN 8.561e0 ELSE 45.781e0 END AS lumi
FROM (SELECT event, abs(pdgId)=11 AS e, pt FROM lep WHERE idx = 0)""", "lep"))
def prescale_lumi(spark, sf_dir):
    # Recorded luminosity of each prescaled trigger
    o = E.at(F.col("lep"), 0)
    e = W.is_electron(o["pdgId"])
    lumi = (F.when(e & (o["pt"] <= 25), 6.412).when(e, 38.906).when(o["pt"] <= 20, 8.561).otherwise(45.781))
    return leptons(spark, sf_dir, 1, ["pt", "pdgId"]).select("event", lumi.alias("lumi"))


@query("q_sf_ratio_columns", with_ctes(f"""
SELECT event, {rs('u/n', 8)} AS sf_up, {rs('d/n', 8)} AS sf_down FROM (
  SELECT event, product(s) AS n, product(s+0.05e0) AS u, product(s-0.05e0) AS d FROM (
    SELECT event, 0.8e0 + 0.4e0*score AS s FROM items WHERE kind='jet' AND pt < 50) GROUP BY event)""", "items"))
def sf_ratio_columns(spark, sf_dir):
    s = 0.8 + 0.4 * F.col("score")
    p = T.items(spark, sf_dir).filter("kind = 'jet' AND pt < 50").groupBy("event").agg(
        F.product(s).alias("n"), F.product(s + 0.05).alias("u"), F.product(s - 0.05).alias("d"))
    return p.select("event", r(F.try_divide("u", "n"), 8).alias("sf_up"), r(F.try_divide("d", "n"), 8).alias("sf_down"))


def _boost(v, f):
    """Components of v in the rest frame of f, by the textbook boost."""
    bp = f"(({f}x*{v}x + {f}y*{v}y + {f}z*{v}z)/{f}e)"
    m = f"sqrt({f}e*{f}e - {f}x*{f}x - {f}y*{f}y - {f}z*{f}z)"
    g, b2 = f"({f}e/{m})", f"(({f}x*{f}x + {f}y*{f}y + {f}z*{f}z)/({f}e*{f}e))"
    k = f"(({g} - 1)/{b2}*{bp} - {g}*{v}e)"
    return {**{c: f"{v}{c} + {k}*{f}{c}/{f}e" for c in "xyz"}, "e": f"{g}*({v}e - {bp})"}


def _cols(pairs, frame, suffix):
    return ", ".join(f"{e} AS {v}{suffix}{c}" for v in pairs for c, e in _boost(v, frame).items())


def _cos(a, b):
    return (f"(({a}x*{b}x + {a}y*{b}y + {a}z*{b}z)/sqrt(({a}x*{a}x + {a}y*{a}y + {a}z*{a}z)*({b}x*{b}x + {b}y*{b}y + {b}z*{b}z)))")


def _cross(a, b, n):
    return ", ".join(f"{a}{i}*{b}{j} - {a}{j}*{b}{i} AS {n}{k}" for i, j, k in ("yzx", "zxy", "xyz"))


POL = {
    "v": "SELECT event, " + ", ".join(
        f"{o}_pt*cos({o}_phi) AS {n}x, {o}_pt*sin({o}_phi) AS {n}y, {o}_pt*sinh({o}_eta) AS {n}z, {o}_pt*cosh({o}_eta) AS {n}e"
        for o, n in (("l1", "a"), ("j1", "u"), ("l2", "c"), ("j2", "v"))) + " FROM rec WHERE nlep >= 2 AND njet >= 2",
    "s": "SELECT *, " + ", ".join(f"a{c}+u{c} AS p{c}, c{c}+v{c} AS q{c}, a{c}+u{c}+c{c}+v{c} AS h{c}" for c in "xyze") + " FROM v",
    "f": f"SELECT *, {_cols('acpq', 'h', '1')} FROM s",
    "g": f"SELECT *, {_cols(['a1'], 'p1', 's')}, {_cols(['c1'], 'q1', 's')}, {_cross('a1', 'p1', 'n')}, {_cross('c1', 'p1', 'm')} FROM f",
    "k": f"SELECT event, {_cos('p1', 'a1s')} AS c1, {_cos('q1', 'c1s')} AS c2, {_cos('n', 'm')} AS cp, CASE WHEN hm > 1e-12*he*he AND pm > 1e-12*pe*pe AND qm > 1e-12*qe*qe THEN (hm - pm - qm)/(2*sqrt(pm*qm)) END AS k FROM ("
         "SELECT *, " + ", ".join(f"{o}e*{o}e - {o}x*{o}x - {o}y*{o}y - {o}z*{o}z AS {o}m" for o in "hpq") + " FROM g)",
    "w": "SELECT event, 16*k*k*(1-c1*c1)*(1-c2*c2) AS ll, 4*(1-c1)*(1-c1)*(1-c2)*(1-c2) + 4*(1+c1)*(1+c1)*(1+c2)*(1+c2) "
         "+ 8*(1-c1*c1)*(1-c2*c2)*(2*cp*cp-1) AS tt, -16*k*((1-c1)*(1-c2) + (1+c1)*(1+c2))*sqrt(greatest((1-c1*c1)*(1-c2*c2),0))*cp AS i FROM k"}


@query("q_polarisation", with_ctes(f"""
SELECT event, {rs('ll/t', 4)} AS "LL", {rs('tt/t', 4)} AS "TT", {rs('i/t', 4)} AS "Int", {rs('(tt+i)/t', 4)} AS "TTInt"
FROM (SELECT *, CASE WHEN ll+tt+i > 1e-9*(ll+tt) THEN ll+tt+i END AS t FROM w)""", "rec", **POL))
def polarisation(spark, sf_dir):
    rec = T.records(spark, sf_dir, fields=["pt", "eta", "phi"], want={"lep": 2, "jet": 2}).filter(
        (F.size("lep") >= 2) & (F.size("jet") >= 2))
    v = {c: [E.massless(E.at(F.col(c), i)) for i in (0, 1)] for c in ("lep", "jet")}
    angles = reweight.decay_angles(rec, v["lep"][0], v["jet"][0], v["lep"][1], v["jet"][1])
    frac = W.polarisation_fractions(*[F.col(c) for c in ("cos1", "cos2", "cosphi", "kappa")])
    return angles.select("event", *[r(c, 4).alias(n) for n, c in frac.items()])


_JD = (dr2_sql("L", "J").replace("L_eta", "lep.eta").replace("L_phi", "lep.phi")
       .replace("J_eta", "j.eta").replace("J_phi", "j.phi"))


@query("q_jet_stage", with_ctes(f"""
SELECT ev.event, coalesce(njet, 0) AS njet, coalesce(ht, 0) AS ht FROM ev LEFT JOIN (
  SELECT event, count(*) AS njet, {rs('sum(pt)', 6)} AS ht FROM items j WHERE kind = 'jet' AND pt >= 15 AND score >= 0.25
    AND NOT EXISTS (SELECT 1 FROM items lep WHERE lep.kind = 'lepton' AND lep.event = j.event AND lep.pt >= 10 AND {_JD} < 0.09)
  GROUP BY event) USING (event)
WHERE event NOT IN (SELECT event FROM items WHERE kind = 'jet' AND score < 0.9 AND pt > 15 AND
    {map_sql(VETO, 'greatest(least(eta, 5.19), -5.19)', 'greatest(least(phi, CAST(3.1415 AS DOUBLE)), CAST(-3.1415 AS DOUBLE))')} <> 0)""", "ev", "items"))
def jet_stage(spark, sf_dir):
    """Identified jets above 15, clean of leptons, in events that no dirty detector region touches; those without such a jet, too."""
    jets = T.items(spark, sf_dir).filter("kind = 'jet'")
    leptons = T.items(spark, sf_dir).filter("kind = 'lepton' AND pt >= 10").select("event", "eta", "phi")
    good = jets.filter("pt >= 15 AND score >= 0.25").select("event", "pt", "eta", "phi")
    clean = clean_objects(good, leptons, "event", 0.3)
    sums = clean.groupBy("event").agg(F.count(F.lit(1)).alias("njet"), r(F.sum("pt")).alias("ht"))
    kept = veto.veto_events(T.ev(spark, sf_dir).select("event"), jets, veto.map_hit(jets, VETO, F.col("score")), "event")
    return kept.join(sums, "event", "left").select("event", F.coalesce("njet", F.lit(0)).alias("njet"), F.coalesce("ht", F.lit(0.0)).alias("ht"))
