"""Yield tables, nuisance tables and bin boundaries from content."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.operators import cards, rebinning
from binloom.plans.q_core import PT20
from binloom.plans.q_hist import LEAD, hists
from binloom.plans.q_syst import YS, nominal_yields
from binloom.plans.registry import query, r, rs, with_ctes
from binloom.sources import driver_tables as T


@query("q_process_ids", """
SELECT n_name AS sample, is_signal, kind, CAST(CASE kind WHEN 'signal' THEN 1 - rk ELSE rk END AS INTEGER) AS process_id
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_nationkey) AS rk FROM (
  SELECT *, CASE WHEN is_signal <> 0 THEN 'signal' WHEN n_regionkey <> 4 THEN 'background' END AS kind FROM (
    SELECT *, CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS is_signal FROM nation)) WHERE kind IS NOT NULL)""")
def process_ids(spark, sf_dir):
    return cards.process_ids(structure(spark, sf_dir), "key").select("sample", "is_signal", "kind", "process_id")


def structure(spark, sf_dir):
    return T.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("sample"),
        F.when(F.col("n_regionkey") == 0, 1).when(F.col("n_regionkey") == 1, 2).otherwise(0).alias("is_signal"),
        (F.col("n_regionkey") == 4).cast("int").alias("is_data"))


@query("q_card_processes", """
WITH s AS (SELECT *, CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS is_signal FROM nation WHERE n_regionkey <> 4),
p AS (SELECT n_name AS sample, is_signal, CASE WHEN is_signal <> 0 THEN 1 - row_number() OVER (PARTITION BY is_signal <> 0 ORDER BY n_nationkey)
  ELSE row_number() OVER (PARTITION BY is_signal <> 0 ORDER BY n_nationkey) END AS process_id FROM s),
c AS (SELECT '' AS card UNION ALL SELECT sample FROM p WHERE is_signal = 2)
SELECT card, sample, CAST(process_id AS INTEGER) AS process_id,
  CAST(row_number() OVER (PARTITION BY card ORDER BY CASE is_signal WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END, abs(process_id)) - 1 AS INTEGER) AS position
FROM c JOIN p ON is_signal <> 2 OR sample = card""")
def card_processes(spark, sf_dir):
    """One card per alternative signal: its processes in order, with their numbers."""
    return cards.card_processes(structure(spark, sf_dir), "key").select("card", "sample", "process_id", "position")


@query("q_remove_from_cuts", with_ctes(
    "SELECT * FROM y WHERE NOT (sample = 'SIG' AND cut IN ('os','tight')) AND NOT (sample = 'BKG' AND cut = 'ss')", "ev", "obj", **YS))
def remove_from_cuts(spark, sf_dir):
    return cards.remove_from_cuts(nominal_yields(spark, sf_dir), {"SIG": ["os", "tight"], "BKG": ["ss"]})


@query("q_scale_yields", with_ctes("""
SELECT * REPLACE (yield * CASE WHEN sample='SIG' THEN 2 WHEN sample='BKG' AND cut='os' THEN 0.5 WHEN sample='BKG' AND cut='ss' THEN 4 ELSE 1 END AS yield) FROM y""",
    "ev", "obj", **YS))
def scale_yields(spark, sf_dir):
    return cards.scale_yields(nominal_yields(spark, sf_dir), {"SIG": 2.0, "BKG": {"os": 0.5, "ss": 4.0}})


@query("q_rate_table", with_ctes("""
SELECT cut, variable, round(coalesce(sum(yield) FILTER (sample='DATA'),0),4) AS observation, round(coalesce(sum(yield) FILTER (sample='SIG'),0),4) AS "SIG",
  round(coalesce(sum(yield) FILTER (sample='BKG'),0),4) AS "BKG" FROM y GROUP BY ALL""", "ev", "obj", **YS))
def rate_table(spark, sf_dir):
    return cards.rate_table(nominal_yields(spark, sf_dir), ["SIG", "BKG"], "DATA")


@query("q_nuisance_matrix", with_ctes("""
SELECT DISTINCT cut, variable, nuisance, type, s AS "SIG", b AS "BKG" FROM y, (VALUES ('lumi','lnN','1.025','1.025'), ('xs','lnN','1.2/0.9','-'),
  ('scale','shape','1.000','1.000'), ('bkgshape','shape','-','1.000')) n(nuisance, type, s, b) WHERE nuisance <> 'xs' OR cut IN ('os','ss')""", "ev", "obj", **YS))
def nuisance_matrix(spark, sf_dir):
    return cards.nuisance_matrix(nominal_yields(spark, sf_dir), {"lumi": {"SIG": "1.025", "BKG": "1.025"}, "xs": {"SIG": "1.2/0.9"}},
                                 {"scale": ["SIG", "BKG"], "bkgshape": ["BKG"]}, ["SIG", "BKG"], {"xs": ["os", "ss"]})


@query("q_nuisance_groups", """
SELECT r_name AS grp, string_agg(n_name, ' ' ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def nuisance_groups(spark, sf_dir):
    n, g = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "region")
    groups = cards.nuisance_groups(n.join(g, n.n_regionkey == g.r_regionkey).select(
        F.col("r_name").alias("grp"), F.col("n_name").alias("nuisance")))
    return groups.withColumn("members", F.array_join("members", " "))


@query("q_gof_table", """
SELECT p_brand AS state, v AS variable, p, p < 0.05 AS bad FROM (SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'pt1' WHEN 1 THEN 'lead_pt1' ELSE 'mll' END AS v,
  p_size / CAST(100 AS DOUBLE) AS p FROM part)""")
def gof_table(spark, sf_dir):
    var = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'pt1' WHEN 1 THEN 'lead_pt1' ELSE 'mll' END")
    res = T.table(spark, sf_dir, "part").select(
        F.concat(F.lit("GoF_"), F.col("p_brand"), F.lit("_"), var, F.lit(".json")).alias("name"), (F.col("p_size") / 100.0).alias("p"))
    return cards.goodness_table(res, ["pt1", "lead_pt1", "mll"])


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


ALLBINS = {**LEAD, "bins": """SELECT k.cut, b.bin, coalesce(sum(sumw),0) AS w, coalesce(sum(sumw2),0) AS q FROM (SELECT DISTINCT cut FROM h) k
  JOIN (SELECT CAST(unnest(generate_series(1,20)) AS INTEGER) AS bin) b ON true LEFT JOIN h ON h.cut = k.cut AND h.bin = b.bin AND h.sample = 'SIG' GROUP BY ALL"""}


@query("q_flat_edges", recursive(with_ctes("""
SELECT cut, CAST(row_number() OVER (PARTITION BY cut ORDER BY o, c) - 1 AS INTEGER) AS pos, c AS edge FROM (
  SELECT cut, 1 AS o, c FROM walk WHERE hit UNION ALL SELECT cut, 0, CAST(-1 AS DOUBLE) FROM tgt UNION ALL SELECT cut, 2, CAST(1 AS DOUBLE) FROM tgt)""",
    "ev", "obj", **ALLBINS,
    tgt="""SELECT cut, total / coalesce((SELECT max(n) FROM range(1, 7) r(n) WHERE total / n >= 40), 1) AS target FROM (SELECT cut, sum(w) AS total FROM bins GROUP BY cut)""",
    walk="""SELECT cut, CAST(21 AS INTEGER) AS bin, CAST(0 AS DOUBLE) AS acc, false AS hit, CAST(0 AS DOUBLE) AS c FROM tgt
      UNION ALL SELECT w.cut, w.bin - 1, CASE WHEN w.acc + f.w >= t.target THEN 0 ELSE w.acc + f.w END, w.acc + f.w >= t.target,
        CAST(20 + 4 * (w.bin - 1) - 2 AS DOUBLE) FROM walk w JOIN bins f ON f.cut = w.cut AND f.bin = w.bin - 1 JOIN tgt t ON t.cut = w.cut""")))
def flat_edges(spark, sf_dir):
    sig = hists(spark, sf_dir).filter("sample = 'SIG'")
    out = rebinning.flat_edges(sig, ["cut"], PT20, 6, 40.0)
    return out.select("cut", F.posexplode("edges").alias("pos", "edge"))


@query("q_auto_rebin", recursive(with_ctes("""
SELECT cut, bin, CAST(greatest(least(g0, last - 1), 1) AS INTEGER) AS grp FROM walk JOIN (SELECT cut, max(g) AS last FROM walk GROUP BY cut) USING (cut) WHERE bin >= 1""",
    "ev", "obj", **ALLBINS,
    walk="""SELECT DISTINCT cut, CAST(0 AS INTEGER) AS bin, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS q, 1 AS g, 1 AS g0 FROM bins
      UNION ALL SELECT cut, bin, CASE WHEN ok THEN 0 ELSE w END, CASE WHEN ok THEN 0 ELSE q END, CASE WHEN ok THEN g + 1 ELSE g END, g FROM (
        SELECT a.cut, f.bin, a.w + f.w AS w, a.q + f.q AS q, a.g, a.w + f.w > 0 AND sqrt(a.q + f.q) <= 0.25 * (a.w + f.w) AS ok
        FROM walk a JOIN bins f ON f.cut = a.cut AND f.bin = a.bin + 1)""")))
def auto_rebin(spark, sf_dir):
    sig = hists(spark, sf_dir).filter("sample = 'SIG'")
    return rebinning.uncertainty_groups(sig, ["cut"], 20)


@query("q_gof_toys", with_ctes(f"""
SELECT priority AS state, {rs('m', 6)} AS observed, count(*) AS toys, {rs('avg(CASE WHEN total >= m THEN 1 ELSE 0 END)', 8)} AS p
FROM ev JOIN (SELECT priority, avg(total) AS m FROM ev WHERE sample = 'DATA' GROUP BY priority) USING (priority)
WHERE sample <> 'DATA' GROUP BY priority, m""", "ev"))
def gof_toys(spark, sf_dir):
    """Distribution of the statistic in simulation against its mean in data, per final state."""
    e = T.ev(spark, sf_dir).select(F.col("priority").alias("state"), "sample", "total")
    out = cards.toy_summary(e.filter("sample != 'DATA'").drop("sample"), e.filter("sample = 'DATA'"), "total", "state")
    return out.select("state", r("observed").alias("observed"), "toys", r("p", 8).alias("p"))
