"""Array functions on variable-length collections, name handling, mass tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from binloom.functions import arrays as A, names as N
from binloom.operators import objects as O, xsec
from binloom.plans.registry import dr2_sql, query, r, rs, with_ctes
from binloom.sources import driver_tables as T


def vectors(spark, sf_dir):
    return T.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


V = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("q_vec_product", f"SELECT vec_id, {rs('list_reduce(list_transform(v, lambda x: 1 + x), lambda a, b: a*b)', 8)} AS prod, "
                        f"{rs('list_sum(v)', 8)} AS total FROM {V}")
def vec_product(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        "vec_id", r(A.vec_product(F.transform("v", lambda x: 1 + x)), 8).alias("prod"), r(A.vec_sum(F.col("v")), 8).alias("total"))


@query("q_vector_functions", f"""
SELECT vec_id, {rs('list_sum(list_transform(v, lambda x: ln(abs(x) + 1)))', 8)} AS sum_log, {rs('list_sum(list_transform(v, lambda x: abs(x)))', 8)} AS sum_abs,
  CAST(len(list_filter(v, lambda x: CAST(floor(x*100) AS BIGINT) % 2 <> 0)) AS INTEGER) AS n_odd, CAST(len(list_filter(v, lambda x: x > 0.1)) AS INTEGER) AS n_high,
  coalesce(v[65], -7) AS beyond, coalesce(v[3], -7) AS third FROM {V}""")
def vector_functions(spark, sf_dir):
    v = F.col("v")
    return vectors(spark, sf_dir).select(
        "vec_id", r(A.vec_sum(A.log_vec(F.transform(v, lambda x: F.abs(x) + 1))), 8).alias("sum_log"),
        r(A.vec_sum(A.abs_vec(v)), 8).alias("sum_abs"),
        F.size(F.filter(A.odd_vec(F.transform(v, lambda x: F.floor(x * 100))), lambda b: b)).alias("n_odd"),
        A.count_where(v, lambda x: x > 0.1).alias("n_high"), A.alt(v, 64, -7.0).alias("beyond"), A.alt(v, 2, -7.0).alias("third"))


@query("q_argsort", f"""
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) - 1 AS INTEGER) AS rank, CAST(i - 1 AS INTEGER) AS idx
FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {V})""")
def argsort(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(A.argsort_desc(F.col("v"))).alias("rank", "idx"))


@query("q_take", f"""
SELECT vec_id, {rs('v[label + 1]', 8)} AS a, {rs('v[64 - label]', 8)} AS b, {rs('CASE WHEN label >= 3 THEN v[label - 2] ELSE -5 END', 8)} AS c,
  CAST(-5 AS DOUBLE) AS d, CAST(CASE WHEN label >= 3 THEN 1 ELSE 2 END AS INTEGER) AS missing FROM {V}""")
def take(spark, sf_dir):
    label = F.col("label")
    idx = F.array(label, 63 - label, label - 3, F.lit(70))
    got, plain = A.take_or(F.col("v"), idx, -5.0), A.take(F.col("v"), idx)
    return vectors(spark, sf_dir).select(
        "vec_id", *[r(F.get(got, F.lit(i)), 8).alias(n) for i, n in enumerate("abcd")],
        A.count_where(plain, lambda x: x.isNull()).alias("missing"))


@query("q_sort_collection", with_ctes("""
SELECT event, CAST(row_number() OVER (PARTITION BY event ORDER BY score DESC, idx) - 1 AS INTEGER) AS pos, CAST(idx AS INTEGER) AS idx, score, eta FROM obj WHERE kind = 'jet'""", "obj"))
def sort_collection(spark, sf_dir):
    """All jets of an event by score; both orders share the exchange on the event."""
    place = F.row_number().over(Window.partitionBy("event").orderBy(F.desc("score"), "idx")) - 1
    return T.ranked(spark, sf_dir, "jet").select("event", place.alias("pos"), "idx", "score", "eta")


@query("q_masked_sort", f"""
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY y DESC) - 1 AS INTEGER) AS pos, y FROM (
  SELECT vec_id, CASE WHEN x > 0.05 THEN x ELSE 0 END AS y FROM (SELECT vec_id, unnest(v) AS x FROM {V}))""")
def masked_sort(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(
        A.masked_sort_desc(F.col("v"), lambda x: x > 0.05)).alias("pos", "y"))


@query("q_pairs", with_ctes(f"""
SELECT a.event, count(*) AS n_pairs, {rs('sum(a.pt * b.pt)', 5)} AS pp, CAST(count(*) FILTER ((a.eta-b.eta)*(a.eta-b.eta) < 1) AS BIGINT) AS n_near
FROM obj a JOIN obj b ON a.event = b.event AND a.idx < b.idx WHERE a.kind = 'jet' AND b.kind = 'jet' GROUP BY a.event""", "obj"))
def pairs(spark, sf_dir):
    """All pairs of an event's jets, counted and summed without forming them."""
    jets = T.items(spark, sf_dir).filter("kind = 'jet'").select("event", "pt", "eta")
    sums = O.pair_summary(jets, "event", "pt", "eta", 1.0).filter("n_pairs > 0")
    return sums.select("event", "n_pairs", r("products", 5).alias("pp"), "n_near")


@query("q_jet_lepton_pairs", with_ctes(f"""
SELECT ev.event, coalesce(n_jets, 0) AS n_jets, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_near, 0) AS n_near, coalesce(n_any, 0) AS n_any,
  coalesce(n_all, 0) AS n_all FROM ev LEFT JOIN (
  SELECT event, count(*) AS n_jets, CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(near) AS BIGINT) AS n_near, count(*) FILTER (near > 0) AS n_any,
    count(*) FILTER (near = n) AS n_all FROM (
    SELECT j.event, j.idx, count(l.idx) AS n, count(l.idx) FILTER ({dr2_sql('l', 'j').replace('l_', 'l.').replace('j_', 'j.')} < 0.64) AS near
    FROM obj j LEFT JOIN (SELECT * FROM obj WHERE kind = 'lepton' AND pt >= 10) l ON l.event = j.event
    WHERE j.kind = 'jet' AND j.eta <= 5 GROUP BY j.event, j.idx) GROUP BY event) USING (event)""", "ev", "obj"))
def jet_lepton_pairs(spark, sf_dir):
    """Combinations of all jets and leptons, reduced per jet: any lepton near, all leptons near.  Every event has its row."""
    objects = T.items(spark, sf_dir).select("event", "kind", "pt", "eta", "phi")
    jets = objects.filter("kind = 'jet' AND eta <= 5").select("event", "eta", "phi")
    counted = O.near_counts(jets, objects.filter("kind = 'lepton' AND pt >= 10"), "event", 0.8)
    copies = F.col("copies")
    whole = {"n_jets": copies, "n_pairs": copies * F.col("n_others"), "n_near": copies * F.col("n_near"),
             "n_any": F.when(F.col("n_near") > 0, copies), "n_all": F.when(F.col("n_near") == F.col("n_others"), copies)}
    sums = counted.groupBy("event").agg(*[F.sum(c).alias(n) for n, c in whole.items()])
    return T.ev(spark, sf_dir).select("event").join(sums, "event", "left").select("event", *[F.coalesce(n, F.lit(0)).alias(n) for n in whole])


PARTS = ["GluGluH", "VBFH", "HZJ", "HWplusJ", "ttH"]


@query("q_sample_classifier", """
SELECT p_partkey, CASE WHEN contains(s, 'Mlarge') THEN 'unknown' WHEN contains(s, 'GluGluH') THEN 'ggH' WHEN contains(s, 'VBFH') THEN 'vbfH'
  WHEN contains(s, 'HZJ') THEN 'ZH' WHEN contains(s, 'HWplusJ') THEN 'HWplus' WHEN contains(s, 'ttH') THEN 'ttH' ELSE 'unknown' END AS mode,
  CASE WHEN contains(s, 'Mlarge') THEN 0 ELSE CAST(regexp_extract(s, '_M([0-9]+)', 1) AS DOUBLE) END AS mass
FROM (SELECT p_partkey, (CASE p_partkey % 6 WHEN 0 THEN 'GluGluH' WHEN 1 THEN 'VBFH' WHEN 2 THEN 'HZJ' WHEN 3 THEN 'HWplusJ' WHEN 4 THEN 'ttH' ELSE 'DY' END)
  || 'ToWW_M' || (CASE WHEN p_size = 50 THEN 'large' ELSE CAST(p_size + 100 AS VARCHAR) END) || '_' || p_type AS s FROM part)""")
def sample_classifier(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    prefix = F.get(F.array(*[F.lit(x) for x in [*PARTS, "DY"]]), (F.col("p_partkey") % 6).cast("int"))
    mass = F.when(F.col("p_size") == 50, "large").otherwise((F.col("p_size") + 100).cast("string"))
    name = F.concat(prefix, F.lit("ToWW_M"), mass, F.lit("_"), F.col("p_type"))
    return part.select("p_partkey", N.production_mode(name).alias("mode"), N.mass_of(name).alias("mass"))


@query("q_histogram_names", with_ctes("""
SELECT DISTINCT sample, nuis, side, 'histo_' || sample || CASE WHEN nuis = 'nominal' THEN '' ELSE '_' || nuis || side END AS name,
  CASE WHEN nuis = 'nominal' THEN 'nominal' ELSE nuis || side END AS variation
FROM (SELECT sample, CASE priority WHEN '1-URGENT' THEN 'nominal' WHEN '5-LOW' THEN 'JES_1' ELSE 'lumi' END AS nuis,
  CASE WHEN priority = '1-URGENT' THEN '' WHEN dataset = 0 THEN 'Up' ELSE 'Down' END AS side FROM ev)""", "ev"))
def histogram_names(spark, sf_dir):
    e = T.ev(spark, sf_dir).select("sample", F.expr("CASE priority WHEN '1-URGENT' THEN 'nominal' WHEN '5-LOW' THEN 'JES_1D' ELSE 'lumi' END").alias("n"),
                                   F.expr("CASE WHEN priority = '1-URGENT' THEN '' WHEN dataset = 0 THEN 'Up' ELSE 'Down' END").alias("side")).distinct()
    e = e.withColumn("nuis", F.regexp_replace("n", "D$", ""))
    variation = F.concat("nuis", "side")
    named = e.select("sample", "nuis", "side", N.histogram_name(F.col("sample"), variation).alias("name"))
    return named.select("*", N.variation_in(F.col("name"), F.col("sample")).alias("variation"))


@query("q_xs_table", f"""
SELECT mass, {rs('zh - ggzh', 6)} AS zh, {rs('wp + wm', 6)} AS wh, {rs('1 + lo/100', 8)} AS scale_down, {rs('1 + hi/100', 8)} AS scale_up FROM (
  SELECT CAST(p_size AS DOUBLE) AS mass, avg(p_retailprice) AS zh, min(p_retailprice)/4 AS ggzh, max(p_retailprice) AS wp,
    min(p_retailprice) AS wm, -CAST(p_size AS DOUBLE)/10 AS lo, CAST(p_size AS DOUBLE)/7 AS hi FROM part GROUP BY p_size)""")
def xs_table(spark, sf_dir):
    t = T.table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("mass")).agg(
        F.avg("p_retailprice").alias("ZH"), (F.min("p_retailprice") / 4).alias("ggZH"), F.max("p_retailprice").alias("Wplus"),
        F.min("p_retailprice").alias("Wminus")).withColumns({"lo": -F.col("mass") / 10, "hi": F.col("mass") / 7})
    out = xsec.combine_production(t)
    return out.select("mass", r("zh_qq").alias("zh"), r("wh").alias("wh"), r("scale_down", 8).alias("scale_down"), r("scale_up", 8).alias("scale_up"))


@query("q_xs_at_mass", f"""
SELECT event, {rs('''coalesce(max(CASE WHEN xs.m = t THEN y END), CASE WHEN max(CASE WHEN xs.m <= t THEN xs.m END) IS NULL OR max(CASE WHEN xs.m > t THEN 1 END) IS NULL THEN 0
  ELSE arg_max(y, m) FILTER (m <= t) + (t - max(m) FILTER (m <= t)) * (arg_min(y, m) FILTER (m > t) - arg_max(y, m) FILTER (m <= t))
     / (min(m) FILTER (m > t) - max(m) FILTER (m <= t)) END)''', 7)} AS xs
FROM (SELECT o_orderkey AS event, floor(o_totalprice/1000)/4 AS t FROM orders) e, (SELECT CAST(p_size AS DOUBLE) AS m, avg(p_retailprice) AS y FROM part GROUP BY p_size) xs
GROUP BY event, t""")
def xs_at_mass(spark, sf_dir):
    """Table value at each event's mass: exact hit, else the line between its neighbours, 0 outside."""
    points = T.table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("m")).agg(F.avg("p_retailprice").alias("y"))
    ev = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), (F.floor(F.col("o_totalprice") / 1000) / 4).alias("t"))
    curve = xsec.curve_from(points, "m", "y", limit=100)
    return ev.select("event", r(curve.at(F.col("t"), clamp=False), 7).alias("xs"))
