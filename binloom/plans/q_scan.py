"""Scans, unions, skims, health checks, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from binloom.config import Cut, Uniform, Variable
from binloom.functions.weights import efficiency_sf
from binloom.operators import define, joins, quality
from binloom.operators.fill import fill
from binloom.plans.q_core import PAIR_SQL, SUMS, lepton_pairs
from binloom.plans.registry import bin_sql, query, r, rs, with_ctes
from binloom.session import fresh_path
from binloom.sources import driver_tables as T, sinks, tables

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("q_scan", with_ctes("SELECT event, pt, eta, phi, pdgId, score, flavour, kind FROM items", "items"))
def scan(spark, sf_dir):
    return T.items(spark, sf_dir).select("event", "pt", "eta", "phi", "pdgId", "score", "flavour", "kind")


@query("q_dataset", """
SELECT CAST(o_orderkey % 4 AS INTEGER) AS part, 'all' AS files, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY ALL
UNION ALL SELECT CAST(o_orderkey % 4 AS INTEGER), 'first two', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders WHERE o_orderkey % 4 < 2 GROUP BY ALL""")
def dataset(spark, sf_dir):
    """A dataset of several files, all of them and its first two by name."""
    orders, path = T.table(spark, sf_dir, "orders"), fresh_path(spark, "dataset")
    for i in range(4):
        orders.filter(F.col("o_orderkey") % 4 == i).coalesce(1).write.parquet(f"{path}/orders_{i}.parquet")
    read = {"all": tables.dataset(spark, path, "orders"), "first two": tables.dataset(spark, path, "orders", max_files=2)}
    each = [df.groupBy((F.col("o_orderkey") % 4).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("keys"))
            .select("part", F.lit(name).alias("files"), "rows", "keys") for name, df in read.items()]
    return each[0].unionByName(each[1])


@query("q_process_union", """
SELECT sample, dataset, count(*) AS n, count(d) AS n_day, count(k) AS n_kind FROM (
  SELECT 'A' AS sample, 'orders' AS dataset, o_orderdate AS d, NULL AS k FROM orders
  UNION ALL SELECT 'A', 'events', NULL, event_type FROM events
  UNION ALL SELECT 'B', 'lineitem', l_shipdate, l_returnflag FROM lineitem) GROUP BY ALL""")
def process_union(spark, sf_dir):
    parts = {
        ("A", "orders"): T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("d")),
        ("A", "events"): T.table(spark, sf_dir, "events").select(F.col("event_type").alias("k")),
        ("B", "lineitem"): T.table(spark, sf_dir, "lineitem").select(
            F.col("l_shipdate").alias("d"), F.col("l_returnflag").alias("k")),
    }
    return tables.process_union(parts).groupBy("sample", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count("d").alias("n_day"), F.count("k").alias("n_kind"))


@query("q_friend_join", """
SELECT o_orderkey AS event, o_totalprice AS total, round(o_totalprice * CAST(1.02 AS DOUBLE), 8) AS total_up,
       round(o_totalprice * CAST(0.98 AS DOUBLE), 8) AS total_do FROM orders""")
def friend_join(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "event")
    friend = orders.select("event", F.round(F.col("o_totalprice") * 1.02, 8).alias("total_up"),
                           F.round(F.col("o_totalprice") * 0.98, 8).alias("total_do"))
    return joins.friend_join(orders.select("event", F.col("o_totalprice").alias("total")), friend, ["event"])


@query("q_friend_missing", """
SELECT o_orderkey AS event, o_totalprice AS total, n AS n_returned FROM orders LEFT JOIN (
  SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) ON o_orderkey = k""")
def friend_missing(spark, sf_dir):
    """A friend from another table, which has no row for some events."""
    main = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_totalprice").alias("total"))
    friend = T.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("event")).agg(
        F.count(F.lit(1)).alias("n_returned"))
    return joins.friend_join(main, friend, ["event"])


@query("q_limit", with_ctes("SELECT event, sample, weight FROM ev ORDER BY event LIMIT 1000", "ev"))
def limit(spark, sf_dir):
    return tables.first_rows(T.ev(spark, sf_dir).select("event", "sample", "weight"), 1000, ["event"])


SKIM_CUTS = [Cut("sr", "pt1 > 25 AND pt2 > 13", {"os": "id1*id2 < 0", "ss": "id1*id2 > 0"}), Cut("high", "pt1 > 80")]


@query("q_skim", with_ctes("""
SELECT cut, sample, event, weight, pt1, round(pt1 + pt2, 6) AS ht FROM (
  SELECT *, 'sr_os' AS cut FROM pair WHERE pt1 > 25 AND pt2 > 13 AND id1*id2 < 0
  UNION ALL SELECT *, 'sr_ss' FROM pair WHERE pt1 > 25 AND pt2 > 13 AND id1*id2 > 0
  UNION ALL SELECT *, 'high' FROM pair WHERE pt1 > 80)""", "ev", "obj", **PAIR_SQL))
def skim(spark, sf_dir):
    path = fresh_path(spark, "skim")
    sinks.write_skim(lepton_pairs(spark, sf_dir), path, SKIM_CUTS,
                     {"event": "event", "pt1": "pt1", "ht": "round(pt1 + pt2, 6)"})
    return spark.read.parquet(path).select("cut", "sample", "event", "weight", "pt1", "ht")


@query("q_sumw", with_ctes("SELECT sample, dataset, sum(weight) AS sumw, count(*) AS n FROM ev GROUP BY ALL", "ev"))
def sumw(spark, sf_dir):
    return tables.sumw(T.ev(spark, sf_dir), "weight", ["sample", "dataset"])


@query("q_training_table", with_ctes("""
SELECT event, pt1, pt2, total, sample, CAST(sample = 'SIG' AS INTEGER) AS label FROM pair
WHERE pt1 > 25 AND pt2 > 13 AND sample <> 'DATA'""", "ev", "obj", **PAIR_SQL))
def training_table(spark, sf_dir):
    good = lepton_pairs(spark, sf_dir).filter("pt1 > 25 AND pt2 > 13")
    return tables.label_processes(good, ["event", "pt1", "pt2", "not_there", "total"], {"SIG": 1, "BKG": 0})


@query("q_file_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, CAST(1 AS BIGINT) AS files, count(*) AS rows FROM {t}" for t in TABLES))
def file_counts(spark, sf_dir):
    """One file per table, whether it was written whole or in parts."""
    return quality.dataset_counts({t: T.table(spark, sf_dir, t) for t in TABLES}).select("dataset", "files", "rows")


@query("q_file_health", """
SELECT 'segments' AS folder, 'good' AS state, count(DISTINCT c_mktsegment) AS files, count(*) AS rows FROM customer
UNION ALL SELECT 'nobody', 'good', 1, 0
UNION ALL SELECT 'damaged', 'corrupt', count(*), -1 FROM region
UNION ALL SELECT 'halves', 'truncated', count(*), -1 FROM nation""")
def file_health(spark, sf_dir):
    """A folder with whole files, a whole one without rows, files with a broken footer and files that end too early."""
    path = fresh_path(spark, "health")
    customers, regions, nations = (T.table(spark, sf_dir, t) for t in ("customer", "region", "nation"))
    customers.coalesce(1).write.partitionBy("c_mktsegment").parquet(f"{path}/segments")
    customers.limit(0).coalesce(1).write.parquet(f"{path}/nobody")
    # opening mark, text, a length of five bytes, and the closing mark in place of the end of the line
    broken = F.concat(F.lit("PAR1"), "r_name", F.lit("\x05\x00\x00\x00"))
    regions.select("r_regionkey", broken.alias("value")).coalesce(1).write.partitionBy("r_regionkey").option("lineSep", "PAR1").text(f"{path}/damaged")
    nations.select("n_nationkey", F.concat(F.lit("PAR1"), "n_name").alias("value")).coalesce(1).write.partitionBy("n_nationkey").text(f"{path}/halves")
    found = quality.file_health(spark, path, "part-*")
    folder = F.regexp_extract("file", "(segments|nobody|damaged|halves)", 1)
    return found.groupBy(folder.alias("folder"), "state").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(-1)).alias("rows"))


@query("q_text_results", with_ctes(f"""
SELECT 'csv' AS form, cut, variation, bin, sumw, n FROM h UNION ALL SELECT 'csv', cut, variation, bin, sumw, n FROM h
UNION ALL SELECT 'json', cut, variation, bin, sumw, n FROM h""", "ev", "obj", **PAIR_SQL,
    h=f"SELECT 'all' AS cut, 'nominal' AS variation, {bin_sql('pt1', 20, 20.0, 100.0)} AS bin, sum(weight) AS sumw, count(*) AS n FROM pair GROUP BY ALL"))
def text_results(spark, sf_dir):
    """A result appended twice to a CSV folder and written as JSON, both read back."""
    h = fill(lepton_pairs(spark, sf_dir), [Cut("all", "true")], [Variable("pt1", "pt1", Uniform(20, 20.0, 100.0))], by=())
    h = h.select("cut", "variation", "bin", "sumw", "n")
    path = fresh_path(spark, "results")
    for _ in range(2):
        sinks.append_csv(h, f"{path}/csv")
    sinks.write_json(h, f"{path}/json")
    csv = spark.read.schema(h.schema).option("sep", ";").csv(f"{path}/csv")
    json = spark.read.schema(h.schema).json(f"{path}/json")
    return csv.select(F.lit("csv").alias("form"), "*").unionByName(json.select(F.lit("json").alias("form"), "*"))


@query("q_missing_partitions", """
SELECT c_mktsegment AS category, count(*) AS expected, count(*) FILTER (o.k IS NULL) AS missing,
       round(avg(CASE WHEN o.k IS NULL THEN 1 ELSE 0 END), 8) AS rate
FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000) o ON c.c_custkey = o.k
GROUP BY ALL""")
def missing_partitions(spark, sf_dir):
    expected = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("part"), F.col("c_mktsegment").alias("category"))
    present = T.table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("part"))
    return quality.failure_rates(expected, present, ["part"], "category").withColumn("rate", F.round("rate", 8))


@query("q_missing_parts", """
SELECT c_custkey AS part, c_mktsegment AS category FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def missing_parts(spark, sf_dir):
    expected = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("part"), F.col("c_mktsegment").alias("category"))
    present = T.table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("part"))
    return quality.missing(expected, present, ["part"])


@query("q_duplicates", """
SELECT l_orderkey AS event, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicates(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("line"))
    return quality.duplicates(rows, ["event", "line"])


@query("q_union", """
SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark
UNION ALL SELECT conv_id, text FROM conversations""")
def union(spark, sf_dir):
    parts = [("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")]
    each = [T.table(spark, sf_dir, t).select(F.col(k).alias("id"), "text") for t, k in parts]
    return reduce(lambda a, b: a.unionByName(b), each)


@query("q_common_columns", """
SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region""")
def common_columns(spark, sf_dir):
    frames = {t: T.table(spark, sf_dir, t).select(
        *[F.col(c).alias(c.split("_", 1)[1].replace(f"{t}key", "key")) for c in T.table(spark, sf_dir, t).columns])
        for t in ("nation", "region")}
    return tables.training_table(frames, ["key", "name", "regionkey"], set()).select("key", "name")


@query("q_hist_store", with_ctes(f"""
SELECT sample, 'all' AS cut, 'pt1' AS variable, 'nominal' AS variation, {bin_sql('pt1', 20, 20.0, 100.0)} AS bin,
  CAST(0 AS INT) AS biny, {SUMS} FROM pair GROUP BY ALL""", "ev", "obj", **PAIR_SQL))
def hist_store(spark, sf_dir):
    """Histograms written to the partitioned store and read back."""
    h = fill(lepton_pairs(spark, sf_dir), [Cut("all", "true")], [Variable("pt1", "pt1", Uniform(20, 20.0, 100.0))])
    path = fresh_path(spark, "histograms")
    sinks.write_histograms(h, path)
    return spark.read.parquet(path).select(h.columns)


@query("q_branches", with_ctes("""
SELECT event, sample, round(pt1 + pt2, 6) AS ht, pt1 / 2 AS half, pt1 AS lead FROM pair""", "ev", "obj", **PAIR_SQL))
def branches(spark, sf_dir):
    """A tree of named branches with an overwritten column and a second name for another."""
    df = lepton_pairs(spark, sf_dir)
    df = define.second_name(df, "lead", "pt1")
    df = define.redefine(df, "pt1", "pt1 / 2")
    return define.branches(df, {"event": "event", "sample": "sample", "ht": "round(lead + pt2, 6)", "half": "pt1", "lead": "lead"})


@query("q_sf_text", with_ctes(f"""
SELECT ix, iy, {rs('data/mc', 8)} AS sf, {rs('sqrt((e/mc)*(e/mc) + (data*e/(mc*mc))*(data*e/(mc*mc)))', 8)} AS err FROM (
  SELECT CAST(l_linenumber AS INTEGER) AS ix, CAST(l_discount * 100 AS INTEGER) AS iy, round(avg(l_tax) * 10, 6) AS data, round(avg(l_quantity) / 50, 6) AS mc,
    CAST(0.01 AS DOUBLE) AS e FROM lineitem GROUP BY ALL)"""))
def sf_text(spark, sf_dir):
    """Efficiencies written as a whitespace table, read back and turned into scale factors."""
    cells = T.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_linenumber").alias("ix"), (F.col("l_discount") * 100).cast("int").alias("iy")).agg(
        F.round(F.avg("l_tax") * 10, 6).alias("data"), F.round(F.avg("l_quantity") / 50, 6).alias("mc"))
    row = ["iy", "iy", "ix", "ix", "data", "0.01", "0.01", "mc", "0.01", "0.01", "-1", "-1", "-1", "-1"]
    line = F.concat_ws("  ", *[F.col(c).cast("string") if c in cells.columns else F.lit(c) for c in row])
    path = fresh_path(spark, "sf-text")
    cells.select(line.alias("value")).write.text(path)
    t = tables.whitespace_table(spark, path, tables.SF_COLUMNS)
    sf, err = efficiency_sf(F.col("eff_data"), F.col("eff_mc"), F.col("stat_data"), F.col("stat_mc"))
    return t.select(F.col("pt_lo").cast("int").alias("ix"), F.col("eta_lo").cast("int").alias("iy"), r(sf, 8).alias("sf"), r(err, 8).alias("err"))


@query("q_header_table", f"""
SELECT CAST(p_size AS DOUBLE) AS "mH", {rs('avg(p_retailprice)', 6)} AS "XS", CAST(count(*) AS DOUBLE) AS "N" FROM part GROUP BY p_size""")
def header_table(spark, sf_dir):
    """A table with a header row, which names its columns, written as text and read back."""
    rows = T.table(spark, sf_dir, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("xs"), F.count(F.lit(1)).alias("n"))
    path = fresh_path(spark, "header")
    rows.select(F.concat_ws("   ", F.col("p_size").cast("string"), r("xs", 6).cast("string"), F.col("n").cast("string")).alias("value")).write.text(path)
    spark.range(1).select(F.lit("  mH   XS    N").alias("value")).write.mode("append").text(path)
    return tables.whitespace_table(spark, path, header_word="mH")
