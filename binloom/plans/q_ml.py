"""Model scoring, training tables and their preparation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from binloom.operators import ordered, resample, scoring
from binloom.plans.q_core import PAIR_SQL, lepton_pairs
from binloom.plans.registry import query, r, rs, with_ctes
from binloom.sources import driver_tables as T


def network(sizes, seed: int, softmax: bool = True) -> scoring.Dense:
    """Weights from a rule: ((7 i + 13 j + 5 layer + seed) mod 11 - 5) / 10, bias ((3 j + layer) mod 5 - 2) / 10."""
    layers = []
    for n, (a, b) in enumerate(zip(sizes, sizes[1:])):
        i, j = np.arange(a)[:, None], np.arange(b)[None, :]
        layers.append((((7 * i + 13 * j + 5 * n + seed) % 11 - 5) / 10.0, ((3 * np.arange(b) + n) % 5 - 2) / 10.0))
    return scoring.Dense(tuple(layers), softmax)


def network_sql(sizes, seed: int, name: str, softmax: bool = True) -> dict[str, str]:
    """The same network with rows per (event, unit): layers are joins on the weight rule."""
    out = {f"{name}0": f"SELECT vec_id, i - 1 AS u, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, {sizes[0] + 1}) r(i)"}
    for n, b in enumerate(sizes[1:]):
        value = f"sum(x * (((7*u + 13*j + {5 * n + seed}) % 11 - 5) / 10e0)) + (((3*j + {n}) % 5 - 2) / 10e0)"
        if n < len(sizes) - 2:
            value = f"greatest({value}, 0)"
        out[f"{name}{n + 1}"] = f"SELECT vec_id, j AS u, {value} AS x FROM {name}{n}, range(0, {b}) r(j) GROUP BY vec_id, j"
    last = f"{name}{len(sizes) - 1}"
    if softmax:
        out[f"{name}out"] = f"SELECT vec_id, u, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS x FROM {last}"
    else:
        out[f"{name}out"] = f"SELECT * FROM {last}"
    return out


def features(spark, sf_dir, n):
    e = T.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(n)]), [f"f{i}" for i in range(n)]


def _pick(table, n):
    return ", ".join(f"{rs(f'max(CASE WHEN u = {i} THEN x END)', 8)} AS s{i}" for i in range(n)) + f" FROM {table} GROUP BY vec_id"


SNN = (18, 30, 30, 2)


@query("q_dense_score", with_ctes(f"SELECT vec_id, {_pick('mout', 2)}", **network_sql(SNN, 0, "m")))
def dense_score(spark, sf_dir):
    df, cols = features(spark, sf_dir, 18)
    out = scoring.dense_scores(df, cols, network(SNN, 0), "s")
    return out.select("vec_id", *[r(F.get("s", F.lit(i)), 8).alias(f"s{i}") for i in range(2)])


REG = (42, 32, 3)


@query("q_regression_score", with_ctes(f"SELECT vec_id, {_pick('mout', 3)}", **network_sql(REG, 3, "m", False)))
def regression_score(spark, sf_dir):
    df, cols = features(spark, sf_dir, 42)
    out = scoring.dense_scores(df, cols, network(REG, 3, False), "s")
    return out.select("vec_id", *[r(F.get("s", F.lit(i)), 8).alias(f"s{i}") for i in range(3)])


PAR = (10, 12, 2)


@query("q_parity_fold", with_ctes(f"""
SELECT vec_id, {rs('max(CASE WHEN u = 0 THEN x END)', 8)} AS s0 FROM (SELECT * FROM oout WHERE vec_id % 2 = 0 UNION ALL SELECT * FROM eout WHERE vec_id % 2 <> 0) GROUP BY vec_id""",
    **network_sql(PAR, 1, "e"), **network_sql(PAR, 2, "o")))
def parity_fold(spark, sf_dir):
    df, cols = features(spark, sf_dir, 10)
    out = scoring.parity_scores(df, "vec_id", cols, network(PAR, 1), network(PAR, 2), "s")
    return out.select("vec_id", r(F.get("s", F.lit(0)), 8).alias("s0"))


OBJ = (3, 4, 2)


@query("q_object_scores", with_ctes(f"""
SELECT event, CAST(idx AS INTEGER) AS idx, {rs('s', 8)} AS score FROM (
  SELECT event, idx, max(CASE WHEN u = 1 THEN x END) AS s FROM (SELECT event, idx, u, exp(x)/sum(exp(x)) OVER (PARTITION BY event, idx) AS x FROM n2) GROUP BY ALL)""",
    "obj", l="SELECT * FROM obj WHERE kind = 'lepton'",
    n0="SELECT event, idx, 0 AS u, pt/100e0 AS x FROM l UNION ALL SELECT event, idx, 1, eta FROM l UNION ALL SELECT event, idx, 2, score FROM l",
    n1="SELECT event, idx, j AS u, greatest(sum(x*(((7*u+13*j+4) % 11 - 5)/10e0)) + ((3*j) % 5 - 2)/10e0, 0) AS x FROM n0, range(0,4) r(j) GROUP BY event, idx, j",
    n2="SELECT event, idx, j AS u, sum(x*(((7*u+13*j+9) % 11 - 5)/10e0)) + ((3*j+1) % 5 - 2)/10e0 AS x FROM n1, range(0,2) r(j) GROUP BY event, idx, j"))
def object_scores(spark, sf_dir):
    """All leptons of an event are scored as flat rows."""
    flat = T.ranked(spark, sf_dir, "lepton").withColumn("pt", F.col("pt") / 100.0)
    out = scoring.dense_scores(flat, ["pt", "eta", "score"], network(OBJ, 4), "scores")
    return out.select("event", "idx", r(F.get("scores", F.lit(1)), 8).alias("score"))


def labelled(spark, sf_dir, n=6):
    df, cols = features(spark, sf_dir, n)
    return df.withColumn("y", (F.col("label") < 5).cast("double")), cols


@query("q_bdt")
def bdt(spark, sf_dir):
    """Boosted trees trained on one hash split and applied to all rows."""
    df, cols = labelled(spark, sf_dir)
    train = df.filter(ordered.hash_percent(F.col("vec_id")) < 80)
    model = scoring.bdt_train(train, cols, "y", trees=8, depth=3, bins=32)
    return scoring.bdt_scores(df, cols, model, "bdt").select("vec_id", "bdt")


@query("q_forest")
def forest(spark, sf_dir):
    """A forest per category; events outside every category carry the sentinel."""
    df, cols = labelled(spark, sf_dir)
    cat = F.pmod(F.col("vec_id"), F.lit(3)).cast("int")
    models = {c: (scoring.forest_train(df.filter(cat == c), cols[: 4 + c], "y", trees=5, depth=4), cols[: 4 + c]) for c in (0, 1)}
    out = scoring.forest_scores(df, cat, models, 2, "p")
    return out.select("vec_id", F.get("p", F.lit(0)).alias("p0"), F.get("p", F.lit(1)).alias("p1"))


@query("q_minmax", with_ctes(f"""
SELECT event, sample, {rs('(pt1 - min(pt1) OVER ())/(max(pt1) OVER () - min(pt1) OVER ())', 9)} AS pt1,
  {rs('(total - min(total) OVER ())/(max(total) OVER () - min(total) OVER ())', 9)} AS total FROM pair""", "ev", "obj", **PAIR_SQL))
def minmax(spark, sf_dir):
    out = scoring.minmax(lepton_pairs(spark, sf_dir).select("event", "sample", "pt1", "total"), ["pt1", "total"])
    return out.select("event", "sample", r("pt1", 9).alias("pt1"), r("total", 9).alias("total"))


@query("q_dropna", """
SELECT doc_id, quality, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL""")
def dropna(spark, sf_dir):
    d, l = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), T.table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", "quality", "n_chars").dropna()


@query("q_balance", with_ctes("""
SELECT event, sample, 1 AS is_sig FROM ev WHERE sample = 'SIG' UNION ALL
SELECT event, sample, 0 FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(event AS VARCHAR)), event) AS k FROM ev WHERE sample <> 'SIG')
WHERE k <= (SELECT count(*) FROM ev WHERE sample = 'SIG')""", "ev"))
def balance(spark, sf_dir):
    """Labelled classes with the background reduced to as many rows as the signal has."""
    e = T.ev(spark, sf_dir).select("event", "sample")
    signal, background = e.filter("sample = 'SIG'"), e.filter("sample != 'SIG'")
    kept = ordered.first_n_by_hash(background, "event", signal.count())
    return signal.withColumn("is_sig", F.lit(1)).unionByName(kept.withColumn("is_sig", F.lit(0)))


@query("q_split", """
SELECT o_orderkey AS event, CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM orders""")
def split(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"))
    return o.withColumn("part", F.when(ordered.hash_percent(F.col("event")) < 80, "train").otherwise("test"))


ROC = {"pts": "SELECT total, count(*) FILTER (sample='SIG') AS pos, count(*) FILTER (sample<>'SIG') AS neg FROM ev GROUP BY total",
       "run": """SELECT total, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
         FROM pts WINDOW w AS (ORDER BY total DESC ROWS UNBOUNDED PRECEDING)"""}


def roc(spark, sf_dir):
    sig = F.col("sample") == "SIG"
    return ordered.running_sums(T.ev(spark, sf_dir).select("total", "sample"), "total", {
        "pos": F.when(sig, 1).otherwise(0), "neg": F.when(sig, 0).otherwise(1)}, descending=True)


@query("q_roc_curve", with_ctes("SELECT total AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM run", "ev", **ROC))
def roc_curve(spark, sf_dir):
    return roc(spark, sf_dir).select(F.col("total").alias("score"), F.col("pos_run").alias("tp"), F.col("neg_run").alias("fp"))


@query("q_auc", with_ctes(f"SELECT {rs('sum(neg * (tp + tp - pos) / 2e0) / (max(np) * max(nn))', 9)} AS auc FROM run", "ev", **ROC))
def auc(spark, sf_dir):
    """Area by trapezoids; the previous point is the current one minus its own counts."""
    area = F.sum(F.col("neg") * (2 * F.col("pos_run") - F.col("pos")) / 2.0)
    return roc(spark, sf_dir).agg(r(area / (F.sum("pos") * F.sum("neg")), 9).alias("auc"))


@query("q_score_ratio", f"""
SELECT vec_id, {rs('a/nullif(1-b, 0)', 8)} AS lld, {rs('b/nullif(1-a, 0)', 8)} AS ttd FROM (
  SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS a, abs(CAST(embedding[2] AS DOUBLE)) AS b FROM embeddings)""")
def score_ratio(spark, sf_dir):
    a, b = (F.abs(F.get("embedding", F.lit(i)).cast("double")) for i in (0, 1))
    return T.table(spark, sf_dir, "embeddings").select(
        "vec_id", r(F.try_divide(a, 1 - b), 8).alias("lld"), r(F.try_divide(b, 1 - a), 8).alias("ttd"))


@query("q_bootstrap")
def bootstrap(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_totalprice").alias("w"))
    return resample.bootstrap(rows, "event", "w", 0.7, seed=6)
