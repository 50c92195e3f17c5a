"""The given tables seen as collision-style records.

An order is an event, its line items are the event's objects.  Items with line number up to 3
are "leptons", the others "jets"; the split is a row-local attribute, so no grouping is needed to
decide it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from binloom.operators.collect import leading_collections

# falling pt ("-" marks falling), with ties broken by the remaining identity of the item
ORDER = ["-pt", "line", "part", "supp", "ship"]
FIELDS = ["pt", "eta", "phi", "mass", "pdgId", "score", "flavour"]
LUMI = 2.0
MASS = "pt * 0.1D"         # an item's mass, where it is not worth carrying along


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS event",
        "l_extendedprice / 1000D AS pt",
        "(l_discount - 0.05D) * 50D AS eta",
        "(l_quantity - 25.5D) / 25.5D * pi() AS phi",
        "l_extendedprice / 1000D * 0.1D AS mass",
        "IF(l_linestatus = 'F', 11, 13) * IF(l_returnflag = 'R', 1, -1) AS pdgId",
        "l_tax / 0.08D AS score",
        "CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 4 ELSE 0 END AS flavour",
        "IF(l_linenumber <= 3, 'lepton', 'jet') AS kind",
        "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supp", "l_shipdate AS ship")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS event",
        "CASE o_orderstatus WHEN 'P' THEN 'DATA' WHEN 'O' THEN 'SIG' ELSE 'BKG' END AS sample",
        "o_custkey % 3 AS dataset",
        f"""IF(o_orderstatus = 'P', 1D, {LUMI}D * CASE o_orderpriority WHEN '1-URGENT' THEN 1.5D
            WHEN '5-LOW' THEN -0.5D WHEN '4-NOT SPECIFIED' THEN 0D ELSE 1D END) AS weight""",
        "o_totalprice / 1000D AS total", "o_orderpriority AS priority")


KIND_OF = {"lep": "lepton", "jet": "jet"}


def collections(spark: SparkSession, sf_dir: str, want: dict[str, int] | None = None,
                fields: list[str] | None = None) -> DataFrame:
    """Per event: its leading leptons (``lep``) and jets (``jet``) as bounded arrays.

    ``fields`` names the object attributes carried along; fewer means a narrower scan and shuffle.
    """
    want = want or {"lep": 3, "jet": 4}
    return leading_collections(items(spark, sf_dir), "event", "kind", ORDER, fields or FIELDS,
                               {KIND_OF[name]: (name, k) for name, k in want.items()})


def records(spark: SparkSession, sf_dir: str, how: str = "inner", want: dict[str, int] | None = None,
            fields: list[str] | None = None) -> DataFrame:
    """Events with their leading collections; ``left`` keeps events without any object."""
    want = want or {"lep": 3, "jet": 4}
    out = ev(spark, sf_dir).join(collections(spark, sf_dir, want, fields), "event", how)
    if how == "left":
        out = out.withColumns({
            c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in want})
    return out


def ranked(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """All objects of a kind with ``idx``, their 0-based rank in the event."""
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDER]
    rank = F.row_number().over(Window.partitionBy("event").orderBy(*order)) - 1
    return items(spark, sf_dir).filter(F.col("kind") == kind).withColumn("idx", rank)
