"""Global order without a single task: running sums and exact top-n by ranges that grow in number with the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from binloom.session import stage

BUCKET_ROWS = 1 << 20      # distinct values, or rows, that one task orders


def running_sums(df: DataFrame, order: str, sums: dict[str, Column], descending: bool = False,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Running totals along ``order``, one row per distinct value of it.

    Equal values are added up first, so a value that a third of the rows share is one row.  The values are then dealt in ranges
    of about ``bucket_rows``, so their number grows with the values and the largest task does not; each range is summed on its
    own and starts from the total of those before it.  Columns: order, each sum ``s`` and its running total ``s_run``.
    """
    points = stage(df.groupBy(order).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "points")
    parts = max(1, math.ceil(points.count() / bucket_rows))
    direction = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    # which range a value came to is written down with it
    dealt = stage(points.repartitionByRange(parts, direction).withColumn("__b", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__b").agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy("__b").orderBy(direction).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(offsets, "__b").withColumns(
        {f"{n}_run": F.sum(n).over(inside) + F.col(f"__o_{n}") for n in sums})
    return out.drop("__b", *[f"__o_{n}" for n in sums])


def first_n_by_hash(df: DataFrame, key: str, n: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exactly ``n`` rows, those with the smallest md5 of ``key`` (a fixed random order).

    Counts by the next three digits of the hash (4,096 numbers each time) tell which prefixes are kept whole; the one at the limit is looked
    into again until it holds at most ``bucket_rows``, and only those are ranked.  Rows of one key longer than that are
    told apart by all they hold.
    """
    hashed = df.withColumn("__h", F.concat(F.md5(F.col(key).cast("string")), F.md5(F.to_json(F.struct(*df.columns)))))
    edge, seen, prefix = hashed, 0, ""
    while True:
        digits = len(prefix) + 3
        counts = edge.groupBy(F.substring("__h", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        for row in counts:
            if seen + row["n"] >= n:
                break
            seen += row["n"]
        else:
            return hashed.drop("__h")      # fewer rows than wanted
        prefix = row["p"]
        edge = hashed.filter(F.col("__h").startswith(prefix))
        if row["n"] <= bucket_rows or digits >= 63:
            break
    rank = F.row_number().over(Window.partitionBy(F.substring("__h", 1, len(prefix))).orderBy("__h"))
    last = edge.withColumn("__r", rank).filter(F.col("__r") <= n - seen).drop("__r")
    return hashed.filter(F.substring("__h", 1, len(prefix)) < prefix).unionByName(last).drop("__h")


def hash_percent(key: Column) -> Column:
    """0..99 from the md5 of the key: a stable random number for splits."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100
