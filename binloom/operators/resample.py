"""Weighted resampling with replacement along a tree of hash ranges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from binloom.session import stage

FAN = 6              # bits of the hash, hence 64 children, of each node
LEAF_ROWS = 2048     # rows a leaf is meant to hold


def bootstrap(df: DataFrame, key: str, weight: str, fraction: float = 0.7, seed: int = 6, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """How often each row was drawn (column ``copies``) in ``fraction`` x rows draws by weight; rows never drawn are left out.

    Rows are leaves of a tree over the ranges of their hash.  A node divides its draws over its children by their weights, with
    a generator seeded by the node alone, and weights are added up in the order of the hashes.  So the result is one
    multinomial draw, and the same one for any number of partitions, any order of rows and any size of batches.  The tree is as deep
    as the rows ask for, so no task holds more than about ``leaf_rows`` rows or 64 children at once.  Equal rows come as one, with the draws
    of all of them.
    """
    spark, names = df.sparkSession, df.columns
    total = df.count()
    levels = max(0, math.ceil(math.log(max(1.0, total / leaf_rows), 1 << FAN)))
    same = df.where(F.col(weight) > 0).groupBy(*names).agg(F.count(F.lit(1)).alias("__m"))
    code = F.xxhash64(key, *[c for c in names if c != key])
    leaf = F.shiftrightunsigned("__code", 64 - FAN * levels) if levels else F.lit(0).cast("long")
    rows = same.withColumn("__code", code).withColumn("__node", leaf).withColumn("__w", F.col(weight).cast("double") * F.col("__m"))
    rows = stage(rows.drop("__m"), "resample")

    def ordered_sum(pairs):
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x["w"])

    sums = rows.groupBy("__node").agg(F.sort_array(F.collect_list(F.struct("__code", F.col("__w").alias("w")))).alias("kids"))
    sums = stage(sums.select(F.col("__node").alias("node"), ordered_sum("kids").alias("w")), "resample")
    tree = []      # from the leaves up: node with its children
    for _ in range(levels):
        up = sums.groupBy(F.shiftrightunsigned("node", FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "w"))).alias("kids"))
        sums = up.select(F.col("up").alias("node"), ordered_sum("kids").alias("w"))
        tree.append(up.withColumnRenamed("up", "node"))

    def split(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for node, draws, kids in zip(pdf["node"].tolist(), pdf["draws"].tolist(), pdf["kids"]):
                    w = np.array([k["w"] for k in kids])
                    got = np.random.default_rng([seed, level, node]).multinomial(draws, w / w.sum())
                    out += [(k["node"], g) for k, g in zip(kids, got.tolist()) if g]
                yield pd.DataFrame(out, columns=["node", "draws"])
        return run

    given = spark.createDataFrame([(0, int(fraction * total))], "node long, draws long")
    for level, up in enumerate(reversed(tree)):
        given = stage(up.join(given, "node").mapInPandas(split(level), "node long, draws long"), "resample")

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("__code")
        w = table["__w"].to_numpy()
        node, draws = table["__node"][0].as_py(), table["draws"][0].as_py()
        copies = np.random.default_rng([seed, levels, node]).multinomial(draws, w / w.sum())
        out = table.select(names).append_column("copies", pa.array(copies, pa.int64()))
        return out.filter(pa.array(copies > 0))

    schema = df.withColumn("copies", F.lit(0).cast("long")).schema
    return rows.join(given.withColumnRenamed("node", "__node"), "__node").groupBy("__node").applyInArrow(draw, schema)
