"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from binloom.llm.tables import stage
from binloom.llm.words import column, numbers

PART_LINKS = 500_000     # links that one task joins by itself


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every end of a link; the component is its smallest id.

    Links are dealt out in parts of bounded size, and a task joins its part's links to stars.  If there is more than one part,
    rounds on the stars follow, alternating two kinds: each node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows.  Minima combine before the exchange and rows are only ever joined to them, so a node with a
    third of all links is split like any other skewed join.  Each round is a written table; they end when one changes nothing.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    parts = -(-edges.count() // PART_LINKS)
    edges = stage(edges.repartition(max(1, parts)).mapInArrow(_stars, "u long, v long"), "edges")
    before = None
    while parts > 1:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.*").where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component")).distinct()


def _stars(batches):
    """A part's links as one star for each of its components, around the smallest node."""
    got = [np.stack([numbers(column(b, "u")), numbers(column(b, "v"))]) for b in batches]
    ends = np.concatenate(got, axis=1) if got else np.zeros((2, 0), np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:      # hand the smaller root to the larger one's node, then shorten all paths
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            break
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (root != root[root]).any():
            root = root[root]
    leaf = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], names=["u", "v"])
