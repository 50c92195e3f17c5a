"""Packing into batches with optimal length buckets.

The global histogram of lengths is small: lengths that differ by one need a token more each, so N tokens have at most
sqrt(2 N) lengths.  A dynamic program over it finds the bucket bounds with the least padding.  Documents of a bucket are then
numbered, shard by shard with the counts of the shards before, and cut into batches whose padded size fits the budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from binloom.llm import tables
from binloom.llm.encode import lengths
from binloom.llm.tables import stage
from binloom.llm.words import column, slices

BUCKETS = 16
BUDGET = 65_536     # tokens of a batch, padding included


def bounds(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding; ties to the smallest last-but-one bounds.

    ``best[k][j]`` is the least padded total of the first j lengths in k buckets: the minimum over i of
    ``best[k - 1][i] + length[j] * (rows in i .. j)``.  For growing j these are straight lines in length[j], and only the
    lower hull of them can hold the minimum, so a step of the program costs as many operations as there are lengths.
    """
    order = np.argsort(length)
    length, rows = np.asarray(length)[order].tolist(), np.concatenate([[0], np.cumsum(np.asarray(count)[order])]).tolist()
    n = len(length)
    best, back = [0] + [None] * n, []
    for _ in range(min(buckets, n)):
        new, step = [0] + [None] * n, [0] * (n + 1)
        hull, at = [], 0      # (slope, height, i): slopes fall
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-rows[j - 1], best[j - 1], j - 1)
                while len(hull) > 1 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            x = length[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            new[j], step[j] = hull[at][0] * x + hull[at][1] + x * rows[j], hull[at][2]
        best = new
        back.append(step)
    out, j = [], n
    for step in reversed(back):
        if j:
            out.append(length[j - 1])
            j = step[j]
    return sorted(out)


def _hidden(a, b, c) -> bool:
    """Whether the middle one of three lines is nowhere below both others."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(rows: DataFrame, length: str, key: list[Column], *, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``rows`` with ``bucket`` (from 0), ``padded_length`` (the bucket's bound), ``batch`` (from 0 in each bucket) and
    ``slot`` (place in the batch).

    A batch holds as many rows as the budget has room for at the bucket's bound, one at least: a text longer than the budget
    is a batch of its own.  Lengths must not be null.  ``key`` orders the rows; rows equal in it and in length may swap.
    """
    spark = rows.sparkSession
    seen = rows.groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n")).toArrow()
    ends = bounds(seen["length"].to_numpy(), seen["n"].to_numpy(), buckets) if len(seen) else [0]
    number, bound = F.lit(len(ends) - 1), F.lit(ends[-1])
    for i in range(len(ends) - 2, -1, -1):
        number, bound = F.when(F.col(length) <= ends[i], i).otherwise(number), F.when(F.col(length) <= ends[i], F.lit(ends[i])).otherwise(bound)
    shard = F.pmod(F.xxhash64(*key), F.lit(4 * tables.parts(spark))).cast("int")
    dealt = rows.withColumns({"bucket": number.cast("int"), "padded_length": bound.cast("long"), "__shard": shard})
    sizes = dealt.groupBy("bucket", "__shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("bucket", "__shard", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("bucket", "__shard").orderBy(*key, length))
    placed = dealt.withColumn("__in", inside).join(sizes, ["bucket", "__shard"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_length")))
    rank = F.col("__before") + F.col("__in") - 1
    placed = placed.withColumns({"batch": F.floor(rank / room).cast("long"), "slot": (rank % room).cast("long")})
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], "bucket", "padded_length", "batch", "slot")


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", by_word: bool = True,
                   buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``doc_id, n_tokens, bucket, padded_length, batch, slot`` of every row, with one end token counted for each.

    Null and empty texts have the end token only; null ids and repeated rows are packed like others; an empty table gives an
    empty one.
    """
    def run(batches):
        for batch in slices(batches, "text"):
            n = lengths(column(batch, "text"), tokenizer, by_word) + 1
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    measured = stage(own.mapInArrow(run, "doc_id long, n_tokens long"), "lengths")
    return pack(measured, "n_tokens", [F.col("doc_id")], buckets=buckets, budget=budget)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(tables.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
