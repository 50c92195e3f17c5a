"""Exact top-k search by tiled matrix products.

Queries travel to the workers in passes of bounded size; every pass reads all candidates.  Inside a task, a tile of queries
is multiplied with a shard of candidates, the best of the tile are selected, and they are merged into the task's list of
each query.  Lists of tasks are merged as a tree: groups of tasks first, then groups of groups.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from binloom.llm import tables
from binloom.llm.words import column, numbers

PASS_BYTES = 64 << 20     # queries in one broadcast
TILE = 1024               # queries of a tile
SHARD = 4096              # candidates of a tile
FAN_IN = 16               # lists merged at a time
SCALE = 1024
_EXACT = float(1 << 53)   # integers below are exact as doubles
_LONG = (1 << 63) - 1


def quantised(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, v``: each component as floor(scale * component), an integer kept as a double.

    Left out are null ids, and vectors that are null or hold a null or a value that is not finite.  A product of 2^53 and
    more has no fraction and stays as it is; one beyond the doubles is held at the largest.
    """
    most = F.lit(sys.float_info.max)

    def whole(c):
        wide = F.greatest(F.least(c.cast("double") * scale, most), -most)
        return F.when(F.abs(wide) < _EXACT, F.floor(wide).cast("double")).otherwise(wide)

    x = F.transform(F.col(f"`{vector}`"), whole)
    fine = F.forall(F.col(f"`{vector}`"), lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= most))
    own = rows.where(F.col(f"`{vec_id}`").isNotNull() & F.coalesce(fine, F.lit(False)))
    return own.select(F.col(f"`{vec_id}`").cast("long").alias("id"), x.alias("v"))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: exact, and held at the ends of the longs beyond them."""
    size = q.shape[1]
    large_q, large_c = np.abs(q).max(axis=1, initial=0), np.abs(c).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        largest = (large_q.max(initial=0) + 1) * (large_c.max(initial=0) + 1) * size
    if largest < _EXACT:
        return (q @ c.T).astype(np.int64)
    if largest < 2.0 ** 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    # vectors with large components meet the others in integers of any length; the rest fit
    fits = math.sqrt(2.0 ** 62 / size) - 1
    wide_q, wide_c = np.flatnonzero(large_q >= fits), np.flatnonzero(large_c >= fits)
    out = np.where(large_q[:, None] >= fits, 0, q).astype(np.int64) @ np.where(large_c[:, None] >= fits, 0, c).astype(np.int64).T
    out[wide_q] = _any_length(q[wide_q], c)
    out[:, wide_c] = _any_length(q, c[wide_c])
    return out


def _any_length(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    integers = [np.array([[int(x) for x in v] for v in m.tolist()], object) for m in (q, c)]
    return np.clip(integers[0] @ integers[1].T, -_LONG, _LONG).astype(np.int64)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """Of (query, id, score) rows, each query's k best: high scores first, then small ids."""
    order = np.lexsort([ids, -score, query])
    query, ids, score = query[order], ids[order], score[order]
    head = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
    ok = rank < k
    return query[ok], ids[ok], score[ok]


def _tile(q_ids, q, c_ids, c, k):
    """The best of one tile: scores at or above each query's k-th, cut to k with ties to smaller ids."""
    score = _products(q, c)
    score[q_ids[:, None] == c_ids[None, :]] = np.iinfo(np.int64).min
    if score.shape[1] > k:
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        keep = (score >= kth[:, None]) & (score > np.iinfo(np.int64).min)
    else:
        keep = score > np.iinfo(np.int64).min
    row, col = np.nonzero(keep)
    return _best(row, c_ids[col], score[row, col], k)


def _pass(candidates: DataFrame, queries: pa.Table, size: int, k: int) -> DataFrame:
    q_ids = queries["id"].to_numpy()
    q = np.array(queries["v"].combine_chunks().flatten(), float).reshape(len(q_ids), size)
    order = np.argsort(q_ids, kind="stable")
    shared = candidates.sparkSession.sparkContext.broadcast((q_ids[order], q[order]))

    def run(batches):
        ids, vectors = shared.value
        best = [(np.zeros(0, np.int64),) * 3 for _ in range(0, len(ids), TILE)]
        for batch in batches:
            flat = column(batch, "v")
            own = np.flatnonzero(np.diff(flat.offsets.to_numpy()) == size)
            batch = batch.take(pa.array(own))
            all_ids, all_v = numbers(column(batch, "id")), np.array(column(batch, "v").flatten(), float).reshape(len(own), size)
            for a in range(0, len(own), SHARD):
                c_ids, c = all_ids[a:a + SHARD], all_v[a:a + SHARD]
                for t, lo in enumerate(range(0, len(ids), TILE)):
                    got = _tile(ids[lo:lo + TILE], vectors[lo:lo + TILE], c_ids, c, k)
                    best[t] = _best(*(np.concatenate(x) for x in zip(best[t], got)), k)
        part = TaskContext.get().partitionId()
        for t, (row, vec, score) in enumerate(best):
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + t * TILE]), pa.array(vec), pa.array(score),
                                                  pa.array(np.full(len(row), part), pa.int32())], names=["query_id", "vec_id", "score", "part"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long, part int")


def _merge(lists: DataFrame, k: int, tasks: int) -> DataFrame:
    """Tree merging: no step sees more than ``FAN_IN`` lists of a query."""
    order = [F.desc("score"), F.asc("vec_id")]
    while tasks > 1:
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order)))
        lists = ranked.where(F.col("rank") <= k).drop("rank")
        tasks = -(-tasks // FAN_IN)
    return lists


def top_k(rows: DataFrame, *, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates with the highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates all rows with another id.  Ties go to smaller ids;
    fewer candidates give fewer rows.  An id that repeats is one query (its smallest vector) and as many candidates.
    Only vectors of equal length meet, empty ones with a score of 0; scores beyond the longs are held at their ends.  See :func:`quantised` for the vectors that take no part.
    """
    ready = quantised(rows, vec_id=vec_id, vector=vector, scale=scale)
    asked = ready.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    sizes = asked.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).collect()
    out = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, part int")
    parts = 1
    for n, count in sorted(map(tuple, sizes)):
        passes = max(1, -(-count * n * 8 // pass_bytes))
        for i in range(passes):
            queries = asked.where((F.size("v") == n) & (F.pmod(F.xxhash64("id"), F.lit(passes)) == i)).toArrow()
            if len(queries):
                found = _pass(ready, queries, n, k)
                parts = max(parts, found.rdd.getNumPartitions())
                out = out.union(found)
    merged = _merge(out, k, max(2, parts))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return merged.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(tables.read(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
