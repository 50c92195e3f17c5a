"""Tables of the operators: columns they work on, and results kept in the shared folder."""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from binloom.session import fresh_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once to the folder all executors share and read it back: lineage ends here."""
    path = fresh_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_results(df: DataFrame, results: list[tuple[str, str]]) -> tuple[DataFrame, T.StructType]:
    """The table without columns that bear a result's name, whatever their case, and its schema with the results at the end."""
    taken = {name.lower() for name, _ in results}
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    fields = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in results]
    return plain, T.StructType([*plain.schema.fields, *fields])


def names_apart(operator):
    """An operator on ``docs`` in which columns of the user's that begin with two underscores have other names meanwhile.

    They pass through under their own names; one that bears a result's name gives way to the result.
    """
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (name for name in map("user_{}".format, itertools.count()) if name not in taken)
        other = {c: next(free) for c in docs.columns if c.startswith("__")}
        if not other:
            return operator(docs, *args, **options)
        named = {k: other.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        out = operator(docs.toDF(*[other.get(c, c) for c in docs.columns]), *args, **named)
        results = {c.lower() for c in out.columns}
        back = {mine: c for c, mine in other.items()}
        return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns if back.get(c, "").lower() not in results])

    return run


def fold(doc_id: str, modulus: int) -> Column:
    """Remainder of the CRC of an id; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def text_key(text: str) -> list[Column]:
    """128 bits that name a text: equal texts, null ones too, share them."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(value, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), value, F.lit(3)).alias("k2")]


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BLOOM_WORDS = 1 << 19     # 64-bit words: 4 MB
_SHIFTS = (20, 26, 32, 38)


def bloom(hashes: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size over 64-bit hashes, to thin rows before a shuffle; only speed depends on it.

    Each of its words is made where its hashes are, so the driver gets at most ``BLOOM_WORDS`` numbers.
    """
    bits = " | ".join(f"shiftleft(1L, cast(shiftright({column}, {s}) & 63 as int))" for s in _SHIFTS)
    found = (hashes.select((F.col(column).bitwiseAND(F.lit(BLOOM_WORDS - 1))).alias("w"), F.expr(bits).alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(BLOOM_WORDS, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out


def maybe(hashes: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Whether hashes may be in the filter; never False for one that is."""
    h = hashes.astype(np.int64)
    want = np.zeros(len(h), np.int64)
    for s in _SHIFTS:
        want |= np.int64(1) << ((h >> np.int64(s)) & np.int64(63))
    return (filled[h & np.int64(BLOOM_WORDS - 1)] & want) == want
