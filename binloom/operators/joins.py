"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from binloom.functions.kinematics import delta_r2

SHARE = 0.001            # a key is heavy from one thousandth of the rows
SAMPLE = 0.01            # share of rows read to plan for heavy keys; results never depend on it
MIN_ROWS = 1_000_000     # below this many rows one task copes with any key
SPREAD = 64              # pieces a heavy key is cut into


def heavy_keys(df: DataFrame, key: str, share: float = SHARE, sample: float = SAMPLE,
               min_rows: int = MIN_ROWS) -> list:
    """Keys holding at least ``share`` of the rows, judged on a sample of the key column.

    At most ``1 / share`` keys can qualify, which bounds what reaches the driver.
    """
    keys = df.select(key).filter(F.col(key).isNotNull())
    if sample < 1.0:
        keys = keys.sample(fraction=sample, seed=7)
    counts = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    big = counts.filter(F.col("n") >= sample * min_rows).orderBy(F.desc("n")).limit(int(1 / share)).collect()
    if not big:
        return []
    total = keys.count()
    return [row[key] for row in big if row["n"] >= share * total]


def skew_safe_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner",
                   heavy: list | None = None, spread: int = SPREAD) -> DataFrame:
    """``many`` joined with ``one`` (unique per key) on ``key``, heavy keys salted.

    Rows of a heavy key are spread over ``spread`` salts and its single partner row is repeated
    once per salt.  Without heavy keys this is the plain join.  ``how``: inner, left,
    left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} cannot be salted on its right side")
    heavy = heavy_keys(many, key) if heavy is None else heavy
    if not heavy:
        return many.join(one, key, how)
    hot = F.col(key).isin(*heavy)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in many.columns if c != key]), F.lit(spread)).cast("int")
    left = many.withColumn("__salt", F.when(hot, salt).otherwise(F.lit(0)))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    right = one.withColumn("__salt", F.explode(salts))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def friend_join(df: DataFrame, friend: DataFrame, keys: list[str]) -> DataFrame:
    """Add a friend's columns by key, 1:1; clashing column names are an error."""
    clash = (set(df.columns) & set(friend.columns)) - set(keys)
    if clash:
        raise ValueError(f"friend repeats columns {sorted(clash)}")
    return df.join(friend, keys, "left")


def cell_join(objects: DataFrame, others: DataFrame, key: str, cone: float, how: str = "inner", cut2: float | None = None) -> DataFrame:
    """Objects with the others of their event that are nearer than ``cone`` in (eta, phi); both tables are flat.

    Cells are part of the join key, with each of ``others`` in those that its cone touches, so an event with very many
    objects is spread over its cells and only near pairs are compared.  The
    others' columns get the prefix ``o_``, with ``o_dr2`` for the squared distance.  ``cut2`` is the squared cone, if not its plain square.
    ``how``: inner, left or left_anti.
    """
    cut2 = cone * cone if cut2 is None else cut2
    # cells twice as wide as the cone: those that an object's cone touches are two on each axis at most
    around, reach = max(1, int(math.pi / cone)), cone * (1 + 1e-9)
    ring = lambda eta: F.floor(eta / (2 * cone))
    turn = lambda phi: F.floor((phi / (2 * math.pi) + 0.5) * around)
    mine = objects.withColumns({"__ce": ring(F.col("eta")), "__cp": F.pmod(turn(F.col("phi")), F.lit(around))})
    rings = F.sequence(ring(F.col("eta") - reach), ring(F.col("eta") + reach))
    turns = F.array_distinct(F.transform(F.sequence(turn(F.col("phi") - reach), turn(F.col("phi") + reach)), lambda p: F.pmod(p, F.lit(around))))
    theirs = others.select(F.col(key).alias("__key"), *[F.col(c).alias(f"o_{c}") for c in others.columns if c != key],
                           F.explode(rings).alias("__e"), turns.alias("__p")).withColumn("__p", F.explode("__p"))
    dr2 = delta_r2(F.col("o_eta"), F.col("o_phi"), F.col("eta"), F.col("phi"))
    near = ((F.col(key) == F.col("__key")) & (F.col("__ce") == F.col("__e")) & (F.col("__cp") == F.col("__p")) & (dr2 < cut2))
    out = mine.join(theirs, near, how)
    if how != "left_anti":
        out = out.withColumn("o_dr2", dr2)
    return out.drop("__ce", "__cp", "__key", "__e", "__p")


def clean_objects(objects: DataFrame, others: DataFrame, key: str, cone: float, cut2: float | None = None) -> DataFrame:
    """Objects with no other object of their event within ``cone`` in (eta, phi)."""
    return cell_join(objects, others.select(key, "eta", "phi"), key, cone, "left_anti", cut2)
