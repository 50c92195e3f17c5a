"""From flat objects to the bounded leading collections of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def rank_objects(objects: DataFrame, keys: list[str], order: list[str], k: int,
                 name: str = "idx") -> DataFrame:
    """The ``k`` leading objects of each group with their 0-based rank.

    ``order`` names columns; a leading ``-`` sorts falling.

    Spark turns ``row_number <= k`` into a group limit that runs before the shuffle, so a group
    holding a third of all rows sends at most ``k`` rows per input task.
    """
    window = Window.partitionBy(*keys).orderBy(
        *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])
    top = objects.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= k)
    return top.withColumn(name, F.col("__rn") - 1).drop("__rn")


def leading_collections(objects: DataFrame, key: str, kind: str, order: list[str],
                        fields: list[str], want: dict[str, tuple[str, int]]) -> DataFrame:
    """One row per ``key`` with one array of structs per kind, leading object first.

    ``want`` maps a kind to (array name, length limit).  All kinds share one scan; the arrays are
    bounded by their limits, so no group grows with the data.
    """
    limit = max(k for _, k in want.values())
    # with one kind the ranking's partitioning by key serves the grouping below as well
    keys = [key] if len(want) == 1 else [key, kind]
    top = rank_objects(objects.filter(F.col(kind).isin(*want)), keys, order, limit)
    obj = F.struct("idx", *fields)
    arrays = [
        F.sort_array(F.collect_list(
            F.when((F.col(kind) == value) & (F.col("idx") < k), obj))).alias(name)
        for value, (name, k) in want.items()
    ]
    return top.groupBy(key).agg(*arrays)


def varied_leaders(objects: DataFrame, key: str, value: str, factors: dict[str, tuple[Column, Column]], fields: list[str], order: list[str],
                   k: int) -> DataFrame:
    """The ``k`` leading objects of every event by each varied value: one row per event with a struct ``varied`` of one array per variation.

    ``factors`` maps a source to its up and down factors of ``value``; variations are ``nominal``, ``<source>up`` and ``<source>do``.  An
    object moves as one, with its ``fields`` (its nominal index among them, if asked for).  ``order`` breaks ties.

    Objects are not repeated for their variations: an event's objects stay together, and each of ``k`` rounds finds the next leader of
    every variation.  One exchange and one sort by ``key`` serve all rounds, and none is needed where the objects are dealt and sorted by
    it already; what an event holds beside its objects is ``k`` of them a variation.
    """
    sides = {"nominal": F.lit(1.0)} | {f"{s}{side}": c for s, pair in factors.items() for side, c in zip(("up", "do"), pair)}
    payload = [c for c in dict.fromkeys(fields) if c != value]
    columns = {f"__c{i}": c for i, c in enumerate(dict.fromkeys([*order, *payload]))}
    own = objects.select(key, (F.col(value) + F.lit(0)).alias("__v"), *[F.col(c).alias(n) for n, c in columns.items()],
                         *[c.alias(f"__f{i}") for i, c in enumerate(sides.values())], F.monotonically_increasing_id().alias("__id"))
    named = {c: n for n, c in columns.items()}
    # the least of these leads: falling value, not-a-number before all and null behind, then the order; the number tells equal objects apart
    made = {}
    for i in range(len(sides)):
        v = F.col("__v") * F.col(f"__f{i}")
        made[i] = F.struct(v.isNull().alias("none"), (~F.isnan(v)).alias("number"), (-v).alias("v"), *[named[c] for c in order], "__id",
                           *[named[c] for c in payload if c not in order])
    event, leaders = Window.partitionBy(key), {i: [] for i in made}
    for place in range(k):
        left = {i: F.when(c > F.col(leaders[i][-1]), c) if place else c for i, c in made.items()}
        for i in made:
            leaders[i].append(f"__l{i}_{place}")
        if place < k - 1:
            own = own.select("*", *[F.min(c).over(event).alias(leaders[i][-1]) for i, c in left.items()])
        else:
            own = own.groupBy(key).agg(*[F.first(n).alias(n) for i in made for n in leaders[i][:-1]], *[F.min(c).alias(leaders[i][-1]) for i, c in left.items()])

    def array(i):
        each = [F.when(F.col(n).isNotNull(), F.struct(F.lit(place).alias("place"), (-F.col(n)["v"]).alias(value), *[F.col(n)[named[c]].alias(c) for c in payload]))
                for place, n in enumerate(leaders[i])]
        return F.array_compact(F.array(*each))

    return own.select(key, F.struct(*[array(i).alias(n) for i, n in enumerate(sides)]).alias("varied"))


def varied_collections(objects: DataFrame, key: str, value: str, factors: dict[str, tuple[Column, Column]], fields: list[str], order: list[str],
                       k: int) -> DataFrame:
    """``varied_leaders`` with a row for every variation: (key, variation, array ``objects``)."""
    wide = varied_leaders(objects, key, value, factors, fields, order, k)
    names = wide.schema["varied"].dataType.names
    return wide.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("variation"), F.col("varied")[n].alias("objects")) for n in names])))
