"""Yield, process and nuisance tables (the content of statistical-model cards, as rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def process_ids(structure: DataFrame, order: str) -> DataFrame:
    """Signals are 0, -1, -2, ...; backgrounds 1, 2, ...; data have no number.

    ``structure`` is configuration: one row per process, with is_signal (0 none, 1 always present,
    2 one alternative per card) and is_data.
    """
    kind = F.when(F.col("is_signal") != 0, "signal").when(F.col("is_data") == 0, "background")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(order))
    number = F.when(F.col("kind") == "signal", 1 - F.col("rank")).otherwise(F.col("rank"))
    return (structure.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("rank", rank)
            .withColumn("process_id", number).drop("rank"))


def card_processes(structure: DataFrame, order: str, name: str = "sample") -> DataFrame:
    """Processes and numbers of every card: one card per alternative signal, and one without any, named ''.

    Each card has its alternative signal, the signals always present and all backgrounds, with the numbers of :func:`process_ids`.
    ``position`` is the place in the card: its own signal first, then the others, then backgrounds, each in falling and rising number.
    """
    ids = process_ids(structure, order)
    alternative = F.col("is_signal") == 2
    ids = ids.withColumn("__all", F.collect_set(F.when(alternative, F.col(name))).over(Window.partitionBy()))
    where = F.when(alternative, F.array(F.col(name))).otherwise(F.concat(F.array(F.lit("")), "__all"))
    each = ids.withColumn("card", F.explode(where)).drop("__all")
    place = Window.partitionBy("card").orderBy(F.when(F.col("is_signal") == 2, 0).when(F.col("kind") == "signal", 1).otherwise(2),
                                               F.abs("process_id"))
    return each.withColumn("position", F.row_number().over(place) - 1)


def remove_from_cuts(yields: DataFrame, removed: dict[str, list[str]]) -> DataFrame:
    """Drop (sample, cut) combinations a process is excluded from."""
    bad = F.lit(False)
    for sample, cuts in removed.items():
        bad = bad | ((F.col("sample") == sample) & F.col("cut").isin(*cuts))
    return yields.filter(~bad)


def scale_yields(yields: DataFrame, scales: dict[str, float | dict[str, float]], column: str = "yield") -> DataFrame:
    """A factor per process, or per process and selection; 1 where none is given."""
    factor = F.lit(1.0)
    for sample, value in scales.items():
        mine = F.col("sample") == sample
        if isinstance(value, dict):
            for cut, v in value.items():
                factor = F.when(mine & (F.col("cut") == cut), F.lit(float(v))).otherwise(factor)
        else:
            factor = F.when(mine, F.lit(float(value))).otherwise(factor)
    return yields.withColumn(column, F.col(column) * factor)


def rate_table(yields: DataFrame, processes: list[str], data: str) -> DataFrame:
    """Per selection and variable the observation and every process' rate, to four decimals."""
    wide = yields.filter("variation = 'nominal'").groupBy("cut", "variable").pivot("sample", [data, *processes]).agg(F.sum("yield"))
    return wide.select("cut", "variable", F.round(F.coalesce(F.col(data), F.lit(0.0)), 4).alias("observation"),
                       *[F.round(F.coalesce(F.col(p), F.lit(0.0)), 4).alias(p) for p in processes])


def nuisance_matrix(yields: DataFrame, flat: dict[str, dict[str, str]], shapes: dict[str, list[str]],
                    processes: list[str], cuts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per (cut, variable, nuisance), one column per process.

    Flat nuisances show their factor, shape ones "1.000", anything else "-".
    """
    cuts = cuts or {}
    entries = []
    for name, kind, content in [*[(n, "lnN", c) for n, c in flat.items()], *[(n, "shape", dict.fromkeys(c, "1.000")) for n, c in shapes.items()]]:
        cells = [F.lit(content.get(p, "-")).alias(p) for p in processes]
        row = F.struct(F.lit(name).alias("nuisance"), F.lit(kind).alias("type"), *cells)
        entries.append(F.when(F.col("cut").isin(*cuts[name]), row) if name in cuts else row)
    frames = yields.select("cut", "variable").distinct()
    rows = frames.withColumn("__r", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())))
    return rows.select("cut", "variable", "__r.*")


def nuisance_groups(membership: DataFrame) -> DataFrame:
    """Sorted members of each group; configuration-sized."""
    return membership.groupBy("grp").agg(F.sort_array(F.collect_set("nuisance")).alias("members"))


def goodness_table(results: DataFrame, variables: list[str], limit: float = 0.05) -> DataFrame:
    """p-value per final state and variable from names ``GoF_<state>_<variable>``.

    The longest variable that ends the name wins.
    """
    base = F.regexp_replace(F.regexp_replace("name", "^GoF_", ""), r"\.json$", "")
    var = F.lit(None).cast("string")
    for v in sorted(variables, key=len):
        var = F.when(base.endswith(f"_{v}"), F.lit(v)).otherwise(var)
    out = results.withColumns({"__base": base, "variable": var}).filter("variable IS NOT NULL AND p IS NOT NULL")
    state = F.substr("__base", F.lit(1), F.length("__base") - F.length("variable") - 1)
    return out.select(state.alias("state"), "variable", "p", (F.col("p") < limit).alias("bad"))


def toy_summary(toys: DataFrame, observed: DataFrame, value: str, by: str) -> DataFrame:
    """Per group the mean observed statistic and the share of toys at or above it.

    ``observed`` is reduced to one row per group, which is repeated once for each of the parts that the toys are dealt into;
    so a few groups do not mean a few tasks.
    """
    parts = int(toys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = observed.groupBy(by).agg(F.avg(value).alias("observed"))
    seen = seen.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = toys.withColumn("__part", F.pmod(F.xxhash64(*toys.columns), F.lit(parts)).cast("int"))
    return dealt.join(seen, [by, "__part"]).groupBy(by, "observed").agg(
        F.count(F.lit(1)).alias("toys"), F.avg(F.when(F.col(value) >= F.col("observed"), 1.0).otherwise(0.0)).alias("p"))
