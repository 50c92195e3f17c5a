"""Derived columns: ordered aliases, scoped aliases, event weights, process assignment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from binloom.config import Alias, Sample

_NAMES = re.compile(r"'(?:[^']|'')*'|`[^`]*`|(?<![\w.])[A-Za-z_]\w*")


def as_column(expression) -> Column:
    """A SQL text, or a function that is given a resolver of names, as a Column."""
    if callable(expression):
        return expression(lambda name: F.col(f"`{name}`"))
    return F.expr(expression)


def names_in(expression) -> set[str]:
    """Words of a SQL expression that may be column names (text in quotes is not); of a function, the names it asks for."""
    if callable(expression):
        asked: set[str] = set()

        def resolve(name: str) -> Column:
            asked.add(name)
            return F.col(f"`{name}`")

        expression(resolve)
        return asked
    return {m for m in _NAMES.findall(expression) if not m.startswith(("'", "`"))}


def rename_in(expression, mapping: dict[str, str]):
    """The expression over other columns; a function is given a resolver that renames."""
    if callable(expression):
        return lambda resolve: expression(lambda name: resolve(mapping.get(name, name)))
    return _NAMES.sub(lambda m: mapping.get(m.group(), m.group()), expression)


def scoped(expression: Column, samples, sample_col: str = "sample") -> Column:
    if samples is None:
        return expression
    return F.when(F.col(sample_col).isin(*samples), expression)


def define(df: DataFrame, aliases: list[Alias], sample_col: str = "sample") -> DataFrame:
    """Add aliases in declaration order.  Redefining a column is an error unless it is itself."""
    for a in aliases:
        if a.name in df.columns:
            if not callable(a.expr) and a.expr.strip() == a.name:
                continue
            raise ValueError(f"column {a.name!r} is already defined")
        df = df.withColumn(a.name, scoped(as_column(a.expr), a.samples, sample_col))
    return df


def redefine(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """Overwrite an existing column."""
    if name not in df.columns:
        raise ValueError(f"column {name!r} is not there to overwrite")
    expression = F.expr(expression) if isinstance(expression, str) else expression
    return df.withColumn(name, expression)


def second_name(df: DataFrame, new: str, old: str) -> DataFrame:
    if new in df.columns:
        raise ValueError(f"column {new!r} is already defined")
    return df.withColumn(new, F.col(old))


def branches(df: DataFrame, tree: dict[str, str]) -> DataFrame:
    """Project named expressions."""
    return df.select(*[F.expr(e).alias(n) for n, e in tree.items()])


def weight_expr(sample: Sample, lumi: float, dataset_col: str = "dataset") -> str:
    """lumi * weight * dataset factor for simulation; no lumi for data."""
    parts = [f"({sample.weight})"]
    if not sample.is_data:
        parts.insert(0, f"{float(lumi)}D")
    if sample.dataset_weights:
        cases = " ".join(f"WHEN {_literal(k)} THEN ({e})" for k, e in sample.dataset_weights.items())
        parts.append(f"(CASE {dataset_col} {cases} ELSE 1D END)")
    return " * ".join(parts)


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def process_cases(samples: list[Sample]) -> list[tuple[str, str, Sample]]:
    """(final name, condition, parent) with sub-samples in place of their parent."""
    out = []
    for s in samples:
        if s.subsamples:
            out += [(f"{s.name}_{sub}", f"({s.where}) AND ({e})", s) for sub, e in s.subsamples.items()]
        else:
            out.append((s.name, s.where, s))
    names = [n for n, _, _ in out]
    if len(set(names)) != len(names):
        raise ValueError("two processes share a name")
    return out


def by_process(values: dict[str, str], default: str = "NULL", sample_col: str = "sample") -> str:
    """SQL for the expression of a row's process."""
    return f"CASE {sample_col} {' '.join(f'WHEN {_literal(s)} THEN ({e})' for s, e in values.items())} ELSE {default} END"


def assign_processes(df: DataFrame, samples: list[Sample], sample_col: str = "sample",
                     also: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per event and process it belongs to; overlapping processes are allowed.

    ``also`` names further conditions of a process, any of which makes an event its member.
    """
    also = also or {}
    hits = F.array(*[F.when(F.expr(" OR ".join(f"({c})" for c in [cond, *also.get(name, [])])), F.lit(name))
                     for name, cond, _ in process_cases(samples)])
    return df.withColumn(sample_col, F.explode(hits)).filter(F.col(sample_col).isNotNull())


def event_weight(df: DataFrame, samples: list[Sample], lumi: float, name: str = "weight",
                 sample_col: str = "sample", dataset_col: str = "dataset") -> DataFrame:
    return df.withColumn(name, F.expr(process_weight(samples, lumi, sample_col, dataset_col)))


def process_weight(samples: list[Sample], lumi: float, sample_col: str = "sample", dataset_col: str = "dataset") -> str:
    """SQL of the event weight of a row's process."""
    return by_process({final: f"CAST({weight_expr(s, lumi, dataset_col)} AS DOUBLE)" for final, _, s in process_cases(samples)},
                      sample_col=sample_col)
