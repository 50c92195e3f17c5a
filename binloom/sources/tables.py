"""Readers: datasets, run metadata, whitespace tables, process unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# Columns of a scale-factor text table
SF_COLUMNS = ["eta_lo", "eta_hi", "pt_lo", "pt_hi", "eff_data", "stat_data", "syst_data",
              "eff_mc", "stat_mc", "syst_mc", "alt1", "alt2", "alt3", "alt4"]


def dataset(spark: SparkSession, directory: str, name: str, max_files: int | None = None) -> DataFrame:
    """All Parquet files of one dataset below a directory, or its first ``max_files`` by path."""
    pattern = f"{directory.rstrip('/')}/{name}*.parquet"
    if max_files is None:
        return spark.read.parquet(pattern)
    listed = spark.read.format("binaryFile").load(pattern).select("path").orderBy("path").limit(max_files).collect()
    if not listed:
        raise ValueError(f"no files match {pattern}")
    return spark.read.parquet(*[r["path"] for r in listed])


def process_union(parts: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Several datasets as one table; columns missing in one are NULL there."""
    tagged = [df.withColumns({"sample": F.lit(s), "dataset": F.lit(d)}) for (s, d), df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_rows(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Row cap in key order, so that it is the same rows every time."""
    return df.orderBy(*keys).limit(n)


def whitespace_table(spark: SparkSession, path: str, columns: list[str] | None = None,
                     header_word: str | None = None) -> DataFrame:
    """Whitespace-delimited numbers.  Columns are given, or read from the line with ``header_word``."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line != ''")
    lines = lines.filter(~F.col("line").startswith("#"))
    if columns is None:
        if header_word is None:
            raise ValueError("give columns or the word that marks the header")
        head = lines.filter(F.col("line").contains(header_word)).first()
        if head is None:
            raise ValueError(f"no header line with {header_word!r}")
        columns = head["line"].split()
        lines = lines.filter(~F.col("line").contains(header_word))
    cells = F.split("line", r"\s+")
    return lines.select(*[F.get(cells, F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])


def sumw(runs: DataFrame, weight: str, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.sum(weight).alias("sumw"), F.count(F.lit(1)).alias("n"))


def training_table(skims: dict[str, DataFrame], columns: list[str], signal: set[str]) -> DataFrame:
    """Skims of all processes as one labelled table: wanted columns that every skim has, in order."""
    available = [c for c in columns if all(c in df.columns for df in skims.values())]
    tagged = [df.select(*available, F.lit(name).alias("sample"),
                        F.lit(1 if name in signal else 0).alias("label")) for name, df in skims.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def label_processes(df: DataFrame, columns: list[str], labels: dict[str, int], sample_col: str = "sample") -> DataFrame:
    """The same from one table that already holds all processes: one pass, other processes dropped."""
    available = [c for c in columns if c in df.columns]
    literal = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.filter(F.col(sample_col).isin(*labels)).select(
        *available, F.col(sample_col).alias("sample"), literal[F.col(sample_col)].alias("label"))
