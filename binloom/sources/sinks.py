"""Writers: partitioned skims, histogram stores, CSV and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from binloom.config import Cut


def skim(df: DataFrame, cuts: list[Cut], branches: dict[str, str], weight: str = "weight") -> DataFrame:
    """One row per event and selection passed, with the chosen branches and always the weight."""
    flat = [c for cut in cuts for c in cut.flat()]
    passed = F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in flat])
    keep = {n: e for n, e in branches.items() if n not in ("weight", "sample", "cut")}
    return df.select("sample", F.expr(weight).alias("weight"),
                     *[F.expr(e).alias(n) for n, e in keep.items()],
                     F.explode(passed).alias("cut")).filter("cut IS NOT NULL")


def write_skim(df: DataFrame, path: str, cuts: list[Cut], branches: dict[str, str]) -> None:
    skim(df, cuts, branches).write.mode("overwrite").partitionBy("cut", "sample").parquet(path)


def write_histograms(hist: DataFrame, path: str) -> None:
    """Histogram store: partitioned by selection and variable."""
    hist.write.mode("overwrite").partitionBy("cut", "variable").parquet(path)


def append_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("append").option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
