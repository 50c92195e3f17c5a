"""Helper columns added step by step.

An expression used several times is computed once if it is a column of an earlier projection;
written out in place it would be repeated in the plan wherever it is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F


class Scratch:
    def __init__(self, df: DataFrame):
        self.df = df
        self._tag = uuid.uuid4().hex[:8]
        self._names: list[str] = []

    def put(self, cols: list[Column]) -> list[Column]:
        """One projection with the given columns; returns references to them."""
        names = [f"__{self._tag}_{len(self._names) + i}" for i in range(len(cols))]
        self._names += names
        self.df = self.df.withColumns(dict(zip(names, cols)))
        return [F.col(n) for n in names]

    def done(self, result: dict[str, Column]) -> DataFrame:
        """Add the results and drop every helper."""
        return self.df.withColumns(result).drop(*self._names)
