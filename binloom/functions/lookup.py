"""Binned maps and curves as Column expressions.

A map lives in the plan as a literal array indexed by bin number, so a look-up costs no join and
works inside array lambdas.  Maps above ``LITERAL_CELLS`` cells are joined on the bin numbers
instead (``attach``), as a plain join whose strategy Spark chooses from the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from binloom.config import Edges
from binloom.functions.bins import bin_index
from binloom.functions.literals import choose
from binloom.operators.scratch import Scratch

LITERAL_CELLS = 10_000


@dataclass(frozen=True)
class BinnedMap:
    """2-D map ``values[iy][ix]`` with errors, on explicit edges."""

    x_edges: tuple[float, ...]
    y_edges: tuple[float, ...]
    values: tuple[tuple[float, ...], ...]
    errors: tuple[tuple[float, ...], ...] | None = None

    def __post_init__(self):
        nx, ny = len(self.x_edges) - 1, len(self.y_edges) - 1
        for grid in (self.values, self.errors):
            if grid is not None and (len(grid) != ny or any(len(r) != nx for r in grid)):
                raise ValueError("map content does not match its edges")

    @property
    def cells(self) -> int:
        return (len(self.x_edges) - 1) * (len(self.y_edges) - 1)

    def last_centre_x(self) -> float:
        return 0.5 * (self.x_edges[-1] + self.x_edges[-2])

    def bins(self, x: Column, y: Column) -> tuple[Column, Column]:
        return bin_index(x, Edges(self.x_edges)), bin_index(y, Edges(self.y_edges))

    def at_bins(self, ix: Column, iy: Column, what: str = "value") -> Column:
        """Content or error at given bin numbers; zero outside, as in an unfilled outer cell."""
        grid = self.values if what == "value" else self.errors
        if grid is None:
            return F.lit(0.0)
        if self.cells > LITERAL_CELLS:
            raise ValueError("map too large for a literal; use attach()")
        nx, ny = len(self.x_edges) - 1, len(self.y_edges) - 1
        inside = ix.between(1, nx) & iy.between(1, ny)
        cell = choose((iy - 1) * nx + ix - 1, [float(v) for row in grid for v in row])
        return F.when(inside, cell).otherwise(F.lit(0.0))

    def value(self, x: Column, y: Column) -> Column:
        return self.at_bins(*self.bins(x, y))

    def error(self, x: Column, y: Column) -> Column:
        return self.at_bins(*self.bins(x, y), "error")

    def rows(self) -> list[tuple]:
        out = []
        for iy, row in enumerate(self.values):
            for ix, value in enumerate(row):
                err = self.errors[iy][ix] if self.errors is not None else 0.0
                out.append((ix + 1, iy + 1, float(self.x_edges[ix]), float(self.x_edges[ix + 1]),
                            float(self.y_edges[iy]), float(self.y_edges[iy + 1]),
                            float(value), float(err)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.rows(),
            "ix int, iy int, x_lo double, x_hi double, y_lo double, y_hi double, value double, error double",
        )

    def attach(self, df: DataFrame, x: Column, y: Column, value: str, error: str) -> DataFrame:
        """Map content as two new columns, whatever the size of the map."""
        if self.cells <= LITERAL_CELLS:
            return df.withColumns({value: self.value(x, y), error: self.error(x, y)})
        ix, iy = self.bins(x, y)
        dim = self.table(df.sparkSession).select(
            F.col("ix").alias("__ix"), F.col("iy").alias("__iy"),
            F.col("value").alias(value), F.col("error").alias(error))
        joined = df.withColumns({"__ix": ix, "__iy": iy}).join(dim, ["__ix", "__iy"], "left")
        return joined.fillna(0.0, [value, error]).drop("__ix", "__iy")


@dataclass(frozen=True)
class MapSet:
    """Several maps on the same edges read together: one bin search, one element of a literal array of structs."""

    maps: dict[str, BinnedMap]

    def __post_init__(self):
        edges = {(m.x_edges, m.y_edges) for m in self.maps.values()}
        if len(edges) != 1:
            raise ValueError("maps of a set share their edges")
        if sum(2 * m.cells for m in self.maps.values()) > LITERAL_CELLS:
            raise ValueError("maps too large for a literal; attach them one by one")

    def at_bins(self, ix: Column, iy: Column) -> Column:
        """Struct with ``<name>`` and ``<name>_error`` of every map; NULL outside."""
        some = next(iter(self.maps.values()))
        nx, ny = len(some.x_edges) - 1, len(some.y_edges) - 1
        cells = []
        for y in range(ny):
            for x in range(nx):
                pairs = ((n, m.values[y][x], m.errors[y][x] if m.errors is not None else 0.0) for n, m in self.maps.items())
                cells.append("named_struct(" + ", ".join(f"'{n}', {float(v)!r}D, '{n}_error', {float(e)!r}D" for n, v, e in pairs) + ")")
        return F.when(ix.between(1, nx) & iy.between(1, ny), F.get(F.expr(f"array({', '.join(cells)})"), (iy - 1) * nx + ix - 1))


@dataclass(frozen=True)
class ShapeTable:
    """Factors on the axes (|eta|, pt, score) for several sources and flavours.

    ``cells[source, flavour]`` holds for every cell, with the score running fastest and |eta| slowest, the coefficients of a polynomial in
    the score, the constant first.  Values beyond an axis take its outermost bin.
    """

    eta_edges: tuple[float, ...]
    pt_edges: tuple[float, ...]
    score_edges: tuple[float, ...]
    cells: dict[tuple[str, int], tuple[tuple[float, ...], ...]]

    def __post_init__(self):
        n = (len(self.eta_edges) - 1) * (len(self.pt_edges) - 1) * (len(self.score_edges) - 1)
        if any(len(c) != n for c in self.cells.values()):
            raise ValueError("table content does not match its edges")

    @property
    def sources(self) -> list[str]:
        return list(dict.fromkeys(s for s, _ in self.cells))

    @property
    def degree(self) -> int:
        return max(len(c) for own in self.cells.values() for c in own) - 1

    def cell(self, eta: Column, pt: Column, score: Column) -> Column:
        """Number of the cell, from one bin search on each axis, whatever the number of sources."""
        out = F.lit(0)
        for x, edges in ((F.abs(eta), self.eta_edges), (pt, self.pt_edges), (score, self.score_edges)):
            n = len(edges) - 1
            out = out * n + F.least(F.greatest(bin_index(x, Edges(edges)), F.lit(1)), F.lit(n)) - 1
        return F.when(eta.isNotNull() & pt.isNotNull() & score.isNotNull(), out)

    def rows(self) -> list[tuple]:
        """(flavour, cell, coefficients of every source); a source without the flavour has none."""
        flavours = list(dict.fromkeys(f for _, f in self.cells))
        n = len(next(iter(self.cells.values())))
        pad = lambda c: [float(v) for v in c] + [0.0] * (self.degree + 1 - len(c))
        return [(f, i, *[pad(self.cells[s, f][i]) if (s, f) in self.cells else None for s in self.sources])
                for f in flavours for i in range(n)]

    def attach(self, df: DataFrame, flavour: Column, eta: Column, pt: Column, score: Column) -> DataFrame:
        """``df`` with a column per source: the factor, NULL where the table has no such flavour or the object no such value.

        The table is a literal in the plan; above ``LITERAL_CELLS`` numbers it is joined on flavour and cell instead.
        """
        rows, where = self.rows(), self.cell(eta, pt, score)
        if len(rows) * len(self.sources) * (self.degree + 1) <= LITERAL_CELLS:
            s = Scratch(df)
            at, = s.put([where])
            by: dict[int, list[str]] = {}
            for f, _, *own in rows:
                by.setdefault(f, []).append("named_struct(" + ", ".join(
                    f"'c{i}', " + ("array(" + ", ".join(f"{v!r}D" for v in c) + ")" if c is not None else "cast(NULL AS array<double>)")
                    for i, c in enumerate(own)) + ")")
            picked = F.lit(None)
            for f, structs in by.items():
                picked = F.when(F.abs(flavour) == f, F.get(F.expr(f"array({', '.join(structs)})"), at)).otherwise(picked)
            found, = s.put([picked])
            return s.done({n: self._polynomial(found[f"c{i}"], score) for i, n in enumerate(self.sources)})
        kinds = ", ".join(f"c{i} array<double>" for i in range(len(self.sources)))
        dim = df.sparkSession.createDataFrame(rows, f"__flavour int, __cell int, {kinds}")
        joined = df.withColumns({"__flavour": F.abs(flavour).cast("int"), "__cell": where, "__score": score}).join(dim, ["__flavour", "__cell"], "left")
        return joined.select(*df.columns, *[self._polynomial(F.col(f"c{i}"), F.col("__score")).alias(n) for i, n in enumerate(self.sources)])

    def _polynomial(self, coefficients: Column, x: Column) -> Column:
        out = F.get(coefficients, F.lit(self.degree))
        for i in range(self.degree - 1, -1, -1):
            out = out * x + F.get(coefficients, F.lit(i))
        return out


def map_from_rows(rows, x_edges, y_edges, value="value", error="error") -> BinnedMap:
    """Build a map from a *measured* table: at most one row per cell of the given edges.

    The row count is bounded by the edges, and checked, before anything reaches the driver.
    """
    nx, ny = len(x_edges) - 1, len(y_edges) - 1
    got = rows.filter(F.col("ix").between(1, nx) & F.col("iy").between(1, ny)) \
              .select("ix", "iy", value, error).limit(nx * ny + 1).collect()
    if len(got) > nx * ny:
        raise ValueError("more rows than map cells: the table is not one row per cell")
    v = [[0.0] * nx for _ in range(ny)]
    e = [[0.0] * nx for _ in range(ny)]
    for r in got:
        v[r["iy"] - 1][r["ix"] - 1] = float(r[value] or 0.0)
        e[r["iy"] - 1][r["ix"] - 1] = float(r[error] or 0.0)
    return BinnedMap(tuple(x_edges), tuple(y_edges), tuple(map(tuple, v)), tuple(map(tuple, e)))


@dataclass(frozen=True)
class Curve:
    """Points ``(x, y)`` interpolated linearly; ``clamp`` holds the end values outside."""

    xs: tuple[float, ...]
    ys: tuple[float, ...]

    def __post_init__(self):
        if len(self.xs) != len(self.ys) or list(self.xs) != sorted(set(self.xs)):
            raise ValueError("curve needs equally many x and y, x ascending")

    def at(self, x: Column, clamp: bool = True, outside: float = 0.0) -> Column:
        if clamp:
            # greatest and least pass over NULL, which must stay NULL
            x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(self.xs[0]))), F.lit(float(self.xs[-1]))))
        out = F.when((x < self.xs[0]) | (x > self.xs[-1]) | x.isNull(), F.lit(float(outside)))
        for x0, x1, y0, y1 in zip(self.xs, self.xs[1:], self.ys, self.ys[1:]):
            slope = (y1 - y0) / (x1 - x0)
            out = out.when(x <= x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit(slope))
        return out
