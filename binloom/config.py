"""Analysis configuration: plain declarations, compiled to DataFrame plans by ``operators``.

Expressions are Spark SQL strings; that of an alias may be a function.  A two-dimensional variable gives two expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass(frozen=True)
class Uniform:
    """``n`` equal bins on ``[lo, hi)``; bin 0 is underflow, ``n + 1`` overflow."""

    n: int
    lo: float
    hi: float

    @property
    def size(self) -> int:
        return self.n

    def edges(self) -> list[float]:
        step = (self.hi - self.lo) / self.n
        return [self.lo + i * step for i in range(self.n + 1)]


@dataclass(frozen=True)
class Edges:
    """Bins between explicit ascending edges."""

    values: tuple[float, ...]

    def __init__(self, values):
        object.__setattr__(self, "values", tuple(float(v) for v in values))
        if list(self.values) != sorted(set(self.values)) or len(self.values) < 2:
            raise ValueError("edges must ascend strictly and hold at least two values")

    @property
    def size(self) -> int:
        return len(self.values) - 1

    def edges(self) -> list[float]:
        return list(self.values)


Axis = Uniform | Edges


@dataclass(frozen=True)
class Sample:
    """A process: rows for which ``where`` holds.

    ``dataset_weights`` multiplies the weight where a dataset needs an extra factor (keyed by the
    value of the dataset column).  ``subsamples`` replaces the process by named filtered copies.
    """

    name: str
    where: str = "true"
    weight: str = "1D"
    is_data: bool = False
    dataset_weights: dict = field(default_factory=dict)
    subsamples: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Alias:
    """A derived column, for all processes or only those in ``samples`` (NULL elsewhere).

    ``expr`` is SQL, or a function of a resolver that turns names into columns and gives a Column:
    ``lambda c: transverse_mass(c("pt"), c("phi"), c("met"), c("met_phi"))``.  The names it asks for are its inputs, so
    variations reach it as they reach SQL.  It must ask for the same names each time.
    """

    name: str
    expr: str | Callable[[Callable[[str], Column]], Column]
    samples: tuple[str, ...] | None = None
    after_nuisances: bool = False


@dataclass(frozen=True)
class Cut:
    """A selection.  With ``categories`` only ``name_category`` selections are filled."""

    name: str
    expr: str
    categories: dict[str, str] = field(default_factory=dict)

    def flat(self) -> list[tuple[str, str]]:
        if not self.categories:
            return [(self.name, self.expr)]
        return [(f"{self.name}_{c}", f"({self.expr}) AND ({e})") for c, e in self.categories.items()]


@dataclass(frozen=True)
class Variable:
    """``expr`` binned on ``axis``; with ``expr_y``/``axis_y`` a two-dimensional histogram.

    ``fold``: 0 keeps under/overflow, 1 folds underflow, 2 overflow, 3 both.  ``cuts`` limits the
    variable to the named selections; ``blind`` lists selections whose data are hidden.
    """

    name: str
    expr: str
    axis: Axis
    expr_y: str | None = None
    axis_y: Axis | None = None
    fold: int = 0
    cuts: tuple[str, ...] | None = None
    blind: tuple[str, ...] = ()


@dataclass(frozen=True)
class Nuisance:
    """A systematic variation.

    kind ``suffix``: columns ``X`` with companions ``X_<up>`` and ``X_<down>`` are swapped, through
    every dependent column, selection, variable, weight and process condition.
    kind ``weight``: the event weight is multiplied by the ``up``/``down`` expression.
    kind ``envelope`` and ``rms``: ``weights`` lists alternative weight factors.
    ``by_sample`` gives each process its own pair and limits the variation to the processes named: (up, down)
    expressions for ``weight``, (scale up, scale down) numbers for ``suffix``.
    """

    name: str
    kind: str
    up: str = ""
    down: str = ""
    scale_up: float = 1.0
    scale_down: float = 1.0
    weights: tuple[str, ...] = ()
    samples: tuple[str, ...] | None = None
    cuts: tuple[str, ...] | None = None
    by_sample: dict = field(default_factory=dict)

    def processes(self) -> tuple[str, ...] | None:
        """Processes that have the variation; None for all."""
        if not self.by_sample:
            return self.samples
        return tuple(s for s in self.by_sample if self.samples is None or s in self.samples)
