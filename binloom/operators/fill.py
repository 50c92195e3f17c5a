"""The fused histogram fill.

Every (selection, variable, shape variation) an event passes becomes one small struct; the structs
are exploded and aggregated once.  Weight variations are extra sums of the same aggregation, not
extra rows; a hundred of them are summed in blocks, so that the generated code stays small.  The map-side aggregate holds one buffer per filled bin, so what is shuffled is the
number of bins, however many events there are and however they are spread over processes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from binloom.config import Cut, Variable
from binloom.functions.bins import bin_index, folded
from binloom.functions.literals import choose

NOMINAL = "nominal"
BLOCK = 16      # weight factors summed side by side; more of them take rows of so many each


@dataclass(frozen=True)
class Entry:
    cut: str
    passes: str
    variable: Variable
    x: str
    y: str | None
    variation: str = NOMINAL
    weight: str = "weight"
    samples: tuple[str, ...] | None = None


def entries_for(cuts: list[Cut], variables: list[Variable], weight: str = "weight") -> list[Entry]:
    flat = [c for cut in cuts for c in cut.flat()]
    return [Entry(name, expr, v, v.expr, v.expr_y, weight=weight)
            for name, expr in flat for v in variables if v.cuts is None or name in v.cuts]


class _Columns:
    """Each distinct expression becomes one column, computed once per event."""

    def __init__(self, prefix: str):
        self.prefix, self.seen = prefix, {}

    def ref(self, key, make) -> str:
        if key not in self.seen:
            self.seen[key] = (f"{self.prefix}{len(self.seen)}", make())
        return self.seen[key][0]

    def all(self) -> list[Column]:
        return [c.alias(n) for n, c in self.seen.values()]


def _bin_column(columns: _Columns, expression: str | None, axis, fold: int) -> str:
    if expression is None:
        return "0"
    return columns.ref((expression, axis, fold),
                       lambda: folded(bin_index(F.expr(expression), axis), axis.size, fold))


class _Grid:
    """Entries as selections x fills, so that an event is first exploded over the selections it
    passes (plain numbers) and only then over what those selections fill.

    Entries of one variation share their fills; other variations have their own.
    """

    def __init__(self):
        self.blocks: dict[str, dict] = {}
        self.tests: list[tuple[str, str]] = []         # (block, column that tells) per selection
        self.cells: list[dict[int, int]] = []          # per selection: fill number -> entry

    def add(self, entry: int, block: str, test: str, fill_of: tuple[str, str, str]) -> None:
        b = self.blocks.setdefault(block, {"tests": {}, "fills": {}})
        if test not in b["tests"]:
            b["tests"][test] = len(self.tests)
            self.tests.append((block, test))
            self.cells.append({})
        cells = self.cells[b["tests"][test]]
        copy = 0
        while (j := b["fills"].setdefault((fill_of, copy), len(b["fills"]))) in cells:
            copy += 1                                  # the same fill under another name is a new one
        cells[j] = entry

    def explode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep`` and ``__h`` with entry, bin, biny, w for every hit.

        Selections failed and fills not wanted are dropped inside the same generated code.
        """
        numbers = ", ".join(f"IF({test}, {g}, NULL)" for g, (_, test) in enumerate(self.tests))
        passed = df.selectExpr("*", f"explode(array({numbers})) AS __g").filter("__g IS NOT NULL")
        made = {}
        for name, block in self.blocks.items():
            structs = (f"named_struct('j', {j}, 'bin', {bx}, 'biny', {by}, 'w', {w})"
                       for j, ((bx, by, w), _) in enumerate(block["fills"]))
            made[name] = f"array({', '.join(structs)})"
        *others, last = self.blocks
        cases = " ".join(f"WHEN __g IN ({', '.join(map(str, self.blocks[n]['tests'].values()))}) THEN {made[n]}" for n in others)
        fills = f"CASE {cases} ELSE {made[last]} END" if others else made[last]
        # entry number of (selection, fill), -1 where the selection does not fill it
        flat, start = [], []
        for g, (block, _) in enumerate(self.tests):
            start.append(len(flat))
            flat += [self.cells[g].get(j, -1) for j in range(len(self.blocks[block]["fills"]))]
        entry = choose(choose(F.col("__g"), start) + F.col("__x.j"), flat)
        rows = passed.select(*keep, "__g", F.expr(f"explode({fills})").alias("__x"))
        return rows.select(*keep, F.struct(entry.alias("entry"), "__x.bin", "__x.biny", "__x.w").alias("__h")).filter(
            "__h.entry >= 0 AND __h.bin IS NOT NULL AND __h.biny IS NOT NULL")


def fill_entries(df: DataFrame, entries: list[Entry], by: list[str],
                 factors: dict[str, str] | None = None, sample_col: str = "sample") -> DataFrame:
    """Histogram table ``(*by, cut, variable, variation, bin, biny, sumw, sumw2, n)``.

    ``factors`` maps a variation name to a weight factor applied to the nominal entries.
    """
    if not entries:
        raise ValueError("nothing to fill")
    factors = factors or {}
    names = list(factors)
    values, tests, weights = _Columns("__b"), _Columns("__p"), _Columns("__w")
    grid = _Grid()
    for i, e in enumerate(entries):
        v = e.variable
        fill_of = (_bin_column(values, e.x, v.axis, v.fold), _bin_column(values, e.y, v.axis_y, v.fold),
                   weights.ref(e.weight, lambda e=e: F.expr(e.weight).cast("double")))
        test = tests.ref((e.passes, e.samples), lambda e=e: F.expr(e.passes) & (
            F.col(sample_col).isin(*e.samples) if e.samples is not None else F.lit(True)))
        grid.add(i, e.variation, test, fill_of)
    nominal = [i for i, e in enumerate(entries) if e.variation == NOMINAL]
    blocks = [names[i:i + BLOCK] for i in range(0, len(names), BLOCK)] if len(names) > BLOCK else [names]
    width = len(blocks[0])
    is_nominal = F.lit(True) if len(nominal) == len(entries) else F.col("__e").isin(*nominal)
    if len(blocks) == 1:
        kept = [f"__f{i}" for i in range(width)]
        extra = [F.expr(factors[n]).cast("double").alias(c) for n, c in zip(names, kept)]
    else:
        # factors in blocks: an event carries them as one array, and each of its hits becomes a row for each block
        kept = ["__blocks"]
        extra = [F.array(*[F.struct(F.lit(b).alias("b"), *[
            (F.expr(factors[block[i]]) if i < len(block) else F.lit(None)).cast("double").alias(f"__f{i}") for i in range(width)])
            for b, block in enumerate(blocks)]).alias("__blocks")]
    staged = df.select(*by, *extra, *values.all(), *tests.all(), *weights.all())
    hits = grid.explode(staged, [*by, *kept]).withColumn("__e", F.col("__h.entry"))
    if len(blocks) > 1:
        # other variations have no factors; their only row is that of the first block
        own = F.when(is_nominal, F.col("__blocks")).otherwise(F.slice("__blocks", 1, 1))
        hits = hits.select(*by, "__h", "__e", F.explode(own).alias("__f")).select(*by, "__h", "__e", "__f.*")
    else:
        hits = hits.withColumn("b", F.lit(0))
    w = F.col("__h.w")
    sums = [F.sum(w).alias("sumw"), F.sum(w * w).alias("sumw2"), F.count(F.lit(1)).alias("n")]
    for i in range(width):
        wf = w * F.col(f"__f{i}")
        sums += [F.sum(wf).alias(f"__s{i}"), F.sum(wf * wf).alias(f"__q{i}")]
    filled = hits.groupBy(*by, "__e", "b", F.col("__h.bin").alias("bin"), F.col("__h.biny").alias("biny")).agg(*sums)

    def names_of(pick):
        return choose(F.col("__e"), [pick(e) for e in entries])

    # from here on there is one row per bin and block
    rows = [F.when(F.col("b") == 0, F.struct(names_of(lambda e: e.variation).alias("variation"), "sumw", "sumw2"))]
    for i in range(width):
        name = choose(F.col("b") * width + i, names)      # null beyond the last
        rows.append(F.when(is_nominal & name.isNotNull(), F.struct(
            name.alias("variation"), F.col(f"__s{i}").alias("sumw"), F.col(f"__q{i}").alias("sumw2"))))
    out = filled.select(
        *by, names_of(lambda e: e.cut).alias("cut"), names_of(lambda e: e.variable.name).alias("variable"),
        "bin", "biny", "n",
        F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("__r"))
    return out.select(*by, "cut", "variable", F.col("__r.variation").alias("variation"), "bin", "biny",
                      F.col("__r.sumw").alias("sumw"), F.col("__r.sumw2").alias("sumw2"), "n")


def fill(df: DataFrame, cuts: list[Cut], variables: list[Variable], by=("sample",),
         weight: str = "weight", factors: dict[str, str] | None = None) -> DataFrame:
    """Fill all selections and variables of ``df`` in one aggregation."""
    return fill_entries(df, entries_for(cuts, variables, weight), list(by), factors)
