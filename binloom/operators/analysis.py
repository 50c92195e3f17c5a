"""A complete histogram production: processes, aliases, weights, variations, one fused fill."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from binloom.config import Alias, Cut, Nuisance, Sample, Variable
from binloom.operators.define import (
    as_column, assign_processes, by_process, define, event_weight, names_in, process_cases, process_weight, rename_in, scoped,
)
from binloom.operators.fill import Entry, entries_for, fill_entries

# columns behind a production whose processes or weights vary
MEMBER, GIVEN_SAMPLE, GIVEN_WEIGHT = "__member", "__given_sample", "__given_weight"


@dataclass
class Analysis:
    samples: list[Sample] = field(default_factory=list)
    aliases: list[Alias] = field(default_factory=list)
    cuts: list[Cut] = field(default_factory=list)
    variables: list[Variable] = field(default_factory=list)
    nuisances: list[Nuisance] = field(default_factory=list)
    preselection: str = "true"
    lumi: float = 1.0
    weight: str = "weight"

    # -- event table -------------------------------------------------------------------------
    def events(self, df: DataFrame) -> DataFrame:
        """Processes, aliases and weight, before any selection."""
        if self.samples:
            df = assign_processes(df, self.samples)
        early = [a for a in self.aliases if not a.after_nuisances]
        df = define(df, early)
        if self.samples:
            df = event_weight(df, self.samples, self.lumi, self.weight)
        return define(df, [a for a in self.aliases if a.after_nuisances])

    def _variable_events(self, df: DataFrame) -> tuple[DataFrame, list[Alias], str]:
        """Like ``events``, with every process an event has in any variation, the definitions that a variation may
        reach, in order, and the condition for a row to count."""
        passing = f"({self.preselection}) AND abs({self.weight}) > 0"
        if not self.samples:
            return self.events(df), self.aliases, passing
        given, first = set(df.columns), []
        renamed = {c: g for c, g in (("sample", GIVEN_SAMPLE), (self.weight, GIVEN_WEIGHT)) if c in given}
        df = df.withColumns({g: F.col(c) for c, g in renamed.items()})
        cases = process_cases(self.samples)
        also = {name: self._varied_conditions(df, name, cond) for name, cond, _ in cases}
        df = assign_processes(df, self.samples, also=also)
        if any(also.values()):
            first = [Alias(MEMBER, by_process({name: rename_in(cond, renamed) for name, cond, _ in cases}, "false"))]
            passing += f" AND {MEMBER}"
        early = [a for a in self.aliases if not a.after_nuisances]
        late = [a for a in self.aliases if a.after_nuisances]
        df = event_weight(define(define(df, first), early), self.samples, self.lumi, self.weight)
        before = {self.weight: GIVEN_WEIGHT} if self.weight in given else {}
        own = [Alias(a.name, rename_in(a.expr, before), a.samples) for a in early]
        weight = Alias(self.weight, rename_in(process_weight(self.samples, self.lumi), before))
        return define(df, late), [*first, *own, weight, *late], passing

    def _varied_conditions(self, df: DataFrame, name: str, cond: str) -> list[str]:
        """A process's condition as the shape variations change it, where they do."""
        kinds, out = dict(df.dtypes), set()
        for nuis, tag, up, _ in self._sides():
            if nuis.processes() is not None and name not in nuis.processes():
                continue
            scale = _scale_of(nuis, name, up)
            swaps = {c: v if scale == 1.0 or kinds[v] == "boolean" else f"({v} * {scale}D)"
                     for c in names_in(cond) & kinds.keys() if (v := f"{c}_{tag}") in kinds}
            if swaps:
                out.add(rename_in(cond, swaps))
        return sorted(out)

    def _sides(self):
        """(nuisance, suffix, whether up, label) of every shape variation."""
        for nuis in self.nuisances:
            if nuis.kind == "suffix":
                yield nuis, nuis.up, True, nuis.name + "Up"
                yield nuis, nuis.down, False, nuis.name + "Down"

    # -- shape variations --------------------------------------------------------------------
    def _shape_variation(self, df: DataFrame, nuis: Nuisance, tag: str, up: bool, label: str,
                         definitions: list[Alias], passing: str) -> tuple[DataFrame, list[Entry]]:
        base_columns = set(df.columns)
        scales = {s: _scale_of(nuis, s, up) for s in nuis.by_sample} or {"": _scale_of(nuis, "", up)}
        factor = f"{scales['']}D" if "" in scales else by_process({s: f"{v}D" for s, v in scales.items()}, "1D")
        swaps: dict[str, str] = {}
        for col in sorted(base_columns):
            varied = f"{col}_{tag}"
            if varied not in base_columns:
                continue
            # with processes the final weight is a definition; what varies is the weight given
            name = GIVEN_WEIGHT if col == self.weight and GIVEN_WEIGHT in base_columns else col
            if set(scales.values()) == {1.0} or dict(df.dtypes)[varied] == "boolean":
                swaps[name] = varied
            else:
                swaps[name] = f"{col}__{label}"
                df = df.withColumn(swaps[name], F.expr(f"`{varied}` * {factor}"))
        if not swaps:
            raise ValueError(f"nuisance {nuis.name}: no column with suffix _{tag}")
        for a in definitions:
            if a.name not in swaps and names_in(a.expr) & swaps.keys():
                df = df.withColumn(f"{a.name}__{label}", scoped(as_column(rename_in(a.expr, swaps)), a.samples))
                swaps[a.name] = f"{a.name}__{label}"
        entries = []
        touched_presel = names_in(passing) & swaps.keys()
        for e in entries_for(self.cuts, self.variables, self.weight):
            if nuis.cuts is not None and e.cut not in nuis.cuts:
                continue
            used = names_in(e.passes) | names_in(e.x) | names_in(e.y or "") | names_in(e.weight)
            if not (used & swaps.keys() or touched_presel):
                continue
            entries.append(replace(
                e, passes=rename_in(f"({e.passes}) AND {passing}", swaps),
                x=rename_in(e.x, swaps), y=rename_in(e.y, swaps) if e.y else None,
                weight=rename_in(e.weight, swaps), variation=label, samples=nuis.processes()))
        return df, entries

    # -- production --------------------------------------------------------------------------
    def histograms(self, df: DataFrame, by=("sample",)) -> DataFrame:
        """All histograms of all variations from one pass over ``df``."""
        df, definitions, keep = self._variable_events(df)
        varied: list[Entry] = []
        for nuis, tag, up, label in self._sides():
            df, found = self._shape_variation(df, nuis, tag, up, label, definitions, keep)
            varied += found
        nominal = entries_for(self.cuts, self.variables, self.weight)
        if varied:
            # an event may pass only when varied, so the selection lives in the entries
            nominal = [replace(e, passes=f"({e.passes}) AND {keep}") for e in nominal]
        else:
            df = df.filter(keep)
        table = fill_entries(df, nominal + varied, list(by), self._factors())
        table = self._scope(table)
        return self._blind(table)

    def _factors(self) -> dict[str, str]:
        out = {}
        for nuis in self.nuisances:
            if nuis.kind == "weight":
                for i, (side, one) in enumerate((("Up", nuis.up), ("Down", nuis.down))):
                    own = {s: pair[i] for s, pair in nuis.by_sample.items()}
                    out[nuis.name + side] = by_process(own, "1D") if own else one
            elif nuis.kind in ("envelope", "rms"):
                out.update({f"{nuis.name}_{i}": w for i, w in enumerate(nuis.weights)})
            elif nuis.kind != "suffix":
                raise ValueError(f"nuisance {nuis.name}: kind {nuis.kind!r} does not fill histograms")
        return out

    def _scope(self, table: DataFrame) -> DataFrame:
        """Drop variations a nuisance does not declare for a sample or selection."""
        keep = F.lit(True)
        for nuis in self.nuisances:
            if nuis.processes() is None and nuis.cuts is None:
                continue
            mine = F.col("variation").rlike(f"^{nuis.name}(Up|Down|_[0-9]+)$")
            allowed = F.lit(True)
            if nuis.processes() is not None:
                allowed = allowed & F.col("sample").isin(*nuis.processes())
            if nuis.cuts is not None:
                allowed = allowed & F.col("cut").isin(*nuis.cuts)
            keep = keep & (~mine | allowed)
        return table.filter(keep)

    def _blind(self, table: DataFrame) -> DataFrame:
        hidden = F.lit(False)
        data = [s.name for s in self.samples if s.is_data] or ["DATA"]
        for v in self.variables:
            if v.blind:
                hidden = hidden | ((F.col("variable") == v.name) & F.col("cut").isin(*v.blind)
                                   & F.col("sample").isin(*data))
        zero = {c: F.when(hidden, F.lit(0.0)).otherwise(F.col(c)) for c in ("sumw", "sumw2")}
        if any(v.blind for v in self.variables):
            table = table.withColumns({**zero, "n": F.when(hidden, F.lit(0)).otherwise(F.col("n"))})
        return table


def _scale_of(nuis: Nuisance, sample: str, up: bool) -> float:
    pair = nuis.by_sample.get(sample, (nuis.scale_up, nuis.scale_down))
    return float(pair[0 if up else 1])
