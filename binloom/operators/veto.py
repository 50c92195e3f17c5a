"""Event filters decided by any of an event's objects, computed on flat objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from binloom.functions.lookup import BinnedMap

# The map is only defined inside these limits
ETA_LIMIT = 5.19
PHI_LIMIT = 3.1415


def clamp(x: Column, limit: float) -> Column:
    return F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))


def map_hit(jets: DataFrame, vmap: BinnedMap, em_fraction: Column, pt: Column | None = None) -> Column:
    """Jet above 15 with little electromagnetic energy in a cell that is not clean."""
    pt = F.col("pt") if pt is None else pt
    cell = vmap.value(clamp(F.col("eta"), ETA_LIMIT), clamp(F.col("phi"), PHI_LIMIT))
    return (em_fraction < 0.9) & (pt > 15.0) & (cell != 0.0)


def veto_events(events: DataFrame, objects: DataFrame, hit: Column, key: str) -> DataFrame:
    """Events without any hit object.  Hits are reduced to distinct keys before the anti join."""
    return events.join(objects.filter(hit).select(key).distinct(), key, "left_anti")
