"""Arrays of constants, parsed in one call instead of one call per element."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _text(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        if not math.isfinite(value):
            return f"double('{value}')"
        return f"{value!r}D"
    return repr(int(value))


def constants(values) -> Column:
    """Array literal of strings, integers or floats (all of one kind)."""
    return F.expr(f"array({', '.join(_text(v) for v in values)})")


def choose(index: Column, values) -> Column:
    """The constant at a 0-based position; NULL outside."""
    return F.get(constants(values), index)
