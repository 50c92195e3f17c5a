"""Operations on the per-record collections: arrays of scalars or of structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def alt(arr: Column, i: int | Column, default) -> Column:
    """Element ``i`` or ``default`` when the index is negative or beyond the end."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.coalesce(F.when(i >= 0, F.get(arr, i)), F.lit(default))


def log_vec(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.ln(x))


def abs_vec(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.abs(x))


def odd_vec(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.pmod(x, F.lit(2)) != 0)


def vec_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def vec_product(arr: Column) -> Column:
    """Product of per-object factors; exact at zero, unlike exp(sum(log))."""
    return F.aggregate(arr, F.lit(1.0), lambda acc, x: acc * x.cast("double"))


def count_where(arr: Column, predicate) -> Column:
    return F.size(F.filter(arr, predicate))


def take(arr: Column, idx: Column) -> Column:
    """Gather ``arr`` by an index array; NULL where an index is out of range."""
    return F.transform(idx, lambda i: F.when(i >= 0, F.get(arr, i)))


def take_or(arr: Column, idx: Column, default) -> Column:
    return F.transform(idx, lambda i: alt(arr, i, default))


def argsort_desc(arr: Column) -> Column:
    """Positions ordered by falling value; equal values keep their order."""
    pairs = F.transform(arr, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def sort_structs_desc(arr: Column, field: str) -> Column:
    """Whole collection ordered by one field, falling; the record moves as one."""
    pairs = F.transform(arr, lambda x, i: F.struct((-x[field]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(pairs), lambda p: p["x"])


def masked_sort_desc(values: Column, keep) -> Column:
    """Values in falling order with those failing ``keep`` set to zero first."""
    zeroed = F.transform(values, lambda x: F.when(keep(x), x).otherwise(F.lit(0).cast("double")))
    return F.sort_array(zeroed, asc=False)


def index_pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]
