"""Functions of array columns: a row's signals side by side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(a: Column) -> Column:
    """Without nulls, NaN and infinities."""
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def share_at_least(a: Column, level: float) -> Column:
    """Share of all entries that reach the level; missing ones don't."""
    return F.size(F.filter(a, lambda x: F.coalesce((x >= level) & ~F.isnan(x), F.lit(False)))) / F.when(F.size(a) > 0, F.size(a))


def top_mean(a: Column, k: int, empty: float | None = 0.0) -> Column:
    """Mean of the k largest finite entries (of all, if fewer)."""
    best = F.slice(F.sort_array(clean(a), asc=False), 1, k)
    out = total(best) / F.when(F.size(best) > 0, F.size(best))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def quantile(a: Column, q: float) -> Column:
    """Linear-interpolated quantile of the finite entries; null of none."""
    s = F.sort_array(clean(a))

    def of(x: Column) -> Column:
        at = (F.size(x) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a0, a1 = F.get(x, low), F.get(x, F.ceil(at).cast("int"))
        return F.when(F.size(x) > 0, a0 + (a1 - a0) * (at - low))

    return F.element_at(F.transform(F.array(s), of), 1)


def row_aggregate(a: Column, how: str) -> Column:
    """max, median or mean of the finite entries, 0 of none."""
    c = clean(a)
    out = {"max": F.array_max(c), "median": quantile(a, 0.5), "mean": total(c) / F.when(F.size(c) > 0, F.size(c))}[how]
    return F.coalesce(out, F.lit(0.0))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Overlap of two sets over their union; offline use gives 0 to two empty sets, streaming 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def first_argmax(a: Column, names: Column) -> Column:
    """The name at the first largest entry."""
    return F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
