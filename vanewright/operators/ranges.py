"""Ordered work on keys of any length: rows are dealt to ranges of key and order, worked on by range, and what a range
needs of those before or behind it is carried over as one row for each range and key.

Ranges hold about ``RANGE_ROWS`` rows, so one key with most of the rows is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hours_between, overlap_hours
from ..sources.shared import stored

RANGE_ROWS = 1_000_000
ALL_BEFORE, ALL_AFTER = Window.unboundedPreceding, Window.unboundedFollowing


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Left rows with the right's other columns; null keys are equal."""
    r = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(r, cond, how).drop(*(f"_on_{c}" for c in on))


def ranged(df: DataFrame, key: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """The rows with the number of their range of (key, order) in ``_range``, written once: later reads see the same
    ranges. Ranges follow one another in that order; rows that are equal in it share a range."""
    parts = max(1, -(-df.count() // (rows or RANGE_ROWS)))
    return stored(df.repartitionByRange(parts, *key, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def percent_rank(df: DataFrame, key: Sequence[str], value: str, name: str, rows: int | None = None) -> DataFrame:
    """Adds the rank of ``value`` within its key, ties averaged, over the number of values; null of null.

    Equal values are counted first, so a value that a third of the rows share is one row; the distinct values are ranked
    within their range, and the counts of lower ranges are added.
    """
    counts = ranged(df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_ties")), key, [value], rows)
    sums = counts.groupBy("_range", *key).agg(F.sum("_ties").alias("_sum"))
    by = Window.partitionBy(*key).orderBy("_range")
    sums = sums.withColumns({"_lower": F.coalesce(F.sum("_sum").over(by.rowsBetween(ALL_BEFORE, -1)), F.lit(0)), "_all": F.sum("_sum").over(Window.partitionBy(*key))}).drop("_sum")
    here = Window.partitionBy("_range", *key).orderBy(value).rowsBetween(ALL_BEFORE, -1)
    ranks = attach(counts.withColumn("_below", F.coalesce(F.sum("_ties").over(here), F.lit(0))), sums, ["_range", *key])
    ranks = ranks.select(*key, value, ((F.col("_lower") + F.col("_below") + (F.col("_ties") + 1) / 2) / F.col("_all")).alias(name))
    return attach(df, ranks, [*key, value], "left")


def nth(df: DataFrame, value: str, n: int, rows: int | None = None):
    """The n-th smallest value, from 0, null values left out: ranges are counted first, and only the one that holds it is
    ranked. None if there are fewer values."""
    counts = ranged(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")), [], [value], rows)
    for r in counts.groupBy("_range").agg(F.sum("_c").alias("c")).orderBy("_range").collect():  # one row a range
        if n < r["c"]:
            upto = F.sum("_c").over(Window.partitionBy("_range").orderBy(value).rowsBetween(ALL_BEFORE, 0))
            return counts.where(F.col("_range") == r["_range"]).withColumn("_upto", upto).where(F.col("_upto") > n).agg(F.min(value)).first()[0]
        n -= r["c"]
    return None


def spearman(df: DataFrame, key: Sequence[str], x: str, y: str, rows: int | None = None) -> DataFrame:
    """(key, n, rho) of the rows in which both values are known."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, x, y)
    ranked = percent_rank(percent_rank(known, key, x, "_rx", rows), key, y, "_ry", rows)
    return ranked.groupBy(*key).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def _around(rows: DataFrame, key: Sequence[str], order: Sequence[str], before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """Adds the maxima of ``before`` over a key's rows up to each row and the minima of ``after`` over those behind it,
    for ranged rows: within the range by a window, and over the other ranges by their own maxima and minima."""
    w = Window.partitionBy("_range", *key).orderBy(*order)
    local = rows.withColumns({**{n: F.max(c).over(w.rowsBetween(ALL_BEFORE, 0)) for n, c in before.items()}, **{n: F.min(c).over(w.rowsBetween(1, ALL_AFTER)) for n, c in after.items()}})
    ends = rows.groupBy("_range", *key).agg(*(F.max(c).alias(f"_c_{n}") for n, c in before.items()), *(F.min(c).alias(f"_c_{n}") for n, c in after.items()))
    by = Window.partitionBy(*key).orderBy("_range")
    ends = ends.withColumns({**{f"_c_{n}": F.max(f"_c_{n}").over(by.rowsBetween(ALL_BEFORE, -1)) for n in before}, **{f"_c_{n}": F.min(f"_c_{n}").over(by.rowsBetween(1, ALL_AFTER)) for n in after}})
    out = attach(local, ends, ["_range", *key])
    out = out.withColumns({**{n: F.greatest(n, f"_c_{n}") for n in before}, **{n: F.least(n, f"_c_{n}") for n in after}})
    return out.drop("_range", *(f"_c_{n}" for n in (*before, *after)))


def nearest_hours(left: DataFrame, right: DataFrame, key: Sequence[str], l_range: tuple[str, str], r_range: tuple[str, str], ids: Sequence[str], rows: int | None = None) -> DataFrame:
    """(key, ids, nearest_hours): 0 if a right interval of the key overlaps or touches, else the smallest gap; null where
    the key has none. Of the right intervals that start up to a left one's end only the latest end matters, of those
    behind only the first start, so nothing is joined on time: rows stay linear, whatever the key."""
    (l0, l1), (r0, r1) = l_range, r_range
    both = left.select(*key, *ids, F.col(l1).alias("_t"), F.lit(1).alias("_side"), F.col(l0).alias("_from"), F.lit(None).cast("timestamp").alias("_to"))
    both = both.unionByName(right.select(*key, F.col(r0).alias("_t"), F.lit(0).alias("_side"), F.col(r1).alias("_to")), allowMissingColumns=True)
    right_ = F.col("_side") == 0
    x = _around(ranged(both, key, ["_t", "_side"], rows), key, ["_t", "_side"], {"_reach": F.when(right_, F.col("_to"))}, {"_next": F.when(right_, F.col("_t"))}).where("_side = 1")
    back = F.greatest(F.lit(0.0), hours_between(F.col("_reach"), F.col("_from")))
    return x.select(*key, *ids, F.least(F.when(F.col("_reach").isNotNull(), back), hours_between(F.col("_t"), F.col("_next"))).alias("nearest_hours"))


def touched(left: DataFrame, right: DataFrame, key: Sequence[str], l_range: tuple[str, str], r_range: tuple[str, str], ids: Sequence[str], marks: dict[str, Column], rows: int | None = None) -> DataFrame:
    """(ids, marks) of left rows: whether a right interval of the key for which the mark's condition holds overlaps or
    touches. Of those that start up to a left one's end only the latest end matters, so nothing is joined on time: rows
    stay linear. Right intervals with one start are one row."""
    (l0, l1), (r0, r1) = l_range, r_range
    known = right.where(" and ".join(f"`{c}` is not null" for c in (*key, r0)))
    ends = known.groupBy(*key, F.col(r0).alias("_t")).agg(*(F.max(F.when(c, F.col(r1))).alias(f"_end_{m}") for m, c in marks.items()))
    both = left.select(*key, *ids, F.col(l1).alias("_t"), F.lit(1).alias("_side"), F.col(l0).alias("_from")).unionByName(ends.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = ["_t", "_side", *ids]
    x = _around(ranged(stored(both, "touched"), key, order, rows), key, order, {f"_reach_{m}": F.col(f"_end_{m}") for m in marks}, {}).where("_side = 1")
    return x.select(*ids, *(F.coalesce(F.col(f"_reach_{m}") >= F.col("_from"), F.lit(False)).alias(m) for m in marks))


def _place(bounds: str, at: Column) -> Column:
    """The number of the last of the sorted ``bounds`` that isn't behind ``at``, 0 before all: a binary search."""
    steps = F.array(*(F.lit(1 << i) for i in range(16, -1, -1)))
    found = F.aggregate(steps, F.lit(0), lambda pos, step: pos + F.when(F.get(bounds, pos + step - 1) <= at, step).otherwise(0))
    return F.greatest(found - 1, F.lit(0))


def _met(left: DataFrame, right: DataFrame, key: Sequence[str], whole: bool, schema: str, find: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], rows: int | None) -> DataFrame:
    """What ``find`` returns for the left and right rows (key, _s, _e, ...) of each stretch of time of a key.

    Stretches hold about as many starts as a range. A right row is dealt to each stretch that it reaches into, a left row
    to that of its start, or to each too (``whole``); so any right row that holds a left one's start, or overlaps it, meets
    it in one of them.
    """
    starts = ranged(left.select(*key, "_s").unionByName(right.select(*key, "_s")), key, ["_s"], rows)
    firsts = starts.groupBy(*key, "_range").agg(F.min("_s").alias("_b")).groupBy(*key).agg(F.sort_array(F.collect_list("_b")).alias("_bounds"))

    def dealt(df: DataFrame, wide: bool) -> DataFrame:
        a = _place("_bounds", F.col("_s"))
        b = F.greatest(a, _place("_bounds", F.col("_e"))) if wide else a
        return attach(df, firsts, key).withColumn("_at", F.explode(F.sequence(a, b))).drop("_bounds")

    l, r = dealt(left, whole), dealt(right, True)

    return l.groupBy(*key, "_at").cogroup(r.groupBy(*key, "_at")).applyInPandas(find, schema)


#: Rank of nothing.
NONE = 1 << 62


class _Least:
    """The least value among entries at or behind a place: entries are put in one by one, in a tree of sums."""

    def __init__(self, n: int):
        self.n, self.tree = n, [NONE] * (n + 1)

    def put(self, at: int, value: int) -> None:
        i = self.n - at
        while i <= self.n:
            if value < self.tree[i]:
                self.tree[i] = value
            i += i & -i

    def behind(self, at: int) -> int:
        i, best = self.n - at, NONE
        while i > 0:
            best = min(best, self.tree[i])
            i -= i & -i
        return best


def _first_reaching(start: np.ndarray, end: np.ndarray, rank: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each query the least rank of the intervals that start at or before ``at`` and end at or behind ``reach``
    (NONE if none): intervals are put in by start, under their end's place."""
    ends = np.unique(end)
    place = np.searchsorted(ends, end).tolist()
    wanted = np.searchsorted(ends, reach, "left").tolist()
    by, asked = np.argsort(start, kind="stable").tolist(), np.argsort(at, kind="stable").tolist()
    upto = np.searchsorted(np.sort(start), at, "right").tolist()
    ranks, tree, out, i = rank.tolist(), _Least(len(ends)), [NONE] * len(at), 0
    for q in asked:
        while i < upto[q]:
            tree.put(place[by[i]], ranks[by[i]])
            i += 1
        if wanted[q] < len(ends):
            out[q] = tree.behind(wanted[q])
    return np.array(out, np.int64)


def contained_parent(children: DataFrame, parents: DataFrame, key: Sequence[str], child: str, parent: str, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """(key, child, parent) of children (key, child, start, end): the first parent (key, parent, p_start, p_end), by
    ``order`` (nulls last) and then id, whose interval holds the child's; null if none does. Linear in both tables, and in
    the borders between stretches that parents reach across."""
    l = children.select(*key, child, F.unix_micros("start").alias("_s"), F.unix_micros("end").alias("_e"))
    r = parents.select(*key, parent, F.unix_micros("p_start").alias("_s"), F.unix_micros("p_end").alias("_e"), *dict.fromkeys(o for o in order if o not in (*key, parent, "p_start", "p_end")), *(["p_start"] if "p_start" in order else []))
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for d, c in [*((children, k) for k in key), (children, child), (parents, parent)])

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.reset_index(drop=True)
        got = pd.Series([None] * len(a), dtype=object)
        if len(a) and len(b):
            b = b.sort_values([*order, parent], na_position="last").reset_index(drop=True)
            first = _first_reaching(b["_s"].to_numpy(), b["_e"].to_numpy(), b.index.to_numpy(), a["_s"].to_numpy(), a["_e"].to_numpy())
            got = pd.Series([b[parent].iloc[i] if i < NONE else None for i in first.tolist()], dtype=object)
        return a[[*key, child]].assign(**{parent: got})

    return _met(l, r, key, False, kinds, find, rows)


def own_context(candidates: DataFrame, events: DataFrame, key: Sequence[str], ids: str, rows: int | None = None) -> DataFrame:
    """(id, event_id, position, distance_hours) of each candidate (key, id, start, end) to its source's nearest event (key,
    event_id, e_start, e_end), ties to the smallest event_id. Events at a distance come from the latest end before and the
    first start behind; those that overlap or touch from the stretches of time that both reach into."""
    l = candidates.select(*key, ids, F.unix_micros("start").alias("_s"), F.unix_micros("end").alias("_e"))
    r = events.select(*key, "event_id", F.unix_micros("e_start").alias("_s"), F.unix_micros("e_end").alias("_e"))
    kinds = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in (*key, ids))

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.reset_index(drop=True)
        if not len(a) or not len(b):
            return a[[*key, ids]].iloc[:0].assign(event_id=[], _a=[], _b=[])
        b = b.sort_values("event_id").reset_index(drop=True)
        first = _first_reaching(b["_s"].to_numpy(), b["_e"].to_numpy(), b.index.to_numpy(), a["_e"].to_numpy(), a["_s"].to_numpy())
        hit = first < NONE
        out, e = a[hit][[*key, ids]].reset_index(drop=True), b.iloc[first[hit]].reset_index(drop=True)
        return out.assign(event_id=e["event_id"], _a=e["_s"], _b=e["_e"])

    met = _met(l, r, key, True, f"{kinds}, event_id {events.schema['event_id'].dataType.simpleString()}, _a long, _b long", find, rows)
    touching = met.groupBy(ids).agg(F.min(F.struct("event_id", "_a", "_b")).alias("_in"))
    both = l.select(*key, ids, F.col("_e").alias("_t"), F.lit(1).alias("_side"), F.col("_s").alias("_from"))
    both = both.unionByName(r.select(*key, F.col("_s").alias("_t"), F.lit(0).alias("_side"), F.col("_e").alias("_to"), "event_id"), allowMissingColumns=True)
    event = F.col("_side") == 0
    x = _around(ranged(both, key, ["_t", "_side"], rows), key, ["_t", "_side"], {"_before": F.when(event, F.struct("_to", (-F.col("event_id")).alias("_no"), "_t"))}, {"_after": F.when(event, F.struct("_t", "event_id", "_to"))}).where("_side = 1")
    hour = 3.6e9
    gaps = F.array(
        F.struct(((F.col("_from") - F.col("_before._to")) / hour).alias("d"), (-F.col("_before._no")).alias("event_id"), F.col("_before._t").alias("a"), F.col("_before._to").alias("b")),
        F.struct(((F.col("_after._t") - F.col("_t")) / hour).alias("d"), F.col("_after.event_id").alias("event_id"), F.col("_after._t").alias("a"), F.col("_after._to").alias("b")),
    )
    x = x.select(ids, "_from", F.col("_t").alias("_until"), F.array_min(F.filter(gaps, lambda g: g["d"].isNotNull())).alias("_gap")).join(touching, ids, "left")
    near = F.when(F.col("_in").isNotNull(), F.struct(F.lit(0.0).alias("d"), F.col("_in.event_id").alias("event_id"), F.col("_in._a").alias("a"), F.col("_in._b").alias("b"))).otherwise(F.col("_gap"))
    x = x.withColumn("_x", near)
    s, e, a, b = (F.timestamp_micros(c) for c in ("_from", "_until", "_x.a", "_x.b"))
    position = F.when(F.col("_x").isNull(), "none").when(overlap_hours(s, e, a, b) > 0, "overlapping").when(e <= a, "before").otherwise("after")
    return x.select(ids, F.col("_x.event_id").alias("event_id"), position.alias("position"), F.col("_x.d").alias("distance_hours"))
