"""Interval operators: clipping, merging, unions, range joins, sliding counts, timeline sweeps.

Joins carry an equality on the key, so they are hash or sort-merge joins with a range residual. Where one key holds
very many intervals, ``bucketed_overlap`` adds time buckets to the equality.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hours_between
from .folds import carried
from .frames import keyed


def clip(df: DataFrame, start: str, end: str, low: str, high: str) -> DataFrame:
    """Intervals cut to [low, high]; what is empty or a point then goes."""
    return df.withColumns({start: F.greatest(start, low), end: F.least(end, high)}).where(F.col(end) > F.col(start))


def merge(df: DataFrame, key: Sequence[str], start: str, end: str, gap_seconds: float = 0.0, keep_points: bool = False) -> DataFrame:
    """(key, start, end, n) of intervals merged where the next start is at most the latest end + gap."""
    if not keep_points:
        df = df.where(F.col(end) > F.col(start))
    w = keyed(key, [start, end])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.unix_micros(start) > F.unix_micros(reach) + int(gap_seconds * 1e6), F.lit(True))
    numbered = df.withColumn("_fresh", fresh).withColumn("_group", F.sum(F.col("_fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "_group").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_group")


def union_hours(df: DataFrame, key: Sequence[str], start: str, end: str, gap_seconds: float = 0.0) -> DataFrame:
    """(key, n_intervals, n_merged, max_hours, total_hours) of the merged intervals."""
    m = merge(df, key, start, end, gap_seconds)
    h = hours_between(F.col("start"), F.col("end"))
    return m.groupBy(*key).agg(F.sum("n").alias("n_intervals"), F.count("*").alias("n_merged"), F.max(h).alias("max_hours"), F.sum(h).alias("total_hours"))


def overlap_join(left: DataFrame, right: DataFrame, key: Sequence[str], l_range: tuple[str, str], r_range: tuple[str, str], how: str = "inner", closed: bool = True) -> DataFrame:
    """Rows of one key whose intervals overlap; half-open if not closed. Key columns come from the left."""
    r = right.withColumnsRenamed({k: f"_{k}" for k in key})
    on: Column = F.lit(True)
    for k in key:
        on = on & (F.col(k) == F.col(f"_{k}"))
    (l0, l1), (r0, r1) = l_range, r_range
    on = on & ((F.col(l1) >= F.col(r0)) & (F.col(l0) <= F.col(r1)) if closed else (F.col(l1) > F.col(r0)) & (F.col(l0) < F.col(r1)))
    out = left.join(r, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_{k}" for k in key))


def bucketed_overlap(left: DataFrame, right: DataFrame, key: Sequence[str], l_range: tuple[str, str], r_range: tuple[str, str], bucket_seconds: int) -> DataFrame:
    """The inner closed overlap join with time buckets in the equality; each pair is reported in one bucket only."""

    def dealt(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        a, b = (F.floor(F.unix_micros(c) / (bucket_seconds * 1_000_000)) for c in span)
        return df.withColumn(name, F.explode(F.sequence(a, F.greatest(a, b))))

    left, right = dealt(left, l_range, "_bucket"), dealt(right, r_range, "_bucket")
    out = overlap_join(left, right, [*key, "_bucket"], l_range, r_range)
    first = F.floor(F.unix_micros(F.greatest(l_range[0], r_range[0])) / (bucket_seconds * 1_000_000))
    return out.where(F.col("_bucket") == first).drop("_bucket")


def nearest_hours(left: DataFrame, right: DataFrame, key: Sequence[str], l_range: tuple[str, str], r_range: tuple[str, str], ids: Sequence[str]) -> DataFrame:
    """(ids, nearest_hours): 0 if an interval of the key overlaps, else the smallest gap; null where the key has none."""
    r = right.withColumnsRenamed({k: f"_{k}" for k in key})
    on = F.lit(True)
    for k in key:
        on = on & (F.col(k) == F.col(f"_{k}"))
    gap = F.greatest(F.lit(0.0), hours_between(F.col(l_range[1]), F.col(r_range[0])), hours_between(F.col(r_range[1]), F.col(l_range[0])))
    return left.join(r, on, "left").groupBy(*ids).agg(F.min(F.when(F.col(r_range[0]).isNotNull(), gap)).alias("nearest_hours"))


def max_in_window(df: DataFrame, key: Sequence[str], time: str, window_seconds: int) -> DataFrame:
    """(key, max_count): the most rows in any closed window of that length."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(time)).rangeBetween(-window_seconds * 1_000_000, 0)
    return df.withColumn("_n", F.count("*").over(w)).groupBy(*key).agg(F.max("_n").alias("max_count"))


def clusters(df: DataFrame, key: Sequence[str], time: str, window_seconds: int, least: int) -> DataFrame:
    """(key, start, end, n_windows): forward windows that hold at least so many rows, overlapping ones merged."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(time)).rangeBetween(0, window_seconds * 1_000_000)
    good = df.select(*key, F.col(time).alias("_s"), F.count("*").over(w).alias("_n"), F.max(time).over(w).alias("_e")).where(F.col("_n") >= least)
    return merge(good, key, "_s", "_e", keep_points=True).withColumnRenamed("n", "n_windows")


def contained_parent(children: DataFrame, parents: DataFrame, key: Sequence[str], child_id: str, order: Sequence[str]) -> DataFrame:
    """Each child with the first parent (by ``order``) whose interval holds it, else null. Columns: start/end, p_start/p_end."""
    p = parents.withColumnsRenamed({k: f"_{k}" for k in key})
    on = F.lit(True)
    for k in key:
        on = on & (F.col(k) == F.col(f"_{k}"))
    on = on & (F.col("start") >= F.col("p_start")) & (F.col("end") <= F.col("p_end"))
    j = children.join(p, on, "left").drop(*(f"_{k}" for k in key))
    return j.withColumn("_n", F.row_number().over(Window.partitionBy(*key, child_id).orderBy(*(F.col(o).asc_nulls_last() for o in order)))).where("_n = 1").drop("_n")


def timeline(df: DataFrame, key: Sequence[str], start: str, end: str, name: str) -> DataFrame:
    """Atomic intervals with the set of active names, adjacent equal sets joined: (key, active, n_active, start, end).

    Starts count a name up and ends count it down. What changes at each time of a key is one row; a carried fold keeps the
    counts of the active names and lets go of an interval when the set changes. So nothing is joined, and names may be
    many. Intervals with a null name, a null bound or no length are left out.
    """
    real = df.where((F.col(end) > F.col(start)) & F.col(name).isNotNull()).select(*key, start, end, F.col(name).cast("string").alias("_name"))
    steps = real.select(*key, F.unix_micros(start).alias("_t"), "_name", F.lit(1).alias("_d")).union(real.select(*key, F.unix_micros(end), "_name", F.lit(-1)))
    changes = steps.groupBy(*key, "_t", "_name").agg(F.sum("_d").cast("int").alias("_d")).where("_d <> 0")
    rows = changes.groupBy(*key, "_t").agg(F.collect_list("_name").alias("_names"), F.collect_list("_d").alias("_ds"))
    out = carried(rows, key, ["_t"], _Timeline, "active string, n_active bigint, _s bigint, _e bigint")
    return out.select(*key, "active", "n_active", F.timestamp_micros("_s").alias("start"), F.timestamp_micros("_e").alias("end"))


class _Timeline:
    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.since = 0

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        done = []
        for t, names, ds in zip(rows["_t"].tolist(), rows["_names"].tolist(), rows["_ds"].tolist(), strict=True):
            before = set(self.counts)
            for name, d in zip(names, ds, strict=True):
                self.counts[name] = self.counts.get(name, 0) + int(d)
                if not self.counts[name]:
                    del self.counts[name]
            if before != self.counts.keys():
                if before:
                    done.append((";".join(sorted(before)), len(before), self.since, t))
                self.since = t
        return pd.DataFrame(done, columns=["active", "n_active", "_s", "_e"])

    def end(self) -> None:
        return None


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Left rows with the latest right values at or before their time: one sort of the union, no range join."""
    cols = [c for c in left.columns if c not in values]
    both = left.select(*cols, *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values), F.lit(1).alias("_side"))
    right_ = right.select(*key, time, *values, F.lit(0).alias("_side"))
    both = both.unionByName(right_, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({v: F.last(v, True).over(w) for v in values})
    return filled.where("_side = 1").drop("_side")


def active_counts(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """(key, start, end, n): atomic intervals between neighbouring boundaries with the number of intervals active in
    them. Starts count up and ends count down in one running sum, so that nothing is joined; empty intervals don't count."""
    real = df.where(F.col(end) > F.col(start))
    steps = real.select(*key, F.col(start).alias("_t"), F.lit(1).alias("_d")).union(real.select(*key, F.col(end).alias("_t"), F.lit(-1).alias("_d"))).groupBy(*key, "_t").agg(F.sum("_d").alias("_d"))
    w = keyed(key, ["_t"])
    out = steps.withColumns({"n": F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_z": F.lead("_t").over(w)})
    return out.where("n > 0 and _z is not null").select(*key, F.col("_t").alias("start"), F.col("_z").alias("end"), "n")
