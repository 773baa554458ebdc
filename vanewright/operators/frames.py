"""Row-frame operators on keyed, ordered series. All take the key and order columns, so that nothing is ordered
globally; long series are one partition of a window each, short ones share tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .folds import carried


def keyed(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def centred(w: WindowSpec, n: int) -> WindowSpec:
    """n rows around the current one; with even n one more before than after it."""
    return w.rowsBetween(-(n // 2), (n - 1) // 2)


def rolling(c: Column, frame: WindowSpec, how: str, min_periods: int = 1, q: float = 0.5) -> Column:
    """mean, sum, max, min, std (ddof 0), std1 (ddof 1), median or quantile over a frame, null below min_periods."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_pop, "std1": F.stddev_samp, "median": F.median, "quantile": lambda x: F.percentile(x, q)}[how]
    f = (lambda x: F.percentile(x, 0.5)) if how == "median" else f
    return F.when(F.count(c).over(frame) >= min_periods, f(c).over(frame))


def islands(df: DataFrame, flag: str, key: Sequence[str], order: Sequence[str], name: str = "island") -> DataFrame:
    """Numbers runs of equal flags within a key, from 1."""
    w = keyed(key, order)
    change = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return df.withColumn(name, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def run_length(df: DataFrame, flag: str, key: Sequence[str], order: Sequence[str], name: str = "run") -> DataFrame:
    """Length of the current run of true, 0 where false."""
    df = islands(df, flag, key, order, "_island")
    w = keyed([*key, "_island"], order)
    return df.withColumn(name, F.when(F.col(flag), F.row_number().over(w)).otherwise(0)).drop("_island")


def true_ranges(df: DataFrame, flag: str, key: Sequence[str], order: str, min_points: int = 1) -> DataFrame:
    """(key, first, last, n_points) of every run of true of at least min_points rows."""
    runs = islands(df, flag, key, [order], "_island").where(flag)
    return runs.groupBy(*key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_points")).where(F.col("n_points") >= min_points).drop("_island")


def bridge(df: DataFrame, flag: str, key: Sequence[str], order: Sequence[str], max_gap: int, name: str = "bridged") -> DataFrame:
    """Fills inner runs of false of at most max_gap rows; runs at the edges stay."""
    df = islands(df, flag, key, order, "_island")
    w = keyed(key, order)
    size = F.count("*").over(Window.partitionBy(*key, "_island"))
    last = F.max("_island").over(Window.partitionBy(*key))
    inner = (F.col("_island") > F.min("_island").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) & (F.col("_island") < last)
    return df.withColumn(name, F.col(flag) | (inner & (size <= max_gap))).drop("_island")


def k_of_n(flag: Column, w: WindowSpec, n: int, k: int) -> Column:
    """At least k true in the last n rows; false before there are n."""
    f = trailing(w, n)
    return (F.count(F.lit(1)).over(f) == n) & (F.sum(flag.cast("int")).over(f) >= k)


def episodes(df: DataFrame, key: Sequence[str], time: str, gap_seconds: float, min_minutes: float = 0.0, step_seconds: float = 0.0) -> DataFrame:
    """(key, episode, start, end, n): rows whose gap is at most gap + step belong together; short ones are dropped."""
    w = keyed(key, [time])
    late = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6 > gap_seconds + step_seconds
    numbered = df.withColumn("episode", F.sum(F.when(late, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*key, "episode").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
    return out.where((F.unix_micros("end") - F.unix_micros("start")) / 6e7 >= min_minutes)


def percent_rank_average(c: Column, key: Sequence[str]) -> Column:
    """Rank with ties averaged, over the number of values; null of null."""
    w = Window.partitionBy(*key).orderBy(c)
    ties = F.count(c).over(Window.partitionBy(*key, c))
    n = F.count(c).over(Window.partitionBy(*key))
    nulls = F.count(F.lit(1)).over(Window.partitionBy(*key)) - n
    return F.when(c.isNotNull(), (F.rank().over(w) - nulls + (ties - 1) / 2) / n)


def every_kth(df: DataFrame, key: Sequence[str], order: Sequence[str], k: Column | int) -> DataFrame:
    """The first of every k rows of a key."""
    return df.withColumn("_at", F.row_number().over(keyed(key, order)) - 1).where(F.col("_at") % k == 0).drop("_at")


def future_max(c: Column, w: WindowSpec, n: int) -> Column:
    return F.max(c).over(w.rowsBetween(0, n))


def neighbour_median(c: Column, w: WindowSpec, n: int = 3) -> Column:
    """Median of up to n rows before and n after, without the row itself; null of none."""
    around = F.concat(F.collect_list(c).over(w.rowsBetween(-n, -1)), F.collect_list(c).over(w.rowsBetween(1, n)))
    s = F.sort_array(around)
    size = F.size(s)
    low, high = F.get(s, F.floor((size - 1) / 2).cast("int")), F.get(s, F.floor(size / 2).cast("int"))
    return F.when(size > 0, (low + high) / 2)


def slope(c: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    """Least-squares slope over a frame, null with fewer than ``least`` values."""
    return F.when(F.count(c).over(frame) >= least, F.regr_slope(c, x).over(frame))


def segments(df: DataFrame, key: Sequence[str], time: str, sampling_minutes: float, factor: float = 1.5, name: str = "segment") -> DataFrame:
    """Numbers stretches without a gap over factor * sampling."""
    w = keyed(key, [time])
    gap = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 6e7 > factor * sampling_minutes
    return df.withColumn(name, F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fixed_windows(df: DataFrame, key: Sequence[str], order: str, values: Sequence[str], size: int, stride: int, valid: float = 0.98) -> DataFrame:
    """Windows of ``size`` rows, one every ``stride`` rows, with at least the valid share of values: (key, first, last, rows)."""
    w = keyed(key, [order])
    f = w.rowsBetween(0, size - 1)
    known = sum((F.count(v).over(f) for v in values), F.lit(0))
    out = df.select(*key, F.col(order).alias("first"), F.max(order).over(f).alias("last"), F.row_number().over(w).alias("_at"), F.count(F.lit(1)).over(f).alias("_n"), known.alias("_known"), F.collect_list(F.struct(*values)).over(f).alias("rows"))
    return out.where((F.col("_n") == size) & ((F.col("_at") - 1) % stride == 0) & (F.col("_known") >= valid * size * len(values))).drop("_at", "_n", "_known")


def interpolate(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str], name: str, otherwise: Column | None = None) -> DataFrame:
    """Linear by row position, edges extended, then ``otherwise``."""
    w = keyed(key, order)
    df = df.withColumn("_pos", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.col("_pos"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v0, p0 = F.last(value, True).over(back), F.last(at, True).over(back)
    v1, p1 = F.first(value, True).over(ahead), F.first(at, True).over(ahead)
    line = F.when(p0 == p1, v0).otherwise(v0 + (v1 - v0) * (F.col("_pos") - p0) / (p1 - p0))
    out = F.coalesce(F.col(value), line, v0, v1)
    return df.withColumn(name, out if otherwise is None else F.coalesce(out, otherwise)).drop("_pos")


def sampling_minutes(df: DataFrame, key: Sequence[str], time: str) -> DataFrame:
    """Median positive gap of each key, in minutes."""
    gap = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(keyed(key, [time])))) / 6e7
    return df.withColumn("_gap", gap).where("_gap > 0").groupBy(*key).agg(F.percentile("_gap", 0.5).alias("sampling_minutes"))


def dedup_time(df: DataFrame, key: Sequence[str], time: str, tie: Sequence[str], keep: str) -> DataFrame:
    """One row for each (key, time): the first or the last in the order of ``tie``."""
    by = [F.col(c) if keep == "first" else F.col(c).desc() for c in tie]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key, time).orderBy(*by))).where("_n = 1").drop("_n")


def ewma(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str], n: int, clip: float = 6.0) -> DataFrame:
    """Adds the mean and variance of a clipped exponential baseline after each row: (key, order, ewma_mean, ewma_var).

    The first value starts the mean, with variance 1. Then mean += a * clip(x - mean, +-clip * sd) and
    var = (1 - a) * var + a * (x - new mean)^2, with a = 2 / (n + 1). A recurrence over a key's rows in order: a carried
    fold with two numbers of state.
    """
    a = 2 / (n + 1)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    rows = df.select(*key, *order, F.col(value).cast("double").alias("_v"))
    return carried(rows, key, order, lambda: _Ewma(a, clip, list(order)), f"{schema}, ewma_mean double, ewma_var double")


class _Ewma:
    def __init__(self, a: float, clip: float, order: list[str]):
        self.a, self.clip, self.order = a, clip, order
        self.mean: float | None = None
        self.var = 1.0

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        m, v, a, clip = self.mean, self.var, self.a, self.clip
        means, variances = [], []
        for x in rows["_v"].to_numpy(float).tolist():
            if m is None:
                m = x
            else:
                sd = math.sqrt(v)
                m += a * max(-clip * sd, min(clip * sd, x - m))
                v = (1 - a) * v + a * (x - m) ** 2
            means.append(m)
            variances.append(v)
        self.mean, self.var = m, v
        return rows[self.order].assign(ewma_mean=means, ewma_var=variances)

    def end(self) -> None:
        return None


def hashed_rank(df: DataFrame, key: Sequence[str], ids: str, name: str = "_rank", seed: str = "") -> DataFrame:
    """Adds each row's rank within a key in the order of a digest of its id (ties by id), from 1.

    Rows are ranked within 256 ranges of the digest and the ranges' counts are added up, so a key with most of the rows
    is no single task.
    """
    digest = F.md5(F.concat(F.lit(seed), F.col(ids).cast("string")).cast("binary"))
    df = df.withColumns({"_digest": digest, "_part": F.substring(digest, 1, 2)})
    counts = df.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(keyed(key, ["_part"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_n")
    out = df.withColumn("_at", F.row_number().over(keyed([*key, "_part"], ["_digest", ids]))).join(counts, [*key, "_part"])
    return out.withColumn(name, (F.col("_at") + F.col("_before")).cast("bigint")).drop("_digest", "_part", "_at", "_before")


def single_precision(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as float; NaN and infinities become null. All columns in one projection, whatever their number."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return df.withColumns({c: finite(F.col(f"`{c}`").cast("float")) for c in columns})
