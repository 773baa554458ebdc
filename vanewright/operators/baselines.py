"""Dual baselines, recovery after events, boundary power, control states, transition and state scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import centred, episodes, k_of_n, keyed, rolling, trailing
from .ranges import attach
from .stats import robust_scale


def dual_baseline(df: DataFrame, key: Sequence[str], order: str, mode: str, value: str, reference: Column, window: int, least_dynamic: int, least_mode: int, level: float) -> DataFrame:
    """Adds fixed_z, dynamic_z and the flags fixed, dynamic and dual.

    The fixed baseline is the mode's reference rows, or the key's where the mode has too few. The dynamic one is the
    median and IQR of the rows of the same mode among the ``window`` rows before; rows of other modes count as missing.
    """
    by_mode = robust_scale(df.where(reference), [*key, mode], value).select(*key, mode, F.col("n").alias("_n"), F.col("centre").alias("_cm"), F.col("scale").alias("_sm"))
    overall = robust_scale(df.where(reference), key, value).select(*key, F.col("centre").alias("_cg"), F.col("scale").alias("_sg"))
    out = df.join(by_mode, [*key, mode], "left").join(overall, list(key), "left")
    enough = F.coalesce(F.col("_n") >= least_mode, F.lit(False)) & F.col("_sm").isNotNull()
    centre, scale = F.when(enough, F.col("_cm")).otherwise(F.col("_cg")), F.when(enough, F.col("_sm")).otherwise(F.col("_sg"))
    out = out.withColumn("fixed_z", F.abs(F.col(value) - centre) / scale)
    # one frame for each mode over all rows: values of the other modes are null in it
    modes = Window.partitionBy(*key, mode).orderBy("_pos").rangeBetween(-window, -1)
    out = out.withColumn("_pos", F.row_number().over(keyed(key, [order])))
    q = lambda p: F.percentile(value, p).over(modes)
    iqr = (q(0.75) - q(0.25)) / 1.349
    out = out.withColumn("dynamic_z", F.when((F.count(value).over(modes) >= least_dynamic) & (iqr > 1e-9), F.abs(F.col(value) - q(0.5)) / iqr))
    fixed, dynamic = (F.coalesce(F.col(c) >= level, F.lit(False)) for c in ("fixed_z", "dynamic_z"))
    return out.withColumns({"fixed": fixed, "dynamic": dynamic, "dual": fixed & dynamic}).drop("_n", "_cm", "_sm", "_cg", "_sg", "_pos")


def recovery(df: DataFrame, key: Sequence[str], order: str, flag: str, in_event: Column, after: Column, tail: int = 3, run: int = 3) -> DataFrame:
    """(key, tail_active, tail_share, post_share, recovered_at): how a flag ends. Recovery is the first of ``run`` rows
    without the flag in a row after the event; an event whose last rows are all active is open."""
    last = df.where(in_event).withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where(F.col("_k") <= tail)
    ends = last.groupBy(*key).agg(F.avg(F.col(flag).cast("double")).alias("tail_share"), (F.count_if(flag) >= F.ceil(F.count("*") * 0.67)).alias("tail_active"))
    w = keyed(key, [order])
    ahead = w.rowsBetween(0, run - 1)
    quiet = (F.sum(F.col(flag).cast("int")).over(ahead) == 0) & (F.count(F.lit(1)).over(ahead) == run)
    post = df.where(after).withColumn("_quiet", quiet).groupBy(*key).agg(F.avg(F.col(flag).cast("double")).alias("post_share"), F.min(F.when(F.col("_quiet"), F.col(order))).alias("recovered_at"))
    return ends.join(post, list(key), "left")


def boundary_power(segments: DataFrame, signals: DataFrame, key: Sequence[str], order: str, before: int = 6, near: int = 2, after: int = 6, drop: float = 0.5, back: float = 0.7, need: float = 0.75) -> DataFrame:
    """Segments (key, segment, first, last as row numbers) with power evidence at both ends: (key, segment, n_signals, n_drop, n_back, confirmed).

    Signals are (key, base, pos, value). The baseline is the median of the rows before the start, the low the minimum
    within ``near`` rows of it, the recovery the median after the end.
    """
    j = signals.join(segments.withColumnsRenamed({k: f"_{k}" for k in key}), [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("pos").between(F.col("first") - before, F.col("last") + after)])
    p = F.col("pos")
    band = lambda c: F.when(c, F.col("value"))
    per = j.groupBy(*key, "segment", "base").agg(F.percentile(band(p < F.col("first")), 0.5).alias("_base"), F.min(band(p.between(F.col("first") - near, F.col("first") + near))).alias("_low"), F.percentile(band(p > F.col("last")), 0.5).alias("_after"))
    drops = F.coalesce((F.col("_base") > 0) & (F.col("_low") <= drop * F.col("_base")), F.lit(False))
    backs = F.coalesce(F.col("_after") >= back * F.col("_base"), F.lit(False))
    out = per.groupBy(*key, "segment").agg(F.count("*").alias("n_signals"), F.count_if(drops).alias("n_drop"), F.count_if(drops & backs).alias("n_back"))
    least = F.ceil(F.col("n_signals") * need)
    return out.withColumn("confirmed", (F.col("n_drop") >= least) & (F.col("n_back") >= least))


def transition_score(df: DataFrame, key: Sequence[str], order: str, fraction: str, top: str, n: int = 6, level: float = 0.10) -> DataFrame:
    """Adds rolling_fraction, transition_score = rolling fraction * (1 + log1p(top mean z)) and its flag."""
    f = F.avg(fraction).over(trailing(keyed(key, [order]), n))
    return df.withColumn("rolling_fraction", f).withColumns({"transition_score": F.col("rolling_fraction") * (1 + F.log1p(top)), "transition_flag": F.col("rolling_fraction") >= level})


def state_score(df: DataFrame, key: Sequence[str], order: str, fraction: str, top: str, n: int = 6) -> DataFrame:
    """Adds state_score: the centred rolling median of fraction + 0.01 * top mean."""
    raw = df.withColumn("_raw", F.col(fraction) + 0.01 * F.col(top))
    return raw.withColumn("state_score", rolling(F.col("_raw"), centred(keyed(key, [order]), n), "median")).drop("_raw")


def comparison_scale(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """(key, scale): max(median |step|, 1 % of the p05-p95 range, 1e-6 * max(|median|, 1)); 1 where that is no number."""
    step = F.abs(F.col(value) - F.lag(value).over(keyed(key, [order])))
    s = df.withColumn("_d", step).groupBy(*key).agg(F.percentile("_d", 0.5).alias("_m"), F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q"))
    scale = F.greatest("_m", 0.01 * (F.col("_q")[2] - F.col("_q")[0]), 1e-6 * F.greatest(F.abs(F.col("_q")[1]), F.lit(1.0)))
    return s.select(*key, F.coalesce(F.when(scale > 0, scale), F.lit(1.0)).alias("scale"))


def exclusion_hull(df: DataFrame, key: Sequence[str], time: str, label: str, buffer_hours: float) -> DataFrame:
    """Drops rows of label 0 within one hull around all positive rows of a key, widened by the buffer."""
    w = Window.partitionBy(*key)
    pos = F.when(F.col(label) == 1, F.unix_micros(time))
    b = int(buffer_hours * 3.6e9)
    near = F.unix_micros(time).between(F.min(pos).over(w) - b, F.max(pos).over(w) + b)
    return df.withColumn("_near", F.coalesce(near, F.lit(False))).where((F.col(label) == 1) | ~F.col("_near")).drop("_near")


def annotate(rows: DataFrame, meta: DataFrame, key: Sequence[str], time: str, start: str, end: str, order: str, values: Sequence[str]) -> DataFrame:
    """Rows with the values of the interval that holds them; of several, the last in order. Rows outside get nulls."""
    m = meta.withColumnsRenamed({k: f"_{k}" for k in key})
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col(time).between(F.col(start), F.col(end))]
    j = rows.join(m, on, "left").drop(*(f"_{k}" for k in key))
    group = [c for c in rows.columns]
    return j.groupBy(*group).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*group, *(F.col("_v")[v].alias(v) for v in values))


def calibrated_threshold(df: DataFrame, key: Sequence[str], time: str, score: str, local: str, grid: Sequence[float], target: float, episodes_30d: float, smooth: int = 3, least_local: int = 2, lookback: int = 6, positive: int = 3, gap_seconds: float = 3600.0) -> DataFrame:
    """(key, q, threshold, far, episodes_30d, met): the least strict quantile of the scores whose warnings stay within both
    false-alarm limits, else the strictest.

    A warning is decided as online: the trailing median of the scores is over the threshold, at least ``least_local``
    signals are over their own (``local`` counts them), and ``positive`` of the last ``lookback`` rows are so. Its share of
    the rows and its episodes in 30 days (rows up to ``gap_seconds`` apart are one) are limited. The grid is extended by
    1 - target and clipped to [0.5, 0.9999].
    """
    qs = sorted({min(max(q, 0.5), 0.9999) for q in (*grid, 1.0 - target)})
    smoothed = df.withColumn("_s", rolling(F.col(score), trailing(keyed(key, [time]), smooth), "median"))
    cuts = df.groupBy(*key).agg(F.percentile(score, F.array(*map(F.lit, qs))).alias("_c"), F.greatest(F.lit(1e-9), (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 8.64e10).alias("_days"))
    cuts = cuts.select(*key, "_days", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("_c").alias("threshold"))).alias("_z")).select(*key, "_days", "_z.q", "_z.threshold")
    rows = attach(smoothed.select(*key, time, "_s", local), cuts, key)
    rows = rows.withColumn("_hit", F.coalesce((F.col("_s") > F.col("threshold")) & (F.col(local) >= least_local), F.lit(False)))
    rows = rows.withColumn("_on", k_of_n(F.col("_hit"), keyed([*key, "q"], [time]), lookback, positive))
    far = rows.groupBy(*key, "q", "threshold", "_days").agg(F.avg(F.col("_on").cast("double")).alias("far"))
    warned = episodes(rows.where("_on"), [*key, "q"], time, gap_seconds).groupBy(*key, "q").agg(F.count("*").alias("_n"))
    out = attach(far, warned, [*key, "q"], "left").withColumn("episodes_30d", F.coalesce("_n", F.lit(0)) * 30.0 / F.col("_days"))
    out = out.withColumn("met", (F.col("far") <= target) & (F.col("episodes_30d") <= episodes_30d))
    order = Window.partitionBy(*key).orderBy(F.when(F.col("met"), F.col("q")).otherwise(F.lit(3.0) - F.col("q")))
    return out.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*key, "q", "threshold", "far", "episodes_30d", "met")
