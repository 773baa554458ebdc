"""Offline row detectors on long tables (key, t, base, stat, value): scores, flags, segments, confidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import bridge, centred, islands, keyed, percent_rank_average, rolling, true_ranges
from .stats import adaptive_threshold, robust_z


@dataclass(frozen=True)
class DetectorConfig:
    """Levels of the offline detectors."""

    short_level: float = 8.0
    short_floor: float = 0.05
    persistent_level: float = 12.0
    persistent_floor: float = 0.45
    persistent_points: int = 6
    cluster_points: int = 12
    cluster_least: int = 2
    quantile: float = 0.995
    top: int = 10
    bridge_points: int = 2
    min_points: int = 2
    active_level: float = 8.0
    coverage_points: int = 6
    coverage_least: float = 0.6
    localized_least: int = 3
    overlap_least: float = 0.4
    overlap_points: int = 3
    strength_points: int = 3
    strength_floor: float = 8.0


def base_z(long: DataFrame, reference: Column, key: Sequence[str], order: str) -> DataFrame:
    """(key, order, base, z): the largest robust z of a base signal's statistics in each row, 0 without a scale."""
    z = robust_z(long, reference, [*key, "base", "stat"], "value")
    return z.groupBy(*key, order, "base").agg(F.max(F.coalesce("z", F.lit(0.0))).alias("z"))


def row_scores(z: DataFrame, key: Sequence[str], order: str, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(key, order, n, frac_short, frac_persistent, top_mean, z_max, active) from base z."""
    zs = F.sort_array(F.collect_list("z"), asc=False)
    out = z.groupBy(*key, order).agg(F.count("*").alias("n"), F.count_if(F.col("z") >= cfg.short_level).alias("_s"), F.count_if(F.col("z") >= cfg.persistent_level).alias("_p"), F.slice(zs, 1, cfg.top).alias("_top"), F.max("z").alias("z_max"), F.array_sort(F.collect_set(F.when(F.col("z") >= cfg.active_level, F.col("base")))).alias("active"))
    return out.select(*key, order, "n", (F.col("_s") / F.col("n")).alias("frac_short"), (F.col("_p") / F.col("n")).alias("frac_persistent"), (F.aggregate("_top", F.lit(0.0), lambda a, x: a + x) / F.size("_top")).alias("top_mean"), "z_max", "active")


def detect(scores: DataFrame, key: Sequence[str], order: str, reference: Column, in_event: Column, confirmed: Column, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Adds the short, intermittent and persistent flags with their thresholds, and the composite rank.

    The persistent threshold is the quantile of a smoothing of the reference rows alone, whereas the scored series is
    smoothed over all rows.
    """
    w = keyed(key, [order])
    short = adaptive_threshold(scores, key, "frac_short", cfg.quantile, cfg.short_floor, reference).withColumnRenamed("threshold", "short_threshold")
    ref = scores.where(reference).withColumn("_smooth", rolling(F.col("frac_persistent"), centred(w, cfg.persistent_points), "mean"))
    persistent = adaptive_threshold(ref, key, "_smooth", cfg.quantile, cfg.persistent_floor, F.lit(True)).withColumnRenamed("threshold", "persistent_threshold")
    out = scores.join(short, list(key)).join(persistent, list(key), "left").withColumn("persistent_threshold", F.coalesce("persistent_threshold", F.lit(cfg.persistent_floor)))
    out = out.withColumns({"short_flag": (F.col("frac_short") >= F.col("short_threshold")) & confirmed & in_event, "smooth_persistent": rolling(F.col("frac_persistent"), centred(w, cfg.persistent_points), "mean")})
    out = out.withColumns({"short_count": F.sum(F.col("short_flag").cast("int")).over(centred(w, cfg.cluster_points)), "persistent_flag": (F.col("smooth_persistent") >= F.col("persistent_threshold")) & in_event})
    return out.withColumn("intermittent_flag", (F.col("short_count") >= cfg.cluster_least) & in_event)


def composite_rank(df: DataFrame, key: Sequence[str], values: Sequence[str], name: str = "detector_score") -> DataFrame:
    """Adds the mean of the values' percentile ranks (ties averaged)."""
    ranks = {f"_r{i}": percent_rank_average(F.col(v), key) for i, v in enumerate(values)}
    df = df.withColumns(ranks)
    return df.withColumn(name, sum((F.coalesce(c, F.lit(0.0)) for c in ranks), F.lit(0.0)) / len(ranks)).drop(*ranks)


def stable_core(z: DataFrame, key: Sequence[str], order: str, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(key, order, n_active, n_stable): active signals, and those active in most rows around."""
    w = Window.partitionBy(*key, "base").orderBy(order)
    active = F.col("z") >= cfg.active_level
    cover = F.avg(active.cast("double")).over(centred(w, cfg.coverage_points))
    return z.withColumns({"_a": active, "_c": cover}).groupBy(*key, order).agg(F.count_if("_a").alias("n_active"), F.count_if(F.col("_c") >= cfg.coverage_least).alias("n_stable"))


def power_evidence(signals: DataFrame, key: Sequence[str], order: str, dip: float = 0.5, recovery: float = 0.7, need: float = 0.75) -> DataFrame:
    """Dip and recovery consensus of power signals (key, order, base, value): (key, order, n_signals, n_dip, n_recovery, confirmed).

    The reference is the median of the six rows before; a dip falls under a share of it, the next row recovers over
    another share. Both need the agreement of ceil(need * signals).
    """
    w = Window.partitionBy(*key, "base").orderBy(order)
    before = w.rowsBetween(-6, -1)
    ref = F.when(F.count("value").over(before) >= 3, F.percentile("value", 0.5).over(before))
    rows = signals.withColumns({"_ref": ref, "_next": F.lead("value").over(w)})
    rows = rows.withColumns({"_dip": F.coalesce((F.col("_ref") > 0) & (F.col("value") <= dip * F.col("_ref")), F.lit(False)), "_rec": F.coalesce(F.col("_next") >= recovery * F.col("_ref"), F.lit(False))})
    out = rows.groupBy(*key, order).agg(F.count("*").alias("n_signals"), F.count_if("_dip").alias("n_dip"), F.count_if(F.col("_dip") & F.col("_rec")).alias("n_recovery"))
    least = F.ceil(F.col("n_signals") * need)
    return out.withColumn("confirmed", (F.col("n_dip") >= least) & (F.col("n_recovery") >= least))


def flag_segments(df: DataFrame, flag: str, key: Sequence[str], order: str, score: str, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(key, segment, first, last, n_points, peak_score, peak_at, peak...): bridged runs of a flag of min_points or more."""
    bridged = bridge(df, flag, key, [order], cfg.bridge_points, "_b")
    runs = islands(bridged, "_b", key, [order], "_i").where("_b")
    seg = runs.groupBy(*key, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_points"), F.max(score).alias("peak_score"), F.max_by(order, F.struct(F.col(score), -F.unix_micros(order))).alias("peak_at"))
    seg = seg.where(F.col("n_points") >= cfg.min_points)
    return seg.withColumn("segment", F.row_number().over(keyed(key, ["first"]))).drop("_i")


def confidence(detector: Column, power: Column, count: Column, least: Column, overlap: Column, core: Column, strength: Column, fraction: Column, threshold: Column, strength_threshold: Column, overlap_least: float = 0.4, overlap_high: float = 0.60) -> Column:
    """Bands of a segment's confidence, one rule for each detector.

    Short stops: full power evidence (dip, recovery and both within the window). Clusters: the largest count against
    the least count. Localized: mean overlap, stable core against ``threshold``, and strength. Others: the largest
    smoothed fraction against ``threshold``. Multiples of a threshold are decimal: 1.5 times 0.4 is 0.6, where the product
    of the doubles lies next to it.
    """
    times = lambda factor, c: F.round(factor * c, 12)
    short = F.when(power, "Very High").otherwise("High")
    cluster = F.when(count >= 2.0 * least, "High").when(count >= 1.5 * least, "Medium-High").otherwise("Medium")
    local = F.when((overlap >= overlap_high) & (core >= times(1.25, threshold)) & (strength >= times(1.5, strength_threshold)), "High").when(overlap >= overlap_least, "Medium-High").otherwise("Medium")
    other = F.when(fraction >= times(1.5, threshold), "High").when(fraction >= times(1.2, threshold), "Medium-High").otherwise("Medium")
    return F.when(detector == "short_standstill", short).when(detector == "intermittent_cluster", cluster).when(detector == "localized_persistent_subsystem_state", local).otherwise(other)


def localized(z: DataFrame, key: Sequence[str], order: str, reference: Column, in_event: Column, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(key, order, n_active, n_stable, overlap, strength, core_threshold, strength_threshold, raw, localized) from base z.

    A localized state: enough active signals, a stable core of signals that are active in most rows around (at least
    the quantile of the reference rows), active sets that stay alike, and a strength of the strongest signals over the
    quantile of the reference rows smoothed by themselves.
    """
    w = Window.partitionBy(*key, "base").orderBy(order)
    around, active = centred(w, cfg.coverage_points), F.col("z") >= cfg.active_level
    least = max(2, -(-cfg.coverage_points // 2))
    cover = F.when(F.count(F.lit(1)).over(around) >= least, F.avg(active.cast("double")).over(around))
    zs = F.slice(F.sort_array(F.collect_list("z"), asc=False), 1, cfg.localized_least)
    rows = z.withColumns({"_a": active, "_c": cover}).groupBy(*key, order).agg(F.count_if("_a").alias("n_active"), F.count_if(F.col("_c") >= cfg.coverage_least).alias("n_stable"), F.collect_set(F.when(F.col("_a"), F.col("base"))).alias("_set"), zs.alias("_top"))
    t = keyed(key, [order])
    before = F.lag("_set").over(t)
    union = F.size(F.array_union("_set", before))
    overlap = F.coalesce(F.when(union > 0, F.size(F.array_intersect("_set", before)) / union), F.lit(0.0))
    rows = rows.withColumns({"_overlap": overlap, "_strength": F.aggregate("_top", F.lit(0.0), lambda s, x: s + x) / F.size("_top")})
    smooth = lambda c, n: F.avg(c).over(centred(t, n))
    core = rows.where(reference).groupBy(*key).agg(F.ceil(F.percentile("n_stable", cfg.quantile)).alias("_core"))
    ref = rows.where(reference).withColumn("_s", smooth("_strength", cfg.strength_points))
    strength = adaptive_threshold(ref, key, "_s", cfg.quantile, cfg.strength_floor, F.lit(True)).withColumnRenamed("threshold", "strength_threshold")
    out = rows.withColumns({"overlap": smooth("_overlap", cfg.overlap_points), "strength": smooth("_strength", cfg.strength_points)}).join(core, list(key), "left").join(strength, list(key), "left")
    out = out.withColumn("core_threshold", F.greatest(F.lit(cfg.localized_least), F.coalesce("_core", F.lit(0))).cast("int"))
    raw = (F.col("n_active") >= cfg.localized_least) & (F.col("n_stable") >= F.col("core_threshold")) & (F.col("overlap") >= cfg.overlap_least) & (F.col("strength") >= F.coalesce("strength_threshold", F.lit(cfg.strength_floor)))
    return out.withColumns({"raw": raw, "localized": raw & in_event}).drop("_set", "_top", "_overlap", "_strength", "_core")


def operating_mode(ratio: Column, stopped: float = 0.03, generating: float = 0.15) -> Column:
    """Offline modes: bounds belong to the outer modes."""
    return F.when(ratio.isNull(), "unknown").when(ratio <= stopped, "stopped").when(ratio >= generating, "generating").otherwise("transition")


def debounced(df: DataFrame, mode: str, key: Sequence[str], order: str, n: int = 3, name: str = "accepted") -> DataFrame:
    """Adds the last mode that was proposed n times in a row."""
    w = keyed(key, [order])
    runs = islands(df, mode, key, [order], "_i")
    at = F.row_number().over(keyed([*key, "_i"], [order]))
    return runs.withColumn("_at", at).withColumn(name, F.last(F.when(F.col("_at") >= n, F.col(mode)), True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_at")


__all__ = ["DetectorConfig", "base_z", "composite_rank", "confidence", "debounced", "detect", "flag_segments", "localized", "operating_mode", "power_evidence", "row_scores", "stable_core", "true_ranges"]
