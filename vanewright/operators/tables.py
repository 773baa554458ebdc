"""Event-level tables: segment and timeline statistics, feature sets, evidence, streaming metrics, model choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import consensus, divide, hours_between, overlap_hours
from ..sources.shared import stored
from .intervals import bucketed_overlap, clip, merge, overlap_join
from .ranges import attach, touched


def event_hours(windows: DataFrame, segments: DataFrame, key: Sequence[str], ids: str, gap_seconds: float = 0.0) -> DataFrame:
    """(id, n_segments, n_merged, max_hours, total_hours) of segments (key, start, end) clipped to windows (key, id, w_start, w_end)."""
    j = overlap_join(windows, segments, key, ("w_start", "w_end"), ("start", "end"))
    m = merge(clip(j, "start", "end", "w_start", "w_end"), [ids], "start", "end", gap_seconds)
    h = hours_between(F.col("start"), F.col("end"))
    return m.groupBy(ids).agg(F.sum("n").alias("n_segments"), F.count("*").alias("n_merged"), F.max(h).alias("max_hours"), F.sum(h).alias("total_hours"))


def rejected_candidates(windows: DataFrame, segments: DataFrame, key: Sequence[str], ids: str, boundary_minutes: float = 20.0) -> DataFrame:
    """``event_hours`` of candidates that were not taken, and whether one ends within minutes of its window's end."""
    hours = event_hours(windows, segments, key, ids, boundary_minutes * 60)
    j = overlap_join(windows, segments, key, ("w_start", "w_end"), ("start", "end"))
    near = F.abs(F.unix_micros(F.least("end", "w_end")) - F.unix_micros("w_end")) <= int(boundary_minutes * 6e7)
    return hours.join(j.groupBy(ids).agg(F.bool_or(near).alias("touches_end")), ids)


def timeline_facts(windows: DataFrame, timeline: DataFrame, key: Sequence[str], ids: str) -> DataFrame:
    """(id, n_intervals, n_multi, max_active, mean_active, active_hours, coverage) of a timeline (key, start, end, n_active)."""
    j = clip(overlap_join(windows.withColumn("_h", hours_between(F.col("w_start"), F.col("w_end"))), timeline, key, ("w_start", "w_end"), ("start", "end")), "start", "end", "w_start", "w_end")
    h = F.sum(hours_between(F.col("start"), F.col("end")))
    return j.groupBy(ids).agg(F.count("*").alias("n_intervals"), F.count_if(F.col("n_active") >= 2).alias("n_multi"), F.max("n_active").alias("max_active"), F.avg("n_active").alias("mean_active"), h.alias("active_hours"), (h / F.first("_h")).alias("coverage"))


def model_features(df: DataFrame, hours: str, counts: Sequence[str], durations: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Adds rates for each day of counts, shares of the time of durations, log1p of both, and flags as 0 or 1."""
    days = F.col(hours) / 24
    out = {f"{c}_per_day": divide(F.col(c), days) for c in counts} | {f"{d}_share": divide(F.col(d), F.col(hours)) for d in durations}
    out |= {f"log_{c}": F.log1p(F.col(c)) for c in [*counts, *durations]} | {f: F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags}
    return df.withColumns(out)


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with two different values or more: those of nulls alone or one value are no features. One aggregation."""
    row = df.agg(*(F.min(c).alias(f"a{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"z{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if row[f"a{i}"] is not None and row[f"a{i}"] != row[f"z{i}"]]


def streaming_metrics(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row of streaming metrics over events (label, detected, delay_hours) and episodes (relation, hours)."""
    a = F.col("label") == 1
    d = F.col("detected")
    e = events.agg(F.count("*").alias("n_events"), F.count_if(a).alias("n_anomalies"), F.count_if(a & d).alias("n_detected"), F.count_if(~a & d).alias("n_normal_alerted"), F.percentile(F.when(a & d, F.col("delay_hours")), 0.5).alias("median_delay"), F.avg(F.when(a & d, F.col("delay_hours"))).alias("mean_delay"), F.count_if(a & d & (F.col("delay_hours") < 0)).alias("n_early"), F.count_if(a & d & (F.col("delay_hours") >= 0)).alias("n_late"))
    background = ~F.col("relation").startswith("overlap")
    x = episodes.agg(F.count("*").alias("n_episodes"), F.count_if(background).alias("n_background"), F.coalesce(F.sum(F.when(background, F.col("hours"))), F.lit(0.0)).alias("background_hours"))
    # both sides are one row
    return e.crossJoin(F.broadcast(x)).withColumns({"recall": divide(F.col("n_detected"), F.col("n_anomalies")), "false_positive_rate": divide(F.col("n_normal_alerted"), F.col("n_events") - F.col("n_anomalies"))})


def short_episodes(segments: DataFrame, key: Sequence[str], windows: DataFrame, ids: str, gap_seconds: float = 1200.0) -> DataFrame:
    """(id, episode, start, end, n, max_score, evidence) of short segments (key, start, end, score, recovery, variability,
    signals) clipped to windows and merged over gaps of 20 minutes.

    Evidence is direct recovery or variability where enough power signals agree, else it is unconfirmed.
    """
    j = clip(overlap_join(windows, segments, key, ("w_start", "w_end"), ("start", "end")), "start", "end", "w_start", "w_end")
    w = Window.partitionBy(ids).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.unix_micros("start") > F.unix_micros(reach) + int(gap_seconds * 1e6), F.lit(True))
    need = consensus(F.col("signals"))
    rows = j.withColumns({"_fresh": fresh.cast("int"), "_r": (need > 0) & (F.col("recovery") >= need), "_v": (need > 0) & (F.col("variability") >= need)})
    rows = rows.withColumn("episode", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(ids, "episode").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("score").alias("max_score"), F.bool_or("_r").alias("_r"), F.bool_or("_v").alias("_v"))
    return out.withColumn("evidence", F.when(F.col("_r"), "direct_recovery").when(F.col("_v"), "variability").otherwise("unconfirmed")).drop("_r", "_v")


def display_timeline(segments: DataFrame, key: Sequence[str], inner: str, outer: str) -> DataFrame:
    """Segments (key, start, end, name) without those named ``inner`` that lie in one named ``outer``."""
    rows = segments.withColumn("_id", F.monotonically_increasing_id())
    o = segments.where(F.col("name") == outer).select(*(F.col(k).alias(f"_{k}") for k in key), F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("start") >= F.col("_s"), F.col("end") <= F.col("_e")]
    return rows.where(F.col("name") != inner).union(rows.where(F.col("name") == inner).join(o, inside, "left_anti")).drop("_id")


def contributions(df: DataFrame, ids: str, weights: dict[str, float], n: int) -> DataFrame:
    """(id, feature, contribution, rank): each row's n strongest contributions (weight times scaled value), up or down.

    The weights are a fitted model's, one for each feature; a null value contributes nothing.
    """
    parts = F.array(*(F.struct(F.lit(f).alias("feature"), (F.coalesce(F.col(f), F.lit(0.0)) * w).alias("contribution")) for f, w in weights.items()))
    ordered = F.array_sort(parts, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return df.select(ids, F.posexplode(F.slice(ordered, 1, n)).alias("_at", "_x")).select(ids, "_x.feature", "_x.contribution", (F.col("_at") + 1).alias("rank"))


def choose_model(comparison: DataFrame, model: str, score: str, preferred: str, tolerance: float) -> DataFrame:
    """The best model by score (ties by name), or the preferred one if it is within the tolerance. A comparison has one
    row for each model."""
    best = comparison.agg(F.max(F.struct(F.col(score).alias("s"), F.col(model).alias("m"))).alias("top"), F.max(F.when(F.col(model) == preferred, F.col(score))).alias("p"))
    return best.select(F.when(F.col("top.s") - F.col("p") <= tolerance, preferred).otherwise(F.col("top.m")).alias("chosen"), F.col("top.m").alias("best"))


def early_warning_report(df: DataFrame) -> DataFrame:
    """One row over events (label, within_7, within_14, within_30, lead_days): recall by horizon, specificity and lead."""
    a = F.col("label") == 1
    share = lambda hit, of: divide(F.count_if(hit & of), F.count_if(of))
    return df.agg(*(share(F.col(f"within_{d}"), a).alias(f"recall_{d}") for d in (7, 14, 30)), share(~F.col("within_30"), ~a).alias("specificity"), share(F.col("within_30"), ~a).alias("false_alert_rate"), F.percentile(F.when(a & F.col("within_30"), F.col("lead_days")), 0.5).alias("median_lead"))


def power_signature(df: DataFrame, key: Sequence[str], order: str, value: str, n: int = 3) -> DataFrame:
    """Adds local_dip (under the median of n rows on both sides), previous_drop, next_recovery, range_change and
    std_change (n rows after against n rows before)."""
    w = Window.partitionBy(*key).orderBy(order)
    v = F.col(value)
    before, after = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
    mid = (F.percentile(v, 0.5).over(before) + F.percentile(v, 0.5).over(after)) / 2
    spread = lambda f: F.max(v).over(f) - F.min(v).over(f)
    return df.withColumns({"local_dip": mid - v, "previous_drop": F.lag(v).over(w) - v, "next_recovery": F.lead(v).over(w) - v, "range_change": spread(after) - spread(before), "std_change": F.stddev_pop(v).over(after) - F.stddev_pop(v).over(before)})


def scoped_overlap(left: DataFrame, right: DataFrame, key: Sequence[str], l_range: tuple[str, str], r_range: tuple[str, str], farm: str, source: str, wanted: Column, wanted_farm: Column, ids: Sequence[str], bucket_seconds: int) -> DataFrame:
    """Pairs of the closed overlap join, scoped by ``ids`` of the left: to the same farm if any pair matches it, then to
    the same source; pairs without a source at all stay where none has one.

    Which scope holds is found out first, by sweeps that make no pairs (``touched``); the farm and the source then are
    part of the join's equality, so only pairs that stay are made.
    """
    named = F.col(source) != ""
    of_farm = left.select(*key, *ids, *l_range, wanted_farm.alias(farm))
    scope = touched(of_farm, right, [*key, farm], l_range, r_range, ids, {"_farm": F.lit(True), "_named": named})
    scope = stored(scope.groupBy(*ids).agg(F.bool_or("_farm").alias("_farm"), F.bool_or("_named").alias("_named")), "scope")
    strange = scope.where("not _farm").select(*ids)
    if not strange.isEmpty():
        others = touched(attach(left, strange, ids), right, key, l_range, r_range, ids, {"_any": named}).groupBy(*ids).agg(F.bool_or("_any").alias("_any"))
        scope = stored(attach(scope, others, ids, "left").select(*ids, "_farm", F.when(F.col("_farm"), F.col("_named")).otherwise(F.col("_any")).alias("_named")), "scope")
    kinds = [tuple(r) for r in scope.select("_farm", "_named").distinct().collect()] or [(True, True)]  # four at most
    parts = []
    for in_farm, with_source in kinds:
        own = ({farm: wanted_farm} if in_farm else {}) | ({source: wanted} if with_source else {})
        l = attach(left, scope.where((F.col("_farm") == in_farm) & (F.col("_named") == with_source)).select(*ids), ids).withColumns(own)
        r = right if with_source else right.where(F.coalesce(~named, F.lit(True)))
        parts.append(bucketed_overlap(l, r, [*key, *own], l_range, r_range, bucket_seconds).select(*left.columns, *(c for c in right.columns if c not in key)))
    return reduce(DataFrame.union, parts)


def overlap_share(s: Column, e: Column, a: Column, z: Column) -> Column:
    """Share of [a, z] that [s, e] covers."""
    return divide(overlap_hours(s, e, a, z), hours_between(a, z), 0.0)
