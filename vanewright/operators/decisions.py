"""Decision cascades: event level, two and three sources, priorities, relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventLimits:
    """Limits of the event decision (fixed values): hours, counts and shares of the event's time."""

    persistent_longest: float = 2.0
    persistent_total: float = 4.0
    localized_longest: float = 1.0
    short_2h: int = 4
    short_24h: int = 6
    strong_clusters: int = 2
    short_episodes: int = 8
    coverage: float = 0.03
    transient_coverage: float = 0.005
    review_2h: tuple[int, int] = (2, 3)
    review_24h: tuple[int, int] = (3, 5)
    rejected_longest: float = 2.0


def event_decision(df: DataFrame, limits: EventLimits = EventLimits()) -> DataFrame:
    """Adds decision, status, level (3 to 0), manual_review, paths and reasons from event features.

    Columns: short_count, max_short_2h, max_short_24h, strong_clusters, persistent_longest, persistent_total,
    persistent_segments, localized_longest, localized_segments, coverage, n_families, rejected_longest, censored.

    An anomaly (level 3) needs one of four ways: persistent (longest or total hours), localized (longest hours),
    repeated short stops (density in 2 or 24 hours, or several strong clusters of many episodes), or coverage by two
    families with a state segment among them. A review (level 2, not an anomaly) takes medium density, one strong
    cluster, medium coverage, a long rejected localized candidate or censoring. Else there are transients (1) or nothing.
    """
    n = limits
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    persistent = (c("persistent_longest") >= n.persistent_longest) | (c("persistent_total") >= n.persistent_total)
    localized = c("localized_longest") >= n.localized_longest
    density = (c("max_short_2h") >= n.short_2h) | (c("max_short_24h") >= n.short_24h)
    repeated = density | ((c("strong_clusters") >= n.strong_clusters) & (c("short_count") >= n.short_episodes))
    multi = (c("coverage") >= n.coverage) & (c("n_families") >= 2) & ((c("persistent_segments") > 0) | (c("localized_segments") > 0))
    censored = F.coalesce(F.col("censored"), F.lit(False))
    paths = F.concat_ws(";", F.when(persistent, "persistent_system_state"), F.when(localized, "localized_persistent_state"), F.when(repeated, "repeated_short_standstill"))
    n_paths = persistent.cast("int") + localized.cast("int") + repeated.cast("int")
    anomaly = (n_paths > 0) | multi
    medium = c("max_short_2h").between(*n.review_2h) | c("max_short_24h").between(*n.review_24h)
    one = c("strong_clusters") == 1
    some = (c("coverage") >= n.transient_coverage) & (c("coverage") < n.coverage)
    rejected = c("rejected_longest") >= n.rejected_longest
    review = medium | one | some | rejected | censored
    status = F.when(anomaly & ((n_paths >= 2) | multi), "anomaly_multi_detector").when(anomaly, F.concat(F.lit("anomaly_"), paths)).when(review, "review_required").when(c("short_count") > 0, "normal_with_transients").otherwise("normal")
    of_anomaly = F.concat_ws(";", F.when(persistent, "persistent"), F.when(localized, "localized"), F.when(repeated, "repeated_short"), F.when(multi, "coverage"), F.when(censored, "censored"))
    of_review = F.concat_ws(";", F.when(medium, "medium_density"), F.when(one, "one_cluster"), F.when(some, "medium_coverage"), F.when(rejected, "rejected_localized"), F.when(censored, "censored"))
    return df.withColumns({
        "status": status, "decision": F.when(anomaly, "anomaly").otherwise("normal"), "level": F.when(anomaly, 3).when(review, 2).when(c("short_count") > 0, 1).otherwise(0), "manual_review": F.when(anomaly, censored).otherwise(review),
        "paths": F.when(anomaly, paths).otherwise(""), "reasons": F.when(anomaly, of_anomaly).when(review, of_review).otherwise(""),
    })


def stream_pattern(n_overlap: Column, operational: Column, meaningful: Column, n_before: Column, n_after: Column, fragmented: int = 3) -> Column:
    """The pattern of a window's alert episodes, by tier and counts."""
    return (
        F.when(operational & (n_overlap >= fragmented), "operational_fragmented").when(operational, "operational_concentrated").when(meaningful, "meaningful_late_or_untimely")
        .when(n_overlap > 0, "weak_overlap_only").when(n_before > 0, "pre_window_alert_only").when(n_after > 0, "post_window_alert_only").otherwise("no_qualifying_episode")
    )


def episode_relation(start: Column, end: Column, m_start: Column, m_end: Column, label: Column) -> Column:
    """How an alert episode lies to its source's logged interval; background without one, or where they only touch."""
    overlap = F.greatest(F.lit(0), F.unix_micros(F.least(end, m_end)) - F.unix_micros(F.greatest(start, m_start))) > 0
    return F.when(m_start.isNull(), "background").when(overlap & (label == "anomaly"), "overlap_anomaly").when(overlap, "overlap_normal").when(end < m_start, "before_metadata").when(start > m_end, "after_metadata").otherwise("background")


def dual_relation(offline: Column, stream: Column) -> Column:
    """How two sources relate: agreement, one-sided evidence, or review, by their decisions."""
    return (
        F.when((offline == "anomaly") & (stream == "anomaly"), "confirmed_by_both")
        .when((offline == "anomaly") & (stream == "review"), "offline_with_weak_stream")
        .when((offline == "review") & (stream == "anomaly"), "stream_with_weak_offline")
        .when((offline == "anomaly") & (stream == "normal"), "offline_only")
        .when((offline == "normal") & (stream == "anomaly"), "stream_only")
        .when((offline == "review") & (stream == "review"), "weak_in_both")
        .when((offline == "review") & (stream == "normal"), "weak_offline_only")
        .when((offline == "normal") & (stream == "review"), "weak_stream_only")
        .when((offline == "normal") & (stream == "normal"), "normal_in_both")
        .otherwise("unknown")
    )


def three_source_fusion(offline: Column, stream: Column, early_available: Column, early_warning: Column) -> Column:
    """anomaly, review_required or normal. Never a majority vote: an anomaly needs the offline source and one more,
    normality needs that early-warning evidence was available, and all else is reviewed."""
    strong = (offline == "anomaly") & ((stream == "anomaly") | (early_available & early_warning))
    quiet = (offline == "normal") & (stream == "normal") & early_available & ~early_warning
    return F.when(F.coalesce(strong, F.lit(False)), "anomaly").when(F.coalesce(quiet, F.lit(False)), "normal").otherwise("review_required")


def offlog_priority(intensity: Column, hours: Column, n_families: Column, support: Column, distance_hours: Column, targeted_only: Column, censored: Column) -> Column:
    """Weighted score of a candidate outside the log, 0 to 1; targeted-only and censored ones are discounted."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = 0.35 * unit(intensity) + 0.20 * unit(F.log1p(hours) / F.log1p(F.lit(24.0))) + 0.20 * unit(n_families / 4.0) + 0.20 * unit(F.log1p(support) / F.log1p(F.lit(100.0))) + 0.05 * unit(distance_hours / 168.0)
    return unit(score * F.when(targeted_only, 0.65).otherwise(1.0) * F.when(censored, 0.90).otherwise(1.0))


def alert_score(scores: list[tuple[Column, float]], families: Column) -> Column:
    """The largest weighted score; two or more independent families lift it to at least min(1, 0.55 + 0.2 k)."""
    best = F.greatest(*(F.coalesce(s, F.lit(0.0)) * w for s, w in scores))
    return F.when(families >= 2, F.greatest(best, F.least(F.lit(1.0), 0.55 + 0.2 * families))).otherwise(best)


def window_label(overlap_ratio: Column, event_label: Column, distance_hours: Column) -> Column:
    """1 where a window overlaps an anomaly by a tenth, 0 where it is a day away or the event is normal, else null."""
    return F.when((event_label == 1) & (overlap_ratio >= 0.10), 1).when((event_label == 1) & (overlap_ratio == 0) & (distance_hours >= 24), 0).when(event_label == 0, 0)


#: What a detector's own score weighs in the alert score, by how far its evidence has come. Status counts at
#: its first weight even without a confirmation.
EVIDENCE_WEIGHTS = {
    "short": {"candidate": 0.60, "confirmed": 0.70},
    "cluster": {"candidate": 0.65, "confirmed": 0.90},
    "persistent": {"candidate": 0.55, "confirmed": 0.95},
    "localized": {"candidate": 0.55, "confirmed": 0.95},
    "communication": {"candidate": 0.60, "confirmed": 0.98},
    "trend": {"candidate": 0.58, "confirmed": 0.92},
    "status": {"none": 0.65, "candidate": 0.65, "confirmed": 1.0},
    "control": {"confirmed": 0.98},
    "targeted": {"confirmed": 0.97},
    "semantic": {"candidate": 0.55, "settled": 0.68, "confirmed": 0.96},
}
#: Two or more confirmed families of these count by themselves.
FAMILY_START, FAMILY_STEP = 0.55, 0.20


def weighted_alert_score(score: dict[str, Column], stage: dict[str, Column], families: Column) -> Column:
    """The largest of the weighted scores of all detectors and of the bonus for several confirmed families, 0 at least.

    ``stage`` tells for each detector how far its evidence has come (null: none), ``score`` its score; a detector that is
    left out of ``score`` counts with 1.
    """
    terms = [F.lit(0.0), F.when(families >= 2, F.least(F.lit(1.0), FAMILY_START + FAMILY_STEP * families))]
    for name, reached in stage.items():
        at, weight = F.coalesce(reached, F.lit("none")), F.lit(0.0)
        for level, w in EVIDENCE_WEIGHTS[name].items():
            weight = F.when(at == level, F.lit(w)).otherwise(weight)
        terms.append(weight * F.coalesce(score.get(name, F.lit(1.0)), F.lit(0.0)))
    return F.greatest(*terms)
