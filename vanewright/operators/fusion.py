"""Evidence fusion: window summaries of three sources, candidates outside the log, payloads and texts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hours_between, overlap_hours
from .decisions import offlog_priority
from .folds import carried
from .intervals import merge, overlap_join

PROHIBITED = ("event_label", "actual_binary", "target", "fold", "label")


def stream_summary(windows: DataFrame, episodes: DataFrame, key: Sequence[str], ids: str) -> DataFrame:
    """(id, n_episodes, overlap_hours, coverage, first_start, delay_hours, families, tier) of windows (key, id, start, end).

    Episodes are (key, ep_start, ep_end, families). Overlaps are merged before their hours are added.
    """
    j = overlap_join(windows, episodes, key, ("start", "end"), ("ep_start", "ep_end"))
    cut = j.select(ids, "start", "end", F.greatest("start", "ep_start").alias("_a"), F.least("end", "ep_end").alias("_b"), "ep_start", "families")
    hours = merge(cut, [ids], "_a", "_b").groupBy(ids).agg(F.sum(hours_between(F.col("start"), F.col("end"))).alias("overlap_hours"))
    facts = cut.groupBy(ids).agg(F.count("*").alias("n_episodes"), F.min("ep_start").alias("first_start"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("families", ";"))))), ";").alias("families"))
    out = windows.select(ids, "start", "end").join(facts, ids, "left").join(hours, ids, "left")
    h = F.coalesce("overlap_hours", F.lit(0.0))
    length = hours_between(F.col("start"), F.col("end"))
    tier = F.when(F.col("n_episodes").isNull(), "none").when(h / length >= 0.25, "strong").when(h > 0, "partial").otherwise("touching")
    return out.select(ids, F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"), h.alias("overlap_hours"), F.least(F.lit(1.0), h / F.when(length > 0, length)).alias("coverage"), "first_start", hours_between(F.col("start"), F.col("first_start")).alias("delay_hours"), F.coalesce("families", F.lit("")).alias("families"), tier.alias("tier"))


def early_warning_summary(windows: DataFrame, warnings: DataFrame, key: Sequence[str], ids: str, lookback_days: int = 30) -> DataFrame:
    """(id, warned, within_7, within_14, within_30, lead_days, warning_hours): warnings (key, w_start, w_end) clipped to
    the lookback before each window's start."""
    low = F.col("start") - F.expr(f"interval {lookback_days} days")
    w = windows.select(*key, ids, "start", low.alias("_low"))
    j = overlap_join(w, warnings, key, ("_low", "start"), ("w_start", "w_end"))
    cut = j.select(ids, "start", F.greatest("_low", "w_start").alias("_a"), F.least("start", "w_end").alias("_b"))
    hours = merge(cut, [ids], "_a", "_b").groupBy(ids).agg(F.sum(hours_between(F.col("start"), F.col("end"))).alias("warning_hours"))
    within = lambda d: F.bool_or(F.col("_b") >= F.col("start") - F.expr(f"interval {d} days"))
    facts = cut.groupBy(ids).agg(within(7).alias("within_7"), within(14).alias("within_14"), within(30).alias("within_30"), (F.max(hours_between(F.col("_a"), F.col("start"))) / 24).alias("lead_days"))
    out = windows.select(ids).join(facts, ids, "left").join(hours, ids, "left")
    no = F.lit(False)
    return out.select(ids, F.col("lead_days").isNotNull().alias("warned"), *(F.coalesce(f"within_{d}", no).alias(f"within_{d}") for d in (7, 14, 30)), "lead_days", F.coalesce("warning_hours", F.lit(0.0)).alias("warning_hours"))


def merge_candidates(episodes: DataFrame, key: Sequence[str], max_gap_hours: float = 6.0) -> DataFrame:
    """Folds episodes (key, start, end, score, families array) in the order of start and end into candidates.

    An episode joins only the last candidate, if the gap is from 0 to max_gap hours and it shares a family with all
    families gathered so far. A carried fold over the key's episodes: (key, start, end, n, score, families).
    """
    f = F.array_sort(F.array_distinct(F.coalesce("families", F.array().cast("array<string>"))))
    rows = episodes.select(*key, F.unix_micros("start").alias("_s"), F.unix_micros("end").alias("_e"), F.col("score").cast("double").alias("_v"), f.alias("_f"))
    out = carried(rows, key, ["_s", "_e", "_v", "_f"], lambda: _Candidates(int(max_gap_hours * 3.6e9)), "_s bigint, _e bigint, n int, score double, families array<string>")
    return out.select(*key, F.timestamp_micros("_s").alias("start"), F.timestamp_micros("_e").alias("end"), "n", "score", "families")


class _Candidates:
    """Keeps the last candidate open and lets go of it when an episode doesn't join it."""

    def __init__(self, gap: int):
        self.gap = gap
        self.last: list | None = None

    @staticmethod
    def rows(done: list[list]) -> pd.DataFrame:
        return pd.DataFrame([(*c[:4], sorted(c[4])) for c in done], columns=["_s", "_e", "n", "score", "families"])

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        done = []
        for s, e, v, f in zip(*(rows[c].tolist() for c in ("_s", "_e", "_v", "_f")), strict=True):
            if self.last is not None and 0 <= s - self.last[1] <= self.gap and self.last[4] & set(f):
                last = self.last
                last[1], last[2], last[3] = max(last[1], e), last[2] + 1, max(last[3], v)
                last[4] |= set(f)
            else:
                if self.last is not None:
                    done.append(self.last)
                self.last = [s, e, 1, v, set(f)]
        return self.rows(done)

    def end(self) -> pd.DataFrame | None:
        return self.rows([self.last]) if self.last is not None else None


def offlog_candidates(episodes: DataFrame, logged: DataFrame, key: Sequence[str], buffer_hours: float = 24.0, least_minutes: float = 20.0, least_score: float = 0.9, least_priority: float = 0.7, top: int = 5) -> DataFrame:
    """Candidates that no logged interval (key, l_start, l_end) of their own source touches within the buffer; sources
    without a log are left out. The best ``top`` of each key by priority, with their rank."""
    b = F.expr(f"interval {int(buffer_hours * 3600)} seconds")
    wide = logged.select(*key, (F.col("l_start") - b).alias("_l0"), (F.col("l_end") + b).alias("_l1"))
    free = overlap_join(episodes, wide, key, ("start", "end"), ("_l0", "_l1"), "left_anti")
    free = free.join(wide.select(*key).distinct(), list(key), "left_semi")
    c = merge_candidates(free, key).where((hours_between(F.col("start"), F.col("end")) * 60 >= least_minutes) & (F.col("score") >= least_score))
    w = wide.withColumnsRenamed({k: f"_{k}" for k in key})
    near = c.join(w, [F.col(k) == F.col(f"_{k}") for k in key]).groupBy(*key, "start", "end", "n", "score", "families").agg(F.min(F.greatest(hours_between(F.col("end"), F.col("_l0")), hours_between(F.col("_l1"), F.col("start")))).alias("distance_hours"))
    p = offlog_priority(F.col("score"), hours_between(F.col("start"), F.col("end")), F.size("families"), F.col("n"), F.col("distance_hours"), F.col("families") == F.array(F.lit("targeted")), F.lit(False))
    rated = near.withColumn("priority", p).where(F.col("priority") >= least_priority)
    return rated.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("priority"), "start"))).where(F.col("rank") <= top)


def payload(df: DataFrame, ids: str, columns: Sequence[str], prohibited: Sequence[str] = PROHIBITED) -> DataFrame:
    """(id, payload): the allowed columns as JSON."""
    return df.select(ids, F.to_json(F.struct(*(c for c in columns if c not in prohibited))).alias("payload"))


def explanation(decision: Column, reasons: Column, hours: Column) -> Column:
    """A sentence for an event."""
    return F.concat(F.lit("The event is judged "), decision, F.when(reasons != "", F.concat(F.lit(" because of "), F.regexp_replace(reasons, ";", ", "))).otherwise(F.lit(" without specific evidence")), F.format_string("; persistent for %.1f hours.", hours))


def own_context(candidates: DataFrame, events: DataFrame, key: Sequence[str], ids: str) -> DataFrame:
    """(id, event_id, position, distance_hours) of each candidate (key, id, start, end) to its own source's nearest
    event (key, event_id, e_start, e_end)."""
    r = events.withColumnsRenamed({k: f"_{k}" for k in key})
    j = candidates.join(r, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    inside = overlap_hours(F.col("start"), F.col("end"), F.col("e_start"), F.col("e_end")) > 0
    gap = F.greatest(F.lit(0.0), hours_between(F.col("end"), F.col("e_start")), hours_between(F.col("e_end"), F.col("start")))
    position = F.when(F.col("event_id").isNull(), "none").when(inside, "overlapping").when(F.col("end") <= F.col("e_start"), "before").otherwise("after")
    j = j.withColumns({"position": position, "distance_hours": F.when(F.col("event_id").isNotNull(), gap)})
    return j.withColumn("_n", F.row_number().over(Window.partitionBy(ids).orderBy(F.col("distance_hours").asc_nulls_last(), "event_id"))).where("_n = 1").select(ids, "event_id", "position", "distance_hours")


def vote_reason(fraction: Column, stability: Column) -> Column:
    """A sentence on a document's repeated predictions."""
    return F.concat(F.round(fraction * 100).cast("bigint").cast("string"), F.lit(" % of the votes are for an anomaly; the votes are "), stability, F.lit("."))


def without_fields(value: Column, kind: T.DataType, prohibited: Sequence[str] = PROHIBITED, rename: dict[str, str] | None = None, replace: dict[str, str] | None = None) -> Column:
    """A nested value without prohibited fields at any depth, with fields renamed and parts of texts replaced. It
    follows the schema, so the work is one projection."""
    rename, replace = rename or {}, replace or {}
    again = lambda v, t: without_fields(v, t, prohibited, rename, replace)
    if isinstance(kind, T.StructType):
        return F.struct(*(again(value[f.name], f.dataType).alias(rename.get(f.name, f.name)) for f in kind if f.name not in prohibited))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: again(x, kind.elementType))
    if isinstance(kind, T.StringType):
        for old, new in replace.items():
            value = F.replace(value, F.lit(old), F.lit(new))
    return value
