"""Causal detectors as row frames: each looks at a row and the rows before it, so batch and replay agree.

They take tables (key, order, ...) and add columns. Where a detector is a recurrence (pending stops, latches, life cycle)
it is a fold carried from batch to batch; everything else is window functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import carried
from ..operators.frames import keyed, run_length, trailing
from .latches import Confirmation, Latch, LifeCycle
from .step import PendingStop, StreamConfig


def required(n: Column) -> Column:
    """Signals of a group of n that have to be high: min(n, 8, max(2, a fifth of n))."""
    return F.least(n, F.lit(8), F.greatest(F.lit(2), F.ceil(n * 0.2)))


def status_rarity(df: DataFrame, key: Sequence[str], order: str, token: str, history: int, rare_share: float = 0.0005, burst: int = 4, least: int = 1, novel_rows: int = 2, rare_rows: int = 3) -> DataFrame:
    """Adds novel, rare and burst: a token not seen among the ``history`` rows before, or seldom, once there are ``least``
    of them, and many changes within an hour; and ``confirmed``: novel or rare for so many rows in a row. Rows have times
    in ``order``."""
    w = keyed(key, [order])
    df = df.withColumn("_pos", F.row_number().over(w))
    before = Window.partitionBy(*key, token).orderBy("_pos").rangeBetween(-history, -1)
    seen, n = F.count(F.lit(1)).over(before), F.least(F.col("_pos") - 1, F.lit(history))
    change = F.coalesce((F.lag(token).over(w) != F.col(token)).cast("int"), F.lit(0))
    hour = Window.partitionBy(*key).orderBy(F.unix_seconds(order)).rangeBetween(-3600, 0)
    df = df.withColumns({"novel": (n >= least) & (seen == 0), "rare": (n >= least) & (seen > 0) & (seen <= rare_share * n), "_change": change})
    df = df.withColumn("burst", F.sum("_change").over(hour) >= burst)
    df = run_length(run_length(df, "novel", key, [order], "_novel"), "rare", key, [order], "_rare")
    return df.withColumn("confirmed", (F.col("_novel") >= novel_rows) | (F.col("_rare") >= rare_rows)).drop("_pos", "_change", "_novel", "_rare")


def semantic_groups(z: DataFrame, groups: DataFrame, key: Sequence[str], order: str, level: float, history: int, onset: float = 0.10, chronic: float = 0.20) -> DataFrame:
    """(key, order, name, n_high, max_z, busy, burden, onset, chronic) of groups (base, name) of signals (key, order, base, z):
    a group is busy with enough high signals; its burden is the share of busy rows among the ``history`` before."""
    g = z.join(F.broadcast(groups), "base").groupBy(*key, order, "name").agg(F.count("*").alias("_n"), F.count_if(F.col("z") >= level).alias("n_high"), F.max("z").alias("max_z"))
    g = g.withColumn("busy", F.col("n_high") >= required(F.col("_n")))
    before = keyed([*key, "name"], [order]).rowsBetween(-history, -1)
    g = g.withColumn("burden", F.coalesce(F.avg(F.col("busy").cast("double")).over(before), F.lit(0.0)))
    return g.withColumns({"onset": F.col("busy") & (F.col("burden") <= onset), "chronic": F.col("burden") >= chronic}).drop("_n")


def targeted_onset(groups: DataFrame, key: Sequence[str], order: str, listed: Sequence[str], level: float = 10.0, rows: int = 2, quiet_rows: int = 72, most: int = 2) -> DataFrame:
    """(key, order, n_groups, targeted) of groups with max_z, onset and chronic: a listed group with a new onset at a high
    level fires in the ``rows``-th such row in a row, and again after ``quiet_rows`` rows without; the row is an onset if
    one or two groups fire."""
    wanted = F.col("name").isin(*listed) & F.col("onset") & ~F.col("chronic") & (F.col("max_z") >= level)
    g = latched(groups.withColumn("_want", F.coalesce(wanted, F.lit(False))), [*key, "name"], order, "_want", ~F.col("_want"), rows, quiet_rows)
    return g.groupBy(*key, order).agg(F.count_if("fired").alias("n_groups")).withColumn("targeted", F.col("n_groups").between(1, most))


def causal_power(df: DataFrame, key: Sequence[str], order: str, value: str, dip: float = 0.5, recovery: float = 0.7) -> DataFrame:
    """Adds reference (median of the six rows before), dip, and recovered: the row after a dip is back."""
    w = keyed(key, [order])
    before = w.rowsBetween(-6, -1)
    reference = F.when(F.count(value).over(before) >= 3, F.percentile(value, 0.5).over(before))
    df = df.withColumn("reference", reference)
    df = df.withColumn("dip", F.coalesce((F.col("reference") > 0) & (F.col(value) <= dip * F.col("reference")), F.lit(False)))
    back = F.lag("dip").over(w) & (F.col(value) >= recovery * F.lag("reference").over(w))
    return df.withColumn("recovered", F.coalesce(back, F.lit(False)))


def stop_counts(df: DataFrame, key: Sequence[str], order: str, flag: str, active: str, rows: tuple[int, int, int], week: int, history: int, needs: tuple[int, int, int] = (3, 2, 6), busy_needs: tuple[int, int, int] = (4, 3, 8), active_share: float = 0.2, week_count: int = 20) -> DataFrame:
    """Adds the flag's counts over three trailing windows, ``busy`` and ``over``.

    A source is busy if, with ``history`` rows before, in the week before its share of active rows or its number of
    flagged rows is large. A flagged row is over if the count of the first window reaches its need, or both others do;
    needs are higher for a busy source."""
    w = keyed(key, [order])
    n = F.col(flag).cast("int")
    before = w.rowsBetween(-week, -1)
    share, count = F.avg(F.col(active).cast("double")).over(before), F.sum(n).over(before)
    busy = (F.count(F.lit(1)).over(before) >= history) & (F.coalesce(share >= active_share, F.lit(False)) | F.coalesce(count >= week_count, F.lit(False)))
    df = df.withColumns({**{f"count_{k}": F.sum(n).over(trailing(w, k)) for k in rows}, "busy": busy})

    def reached(need: tuple[int, int, int]) -> Column:
        a, b, c = (F.col(f"count_{k}") >= v for k, v in zip(rows, need, strict=True))
        return a | (b & c)

    return df.withColumn("over", F.col(flag) & F.when(F.col("busy"), reached(busy_needs)).otherwise(reached(needs)))


def slow_trend(z: DataFrame, key: Sequence[str], order: str, rows: int, shift_rows: int, hours_per_row: float, allowed: str, slope: float = 0.25, shift: float = 2.5, signals: int = 2, run: int = 6) -> DataFrame:
    """(key, order, n_rising, trend) of signed z (key, order, base, z, <allowed>): enough signals whose slope over the
    last ``rows`` rows is large and whose median there is far from that of the rows before, ``shift_rows`` in all (from
    zero while there are fewer), in rows that are allowed, for ``run`` rows."""
    w = Window.partitionBy(*key, "base").orderBy(order)
    recent, older = trailing(w, rows), w.rowsBetween(-(shift_rows - 1), -rows)
    z = z.withColumns({"_at": F.row_number().over(w), "_hour": F.row_number().over(w) * hours_per_row})
    now = F.percentile("z", 0.5).over(recent)
    moved = now - F.when(F.col("_at") >= shift_rows, F.percentile("z", 0.5).over(older)).otherwise(0.0)
    rising = F.col(allowed) & (F.col("_at") >= rows) & (F.abs(F.regr_slope("z", "_hour").over(recent)) >= slope) & (F.abs(moved) >= shift)
    g = z.withColumn("_up", F.coalesce(rising, F.lit(False))).groupBy(*key, order).agg(F.count_if("_up").alias("n_rising"))
    return run_length(g.withColumn("_hit", F.col("n_rising") >= signals), "_hit", key, [order]).withColumn("trend", F.col("run") >= run).drop("_hit", "run")


def communication_fault(df: DataFrame, key: Sequence[str], order: str, quality: str, rows: int = 2) -> DataFrame:
    """Adds ``fault``: confirmed bad data (``quality``) together with a novel or rare status or a burst of changes, for so
    many rows in a row."""
    df = df.withColumn("_both", F.col(quality) & (F.col("novel") | F.col("rare") | F.col("burst")))
    return run_length(df, "_both", key, [order], "_run").withColumn("fault", F.col("_run") >= rows).drop("_both", "_run")


class _Rows:
    """A fold with one result row for each row: ``take`` gets a row's values and returns the result's."""

    def __init__(self, take: Callable[..., tuple], columns: Sequence[str], order: str, names: Sequence[str]):
        self.take, self.columns, self.order, self.names = take, list(columns), order, list(names)

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        got = [self.take(*values) for values in zip(*(rows[c].tolist() for c in self.columns), strict=True)]
        out = pd.DataFrame(got, columns=self.names, dtype=object)
        out.insert(0, self.order, rows[self.order])
        return out

    def end(self) -> None:
        return None


def _fold(df: DataFrame, key: Sequence[str], order: str, columns: Sequence[str], make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return carried(df.select(*dict.fromkeys([*key, order, *columns])), key, [order], lambda: _Rows(make(), columns, order, names), f"`{order}` {df.schema[order].dataType.simpleString()}, {schema}")


def latched(df: DataFrame, key: Sequence[str], order: str, wanted: str, quiet: Column, confirm: int, quiet_rows: int) -> DataFrame:
    """(key, order, fired): the rows in which a latch fires; see Latch."""

    def make() -> Callable[..., tuple]:
        latch = Latch()
        return lambda want, calm: (latch.take(bool(want), bool(calm), confirm, quiet_rows),)

    return _fold(df.withColumn("_calm", quiet), key, order, [wanted, "_calm"], make, "fired boolean")


def confirmed_once(df: DataFrame, key: Sequence[str], order: str, cfg: StreamConfig = StreamConfig()) -> DataFrame:
    """(key, order, fires, confirmed) of rows (key, order, raw, support, allowed): see Confirmation."""

    def make() -> Callable[..., tuple]:
        c = Confirmation()
        return lambda now, raw, support, allowed: c.take(now, bool(raw), bool(support), bool(allowed), cfg.localized_points, cfg.localized_minutes, cfg.rows(cfg.localized_hours), cfg.sampling_minutes)

    df = df.withColumn("_now", F.unix_micros(order) / 1e6)
    return _fold(df, key, order, ["_now", "raw", "support", "allowed"], make, "fires boolean, confirmed boolean")


def pending_stops(df: DataFrame, key: Sequence[str], order: str, cfg: StreamConfig = StreamConfig()) -> DataFrame:
    """(key, order, started) of rows (key, order, power, reference, dip, opens): a dip opens a pending stop, a stable
    recovery confirms it, time or length cancels it."""

    def make() -> Callable[..., tuple]:
        stop = PendingStop()
        return lambda now, power, reference, dip, opens: (stop.update(now, power, reference, bool(dip), bool(opens), cfg),)

    df = df.withColumn("_now", F.unix_micros(order) / 1e6)
    return _fold(df, key, order, ["_now", "power", "reference", "dip", "opens"], make, "started boolean")


def alert_phases(df: DataFrame, key: Sequence[str], order: str, cfg: StreamConfig = StreamConfig()) -> DataFrame:
    """(key, order, phase, closed) of rows (key, order, trigger, review, support): the alert's life cycle, and whether an
    episode closes in the row."""

    def make() -> Callable[..., tuple]:
        cycle = LifeCycle()

        def take(trigger: bool, review: bool, support: bool) -> tuple:
            closed = cycle.take(bool(trigger), bool(review), bool(support), cfg.recovery_rows, cfg.rows(cfg.merge_hours))
            return cycle.phase, closed

        return take

    return _fold(df, key, order, ["trigger", "review", "support"], make, "phase string, closed boolean")


def open_episodes(phases: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """(key, n_closed, right_censored): episodes that closed, and whether one is open at the source's end."""
    return phases.groupBy(*key).agg(F.count_if("closed").alias("n_closed"), F.max_by("phase", order).isin("active_alert", "recovery_pending", "inactive_pending").alias("right_censored"))


def stateful(df: DataFrame, key: Sequence[str], order: str, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """(key, order, <schema>): a new object of ``make`` for each key takes its rows one by one, in order, as dicts."""
    columns, names = df.columns, [c.split()[0] for c in schema.split(", ")]

    def rows() -> Callable[..., tuple]:
        take = make()

        def one(*values) -> tuple:
            got = take(dict(zip(columns, values, strict=True)))
            return tuple(got[n] for n in names)

        return one

    return _fold(df, key, order, columns, rows, schema)
