"""The online step against the row frames, and latches and life cycle against rows written out by hand."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vanewright.operators import intervals
from vanewright.streaming import causal
from vanewright.streaming.latches import Confirmation, Latch, LifeCycle
from vanewright.streaming.step import State, StreamConfig, step

T0 = dt.datetime(2024, 1, 1)


def test_latch_fires_once_and_is_armed_after_quiet_rows():
    latch = Latch()
    wanted = [0, 1, 1, 1, 0, 0, 1, 1, 0, 0, 0, 1, 1]
    fired = [latch.take(bool(w), not w, 2, 3) for w in wanted]
    assert [i for i, f in enumerate(fired) if f] == [2, 12]


def test_life_cycle_by_hand():
    cycle, out = LifeCycle(), []
    #      trigger, review, support
    rows = [(0, 1, 0), (0, 1, 0), (0, 0, 1), (0, 1, 0), (1, 0, 1), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 1, 1), (1, 0, 1), (0, 0, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    for r in rows:
        closed = cycle.take(*map(bool, r), 3, 2)
        out.append(cycle.phase[:2] + ("!" if closed else ""))
    # a candidate ends with its evidence; the row that loses support is the first of three; review doesn't reopen
    assert out == ["ca", "ca", "no", "ca", "ac", "ac", "re", "re", "in", "in", "ac", "re", "ac", "re", "re", "in", "in", "no!"]


def test_confirmation_only_near_the_start():
    minutes = 60.0
    take = lambda c, i, raw, dip: c.take(i * 3600.0, raw, dip, True, 2, 2 * minutes, 3, minutes)
    c = Confirmation()
    assert [take(c, i, True, i == 3) for i in range(5)] == [(False, False)] * 5  # the dip comes too late
    c = Confirmation()
    got = [take(c, i, True, i == 0) for i in range(7)]
    assert [f for f, _ in got].index(True) == 1 and [h for _, h in got] == [False, True, True, True, True, False, False]
    assert take(c, 7, False, False) == (False, False) and [take(c, 8 + i, True, i == 1)[0] for i in range(3)] == [False, True, False]


def series(n=400):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        power = 100 + rng.normal()
        if i in (200, 203, 206, 300, 303, 306, 309):
            power = 30.0
        rows.append((600.0 * i, power, "a" if i % 90 else "b" if i < 300 else "c"))
    return rows


def test_step_and_row_frames_give_the_same_flags(spark):
    """Stops, their counts, power dips and status of one series, by the online step and by windows and folds."""
    cfg = StreamConfig(warmup=24, history_hours=8, status_hours=48, rare_share=0.02, stable_rows=1, independence_minutes=0, busy_week=5, short_fraction=0.0)
    rows, s, seen = series(), State(), []
    lay = {"bases": np.array([0, 1]), "power": np.array([0]), "groups": {}}
    for at, power, status in rows:
        out = step(s, {"time": at, "x": [power, 1.0], "status": status, **lay}, cfg)
        seen.append((out["warmup_complete"], s.dipped, len(s.shorts) > 0 and s.shorts[-1] == at, s.novel_run > 0, s.rare_run > 0))
    df = spark.createDataFrame([("s", T0 + dt.timedelta(seconds=at), power, status) for at, power, status in rows], "k string, t timestamp, power double, status string")
    x = causal.status_rarity(df, ["k"], "t", "status", cfg.rows(cfg.status_hours), cfg.rare_share, cfg.burst, cfg.rows(cfg.history_hours))
    x = x.withColumn("n", F.row_number().over(causal.keyed(["k"], ["t"]))).where("n > 24")
    # the power of the step begins with its warm-up rows left out
    p = causal.causal_power(x, ["k"], "t", "power", cfg.dip_ratio, cfg.recovery_ratio)
    p = p.withColumn("opens", F.lit(True))
    stops = causal.pending_stops(p, ["k"], "t", cfg)
    got = p.join(stops, ["k", "t"]).orderBy("t").collect()
    want = [v for v in seen if v[0]]
    assert [(r["dip"], r["started"], r["novel"], r["rare"]) for r in got] == [v[1:] for v in want]
    assert sum(r["started"] for r in got) >= 5 and any(r["novel"] or r["rare"] for r in got)


def test_timeline_has_one_rule_for_any_number_of_names(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    for n in (3, 200):
        rows = [("k", at(0), at(5), f"n{i:03d}") for i in range(n)] + [("k", at(5), at(6), "n000"), ("k", at(2), at(3), None), ("k", at(9), at(9), "empty"), (None, at(1), at(2), "other")]
        got = intervals.timeline(spark.createDataFrame(rows, "k string, s timestamp, e timestamp, name string"), ["k"], "s", "e", "name").collect()
        found = sorted((str(r["k"]), r["start"], r["end"], r["n_active"]) for r in got)
        assert found == [("None", at(1), at(2), 1), ("k", at(0), at(5), n), ("k", at(5), at(6), 1)]
