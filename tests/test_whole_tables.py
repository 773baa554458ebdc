"""Interval and selection queries over all events against brute force."""

import datetime as dt
import inspect

import pytest

from vanewright.operators import ml
from vanewright.plans import catalog

TYPES = ("click", "error", "purchase", "signup", "view")
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, rows): 400 events of 23 users with ids on both sides of 2,000."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i * 7 % 23 if i % 23 else 10 * (i % 2), TYPES[i * i % 5], start + dt.timedelta(minutes=(i * 7919) % 9000), float(i % 101)) for i in range(1800, 2200)]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{folder}/events.parquet")
    us = lambda t: (t - start) // dt.timedelta(microseconds=1)
    return folder, [(i, u, kind, us(t)) for i, u, kind, t, _ in rows]


def spans(rows):
    return [(i, u, s, s + i % 12 * HOUR) for i, u, _, s in rows]


def windows(rows):
    return [(i, u, i // 97 % 2, s, s + 24 * HOUR) for i, u, _, s in rows if i % 97 == 0]


def gap(s, e, a, z):
    return max(0, a - e, s - z)


def test_nearest_interval(spark, small):
    d, rows = small
    w = windows(rows)
    want = {i: min((round(gap(s, e, a, z) / HOUR, 5) for _, v, _, a, z in w if v == u), default=None) for i, u, s, e in spans(rows)}
    got = catalog.QUERIES["p27_nearest_interval"](spark, d).collect()
    assert len(got) == len(rows) and {r["event_id"]: r["nearest_hours"] for r in got} == want and max(want) >= 2000


def test_containment_parent(spark, small):
    d, rows = small
    w = sorted(windows(rows), key=lambda x: (x[2], x[3]))
    want = {i: next((p for p, v, _, a, z in w if v == u and a <= s and e <= z), None) for i, u, s, e in spans(rows)}
    got = catalog.QUERIES["j07_containment_parent"](spark, d).collect()
    assert len(got) == len(rows) and {r["event_id"]: r["parent"] for r in got} == want and any(v and i % 5 for i, v in want.items())


def test_primary_detector(spark, small):
    d, rows = small
    seen = {}
    for _, u, kind, _ in rows:
        seen.setdefault(u, set()).add(kind)
    want = {u: next((k for k in ("error", "signup", "purchase") if k in kinds), min(kinds)) for u, kinds in seen.items()}
    got = catalog.QUERIES["t05_primary_detector"](spark, d).collect()
    assert {r["user_id"]: r["main"] for r in got} == want and len(got) == len(want)


def test_exclusion_hull(spark, small):
    d, rows = small
    errors = {}
    for _, u, kind, t in rows:
        if kind == "error":
            errors.setdefault(u, []).append(t)
    far = lambda u, t: u not in errors or not min(errors[u]) - 12 * HOUR <= t <= max(errors[u]) + 12 * HOUR
    want = sorted(i for i, u, kind, t in rows if kind == "error" or far(u, t))
    got = sorted(r["event_id"] for r in catalog.QUERIES["p23_exclusion_hull"](spark, d).collect())
    assert got == want and any(u % 10 for i, u, _, _ in rows if i in want)


def test_own_context(spark, small):
    d, rows = small
    want = {}
    for i, u, s, e in spans(rows):
        near = min(((gap(s, e, a, z), w, a, z) for w, v, _, a, z in windows(rows) if v == u), default=None)
        if near is None:
            want[i] = (None, "none", None)
        else:
            g, w, a, z = near
            want[i] = (w, "overlapping" if min(e, z) > max(s, a) else "before" if e <= a else "after", round(g / HOUR, 5))
    got = catalog.QUERIES["j11_own_context"](spark, d).collect()
    assert len(got) == len(rows) and {r["event_id"]: (r["nearest"], r["position"], r["distance_hours"]) for r in got} == want


def test_votes_use_the_folds_and_repeats_of_the_operator(spark, monkeypatch):
    how = inspect.signature(ml.nested_cv)
    monkeypatch.setattr(ml, "nested_cv", lambda *a, **k: how.bind(*a, **k))
    used = catalog.QUERIES["m01_logistic_votes"](spark, "/root/testdata/sf0.001")
    used.apply_defaults()
    assert (used.arguments["splits"], used.arguments["repeats"]) == (5, 5)
