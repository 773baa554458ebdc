"""Overlaps scoped to farm and source: all scopes against brute force, and no pairs beyond those that stay."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vanewright.operators import ranges, tables
from vanewright.plans import catalog

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def brute(left, right):
    """Pairs of (w_id, key, farm, source, from, to) and (id, key, farm, source, from, to) that stay."""
    pairs = [(a, b) for a in left for b in right if None not in (a[1], b[1], a[4], b[4], b[5]) and a[1] == b[1] and b[4] <= a[5] and a[4] <= b[5]]
    out = []
    for w in {a[0] for a, _ in pairs}:
        mine = [(a, b) for a, b in pairs if a[0] == w]
        same = [(a, b) for a, b in mine if b[2] is not None and a[2] == b[2]]
        mine = same or mine
        if any(b[3] for _, b in mine):
            mine = [(a, b) for a, b in mine if b[3] is not None and a[3] == b[3]]
        out += [(w, b[0]) for _, b in mine]
    return sorted(out)


def test_all_scopes(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
    rng = random.Random(5)
    pick = rng.choice

    def left(n):
        t = START + rng.randrange(400) * HOUR
        return (n if n % 9 else n - 1, pick([1, 1, 2, 3, None]), pick(["a", "b", None]), pick(["s", "t", ""]), t, t + rng.randrange(3) * HOUR)

    def right(n):
        t, k = START + rng.randrange(400) * HOUR, pick([1, 1, 2, 3])
        # key 2 has sources seldom, key 3 never
        source = pick({1: ["s", "t", "", None], 2: ["", "", None, "", "s"], 3: ["", None]}[k])
        return (n, k if n % 17 else None, pick(["a", "b", "c", None]), source, t if n % 23 else None, t + rng.randrange(-2, 6) * HOUR)

    w, s = [left(n) for n in range(1, 400)], [right(n) for n in range(500)]
    l = spark.createDataFrame(w, "w_id int, k int, wf string, ws string, a timestamp, z timestamp")
    r = spark.createDataFrame(s, "id int, k int, farm string, source string, start timestamp, end timestamp")
    got = tables.scoped_overlap(l, r, ["k"], ("a", "z"), ("start", "end"), "farm", "source", F.col("ws"), F.col("wf"), ["w_id"], 7_200)
    want = brute(w, s)
    assert sorted((x["w_id"], x["id"]) for x in got.collect()) == want and len(want) > 100


def test_no_windows(spark):
    l = spark.createDataFrame([], "w_id int, k int, wf string, ws string, a timestamp, z timestamp")
    r = spark.createDataFrame([(1, 1, "a", "s", START, START)], "id int, k int, farm string, source string, start timestamp, end timestamp")
    assert tables.scoped_overlap(l, r, ["k"], ("a", "z"), ("start", "end"), "farm", "source", F.col("ws"), F.col("wf"), ["w_id"], 7_200).count() == 0


def joined(node) -> list[int]:
    """Rows that each join of an executed plan made."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return joined(node.executedPlan())
    if name.endswith("QueryStage"):
        return joined(node.plan())
    here = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return here + [n for i in range(node.children().size()) for n in joined(node.children().apply(i))]


def test_only_pairs_that_stay_are_made(spark, tmp_path):
    events = [(i, 8 * (i % 500), "view", START + dt.timedelta(milliseconds=i), 1.0) for i in range(4000)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.QUERIES["j12_source_scope"](spark, str(tmp_path))
    got = df.collect()
    user = {e[0]: e[1] for e in events}
    assert got and all(user[x["w_id"]] == user[x["event_id"]] for x in got)
    rows = joined(df._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 2 * len(events)
