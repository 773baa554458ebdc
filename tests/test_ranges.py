import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanewright.operators import frames, fusion, ranges, ranking, stats
from vanewright.operators.folds import carried

T0 = dt.datetime(2024, 1, 1)


def test_bracketed_quantiles_equal_percentile(spark):
    rng = random.Random(1)
    rows = [("big", rng.gauss(0, 1)) for _ in range(3000)] + [("ties", float(rng.randrange(3))) for _ in range(900)] + [("hot", 5.0 if i % 3 else float(i)) for i in range(1000)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("nulls", None), ("some", None), ("some", 3.0), (None, 1.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.995, 1.0)
    want = {r["k"]: (r["n"], r["q"]) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect() if r["n"]}
    for accuracy in (10_000, 200):
        got = {r["k"]: (r["n"], r["q"]) for r in stats.bracketed_quantiles(df, ["k"], "v", qs, accuracy).collect()}
        assert got.keys() == want.keys()
        for k, (n, q) in want.items():
            assert got[k][0] == n and np.allclose(got[k][1], q, rtol=1e-12), k
    assert stats.bracketed_quantiles(df.where("false"), ["k"], "v", qs).count() == 0


def test_bracketed_scale_equals_robust_scale(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("a", rng.expovariate(1)) for _ in range(500)] + [("flat", 1.0)] * 20 + [("b", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    key = lambda r: (r["k"], r["n"], round(r["centre"], 9), None if r["scale"] is None else round(r["scale"], 9))
    assert sorted(map(key, stats.bracketed_scale(df, ["k"], "v").collect())) == sorted(map(key, stats.robust_scale(df, ["k"], "v").collect()))


def test_percent_rank_over_ranges_equals_the_window(spark):
    rng = random.Random(3)
    rows = [("all", i, float(rng.randrange(40)) if i % 3 else 7.0) for i in range(1200)] + [("few", 5000, 1.0), ("few", 5001, None), (None, 5002, 2.0)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    want = {r["id"]: r["p"] for r in df.where("k is not null").withColumn("p", frames.percent_rank_average(F.col("v"), ["k"])).collect()} | {5002: 1.0}
    got = {r["id"]: r["p"] for r in ranges.percent_rank(df, ["k"], "v", "p", 9).collect()}
    assert got.keys() == want.keys() and all(got[i] is want[i] or math.isclose(got[i], want[i], rel_tol=1e-12) for i in got)


def spans(rng, n, most, key=lambda i: "hot"):
    out = []
    for i in range(n):
        s = rng.randrange(2000)
        out.append((key(i), i, T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=s + (rng.choice([0, 1, 5, 30]) if rng.random() < 0.9 else rng.randrange(most)))))
    return out


def hours(a, b):
    return (b - a).total_seconds() / 3600


@pytest.mark.parametrize("rows", [11, 1_000_000])
def test_swept_joins_equal_brute_force(spark, rows):
    rng = random.Random(4)
    left = spans(rng, 150, 900, lambda i: "hot" if i % 10 else "cold") + [("lonely", 900, T0, T0)]
    right = spans(rng, 90, 1500) + [("cold", 500, T0 + dt.timedelta(minutes=700), T0 + dt.timedelta(minutes=710)), ("other", 501, T0, T0)]
    l = spark.createDataFrame(left, "k string, id int, start timestamp, end timestamp")
    r = spark.createDataFrame([(*x, x[1] % 3 if x[1] % 7 else None) for x in right], "k string, event_id int, e_start timestamp, e_end timestamp, label int")
    nearest, parent, context = {}, {}, {}
    for k, i, s, e in left:
        mine = [x for x in right if x[0] == k]
        gap = lambda x: max(0.0, hours(e, x[2]), hours(x[3], s))  # noqa: B023, E731
        best = min(mine, key=lambda x: (gap(x), x[1]), default=None)
        nearest[i] = None if best is None else gap(best)
        held = [x for x in mine if x[2] <= s and x[3] >= e]
        parent[i] = min(held, key=lambda x: (x[1] % 7 == 0, x[1] % 3, x[2], x[1]))[1] if held else None
        context[i] = (None, "none", None) if best is None else (best[1], "overlapping" if min(e, best[3]) > max(s, best[2]) else "before" if e <= best[2] else "after", gap(best))
    got = {x["id"]: x["nearest_hours"] for x in ranges.nearest_hours(l, r, ["k"], ("start", "end"), ("e_start", "e_end"), ["id"], rows).collect()}
    same = lambda a, b: a is b or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9))
    assert got.keys() == nearest.keys() and all(same(got[i], nearest[i]) for i in got)
    p = r.withColumnsRenamed({"event_id": "parent", "e_start": "p_start", "e_end": "p_end"})
    assert {x["id"]: x["parent"] for x in ranges.contained_parent(l, p, ["k"], "id", "parent", ["label", "p_start"], rows).collect()} == parent
    got = {x["id"]: (x["event_id"], x["position"], x["distance_hours"]) for x in ranges.own_context(l, r, ["k"], "id", rows).collect()}
    assert got.keys() == context.keys()
    assert all(got[i][:2] == context[i][:2] and same(got[i][2], context[i][2]) for i in got)


def test_swept_joins_are_linear_on_one_key(spark):
    """Many intervals of one key: what is dealt grows with the rows, not with their pairs."""
    made = {}
    for n in (500, 2000):
        minute = 60_000_000
        one, two = (spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("x"), (F.col("id") * minute).alias("_s"), (F.col("id") * minute + 5 * minute).alias("_e")) for _ in range(2))
        seen = ranges._met(one, two, ["k"], True, "n long, m long", lambda a, b: ranges.pd.DataFrame({"n": [len(a)], "m": [len(b)]}), 100)
        made[n] = seen.agg(F.sum(F.col("n") + F.col("m"))).first()[0] / n
    assert max(made.values()) < 2.3


def test_folds_carry_their_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(5)
        rows = [(k, i, rng.gauss(10, 3)) for k in ("a", "b", None) for i in range(100)]
        df = spark.createDataFrame(rows, "k string, i int, v double")
        got = {(r["k"], r["i"]): (r["ewma_mean"], r["ewma_var"]) for r in frames.ewma(df, "v", ["k"], ["i"], 9, 1.0).collect()}
        for k in ("a", "b", None):
            m, v = None, 1.0
            for i, x in [(i, x) for kk, i, x in rows if kk == k]:
                if m is None:
                    m = x
                else:
                    sd = math.sqrt(v)
                    m += 0.2 * max(-sd, min(sd, x - m))
                    v = 0.8 * v + 0.2 * (x - m) ** 2
                assert np.allclose(got[k, i], (m, v))
        assert len(got) == 300
        times = spark.createDataFrame([("a", i, float(rng.randrange(20)), T0 + dt.timedelta(hours=rng.randrange(60))) for i in range(80)], "k string, id int, s double, t timestamp")
        chosen = []
        for r in sorted(times.collect(), key=lambda r: (-r["s"], r["id"])):
            if len(chosen) < 6 and all(abs(hours(r["t"], c["t"])) >= 5 for c in chosen):
                chosen.append(r)
        assert [(r["id"], r["rank"]) for r in ranking.spaced(times, ["k"], "s", "t", "id", 5, 6).orderBy("rank").collect()] == [(r["id"], n) for n, r in enumerate(chosen, 1)]
        eps = spark.createDataFrame([("a", T0 + dt.timedelta(hours=3 * i), T0 + dt.timedelta(hours=3 * i + 1 + rng.randrange(3)), rng.random(), [rng.choice("xyz")] if i % 9 else None) for i in range(60)], "k string, start timestamp, end timestamp, score double, families array<string>")
        want = []
        for r in sorted(eps.collect(), key=lambda r: (r["start"], r["end"])):
            f = set(r["families"] or [])
            if want and 0 <= hours(want[-1][1], r["start"]) <= 2 and want[-1][3] & f:
                w = want[-1]
                want[-1] = (w[0], max(w[1], r["end"]), w[2] + 1, w[3] | f)
            else:
                want.append((r["start"], r["end"], 1, f))
        got = sorted((r["start"], r["end"], r["n"], set(r["families"])) for r in fusion.merge_candidates(eps, ["k"], 2.0).collect())
        assert got == want and max(w[2] for w in want) > 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert carried(df.where("false"), ["k"], ["i"], lambda: None, "v double").count() == 0
