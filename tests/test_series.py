"""Hand-made series with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vanewright.functions import arrays, scalars
from vanewright.operators import frames, intervals, metrics, ranking, stats

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, flag=False):
    rows = [("a", T0 + dt.timedelta(minutes=10 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k string, t timestamp, v {'boolean' if flag else 'double'}")


def column(df, name, by="t"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_centred_even_and_odd(spark):
    df = series(spark, [float(i) for i in range(20)])
    w = frames.keyed(["k"], ["t"])
    got = df.select("t", frames.rolling(F.col("v"), frames.centred(w, 12), "mean").alias("e"), frames.rolling(F.col("v"), frames.centred(w, 3), "mean").alias("o"))
    want = pd.Series(range(20)).rolling(12, center=True, min_periods=1).mean()
    assert np.allclose(column(got, "e"), want)
    assert column(got, "o")[1] == 1.0


def test_runs_ranges_and_bridges(spark):
    df = series(spark, [False, True, True, False, True, False, False, False, True, False], flag=True)
    assert column(frames.run_length(df, "v", ["k"], ["t"]), "run") == [0, 1, 2, 0, 1, 0, 0, 0, 1, 0]
    assert column(frames.bridge(df, "v", ["k"], ["t"], 1), "bridged") == [False, True, True, True, True, False, False, False, True, False]
    assert frames.true_ranges(df, "v", ["k"], "t", 2).count() == 1
    for flags in ([], [True] * 4, [False] * 4):
        assert frames.true_ranges(series(spark, flags, flag=True), "v", ["k"], "t").count() == (1 if flags[:1] == [True] else 0)


def test_merge_touching_nested_and_points(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    df = spark.createDataFrame([("a", h(0), h(2)), ("a", h(2), h(3)), ("a", h(1), h(1.5)), ("a", h(5), h(5)), ("a", h(6), h(7))], "k string, s timestamp, e timestamp")
    got = [(r["start"], r["end"], r["n"]) for r in intervals.merge(df, ["k"], "s", "e").orderBy("start").collect()]
    assert got == [(h(0), h(3), 3), (h(6), h(7), 1)]
    assert intervals.merge(df, ["k"], "s", "e", keep_points=True).count() == 3
    assert intervals.union_hours(df, ["k"], "s", "e").first()["total_hours"] == 4


def test_scales_and_constant_signal(spark):
    df = series(spark, [5.0] * 8)
    assert stats.robust_scale(df, ["k"], "v").first()["scale"] is None
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None])
    r = stats.robust_scale(df, ["k"], "v").first()
    assert r["centre"] == 3.0 and math.isclose(r["scale"], 1.4826)


def test_ranks_with_ties_and_nulls(spark):
    df = series(spark, [1.0, 2.0, 2.0, None])
    got = column(df.withColumn("p", frames.percent_rank_average(F.col("v"), ["k"])), "p")
    assert np.allclose(got[:3], [1 / 3, 2.5 / 3, 2.5 / 3]) and got[3] is None


def test_jaccard_of_empty_sets(spark):
    e = F.array().cast("array<string>")
    r = spark.range(1).select(arrays.jaccard(e, e, 0.0).alias("a"), arrays.jaccard(e, e, 1.0).alias("b")).first()
    assert (r["a"], r["b"]) == (0.0, 1.0)


def test_ewma_follows_recurrence(spark):
    xs = [1.0, 3.0, -50.0, 2.0]
    got = frames.ewma(series(spark, xs), "v", ["k"], ["t"], 9)
    mean, var, out = xs[0], 1.0, [1.0]
    for x in xs[1:]:
        mean += 0.2 * max(-6 * var**0.5, min(6 * var**0.5, x - mean))
        var = 0.8 * var + 0.2 * (x - mean) ** 2
        out.append(mean)
    assert np.allclose(column(got, "ewma_mean"), out)


def test_rounding_and_coercion(spark):
    assert scalars.points(0.25, 10) == 2 and scalars.points(0.75, 10) == 4 and scalars.points(0.01, 10) == 1
    df = spark.createDataFrame([("1e400",), ("nan",), ("x",), (" 3 ",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.number(F.col("s"))).collect()] == [None, None, None, 3.0, None]


def test_greedy_and_exact_tests():
    assert ranking.prune_correlated(["a", "b", "c"], {("a", "b"): 0.99, ("b", "c"): 0.1, ("a", "c"): 0.2}, 0.98) == ["a", "c"]
    assert metrics.binomial_two_sided(5, 10) == 1.0 and math.isclose(metrics.binomial_two_sided(0, 5), 2 / 32)


def test_empty_tables(spark):
    df = series(spark, []).withColumn("w", F.col("v"))
    assert stats.robust_scale(df, ["k"], "v").count() == 0
    assert frames.fixed_windows(df, ["k"], "t", ["v"], 3, 1).count() == 0
    assert frames.ewma(df, "v", ["k"], ["t"], 3).count() == 0
