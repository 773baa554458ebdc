import math

import numpy as np
from pyspark.sql import functions as F

from vanewright.operators.ml import nearest_information, neighbour_information
from vanewright.plans.fixtures import hourly
from vanewright.plans.queries_scale import PAIRS, m16_neighbours


def plain(x, y, k=3):
    """Row by row over all others."""
    n = len(x)
    if n <= k:
        return 0.0
    psi = lambda m: sum(1 / i for i in range(1, m)) - np.euler_gamma
    total = 0.0
    for i in range(n):
        r = sorted(max(abs(x[i] - x[j]), abs(y[i] - y[j])) for j in range(n) if j != i)[k - 1]
        r = math.nextafter(r, 0)
        total += sum(psi(max(1, sum(abs(v[i] - v[j]) <= r for j in range(n)))) for v in (x, y))
    return max(0.0, psi(n) + psi(k) - total / n)


def test_estimate_equals_brute_force_and_finds_dependence():
    rng = np.random.default_rng(1)
    x = rng.normal(size=120)
    for y in (x + 0.1 * rng.normal(size=120), rng.normal(size=120), np.round(x), np.zeros(120)):
        for block in (7, 512):
            assert math.isclose(nearest_information(x, y, 3, block), plain(x, y), abs_tol=1e-9)
    assert nearest_information(x, x + 0.01 * rng.normal(size=120), 3) > 1.5 > 0.3 > nearest_information(x, rng.normal(size=120), 3)
    assert nearest_information(x[:3], x[:3], 3) == 0.0 and nearest_information(x[:0], x[:0], 3) == 0.0


def test_pairs_of_signals(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    rows = [(i, float(v), float(v**2), float(rng.normal()), 1.0) for i, v in enumerate(a)] + [(900, None, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, flat double")
    got = {(r["i"], r["j"]): r for r in neighbour_information(df, ["a", "b", "c", "flat"], "id").collect()}
    assert len(got) == 6 and got["a", "b"]["weight"] == 1.0 and got["a", "c"]["weight"] < 0.3
    few = neighbour_information(df, ["a", "b"], "id", most=50).first()
    assert few["mi"] > 0 and neighbour_information(df.where("false"), ["a", "b"], "id").agg(F.sum("weight")).first()[0] == 0.0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    wide = hourly(spark, sf).groupBy("t").pivot("base", list(PAIRS)).agg(F.first("value")).dropna().orderBy("t").toPandas()
    found = {(r["i"], r["j"]): (r["mi"], r["weight"]) for r in m16_neighbours(spark, sf).collect()}
    assert len(found) == 10 and len(wide) > 3
    want = {}
    for i, j in found:
        x, y = (wide[c].to_numpy(float) / wide[c].std(ddof=0) for c in (i, j))
        want[i, j] = nearest_information(x, y, 3, 64)  # equal to the plain one by the test above
    scale = float(np.quantile([v for v in want.values() if v > 0], 0.95))
    assert all(abs(found[p][0] - want[p]) < 2e-6 and abs(found[p][1] - min(1.0, want[p] / scale)) < 1e-4 for p in found)
