import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.oracle import differences
from vanewright.llm import negatives
from vanewright.llm.common import Scratch

SF = "/root/testdata/sf0.01"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100):
    """Over all pairs, one by one, in whole numbers."""
    base = sorted({(i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)})
    out = []
    for a, la, va in base:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb, strict=False)), b, lb) for b, lb, vb in base if b != a)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            inside = [(n, t) for t, n, ln in scored if ln != la and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, i, n, -s, -t) for i, (n, t) in enumerate(inside, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<double>, rank int")


def made(seed, n, dim, labels, spread):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 0.8
    v /= np.linalg.norm(v, axis=1)[:, None] * np.exp(spread * rng.normal(size=n))[:, None]
    return [(int(i), int(rng.integers(labels)), x.tolist()) for i, x in zip(rng.permutation(n), v, strict=True)]


def test_query_equals_sql(spark):
    assert differences(spark, SF, negatives.op11_norm_bucket_negatives, negatives.OP11_SQL) == []
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = [(r[0], (r[1] + 1) % 10 if r[0] % 7 == 0 else r[1], r[2]) for r in df.collect()]
    want = plain(rows)
    assert got(negatives.op11_norm_bucket_negatives(spark, SF)) == want and want


def test_many_buckets_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 60)
    monkeypatch.setattr(negatives, "SPANS", 3)
    for seed, spread in ((1, 0.0), (2, 0.7)):
        rows = made(seed, 900, 6, 3, spread)
        assert got(negatives.hard_negatives(table(spark, rows), F.col("label"), every=30)) == plain(rows, 30)


def test_ties_and_one_vector_for_a_third(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 50)
    rng = np.random.default_rng(3)
    rows = [(i, i % 4, [1.0, 0.5] if i % 3 == 0 else rng.integers(-2, 3, 2).astype(float).tolist()) for i in range(600)]
    assert got(negatives.hard_negatives(table(spark, rows), F.col("label"), every=50)) == plain(rows, 50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.9, 0.5]), (0, 1, [0.3, 0.4]), (1, 1, [1.0, 0.25]), (1, 1, [1.0, 0.25]), (2, 1, [0.5]), (3, 2, [0.5, 0.5]), (4, 2, [0.5, -0.0]), (5, 2, [0.5, 0.0]), (6, 2, []), (7, 1, []),
        (8, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (9, 1, None), (10, 1, [None, 1.0]), (11, 1, [nan, 1.0]), (12, 1, [inf, 1.0]), (13, 2, [1e5, 1e5]), (100, 2, [2e4, -3e4]), (101, 2, [2e4, -3e4, 1.0]), (102, 1, [1e4, -2.5e4]), (-100, 2, [-1.0, -1.0]),
    ]
    got_rows = got(negatives.hard_negatives(table(spark, rows), F.col("label")))
    assert got_rows == plain(rows) and {r[0] for r in got_rows} >= {0, 100}
    assert negatives.hard_negatives(table(spark, rows).where("false"), F.col("label")).count() == 0
    beyond = [(14, 1, [1e300, 1.0]), (15, 1, [2.0**21, 0.0]), (200, 1, [2.0**20, 0.0])]
    assert got(negatives.hard_negatives(table(spark, rows + beyond), F.col("label"))) == plain([*rows])


def test_bound_prunes(spark, monkeypatch):
    """With norms that differ, most products are never made."""
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 200)
    rows = made(5, 4000, 8, 2, 0.9)
    base = Scratch(spark, "test").save(negatives.integer_rows(table(spark, rows), F.col("label")), "rows")
    buckets = negatives.write_buckets(Scratch(spark, "test"), base)
    assert len(buckets) > 10 and sum(b.rows for b in buckets) == 4000 and [b.top for b in buckets] == sorted((b.top for b in buckets), reverse=True)
    asked = base.where("id % 100 = 0").toPandas()
    asked["low"], asked["high"] = [[negatives.LEAST]] * len(asked), [[negatives.MOST]] * len(asked)
    found, count = negatives.search(asked, buckets, True, 5)
    assert (found.n == 5).all() and count < 0.2 * 4000 * len(asked)


def test_products_are_exact():
    rng = np.random.default_rng(6)
    for size in (200, 30_000, 2**22):
        a, b = rng.integers(-size, size, (7, 5)).astype(float), rng.integers(-size, size, (9, 3)).astype(float)
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=False)) for q in b] for p in a]
        assert negatives.products(a, b, float(np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max())).tolist() == want


def test_windows_merge():
    w = negatives.Windows(np.array([[0]]), np.array([[100]]), 2)
    for s, i in ((5, 9), (7, 3), (7, 1), (5, 1)):
        w.add(0, np.array([0]), np.array([s]), np.array([i]))
    assert w.score[0, 0].tolist() == [7, 7] and w.id[0, 0].tolist() == [1, 3] and w.limit[0, 0] == 7
    assert isinstance(negatives._hits(pd.DataFrame({"id": [1], "row": ["a"], "label": [1], "q": [b"\0" * 8], "norm": [0.0], "low": [[0]], "high": [[1]]}), [], True, 2), pd.DataFrame)
