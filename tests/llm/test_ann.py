import numpy as np
from pyspark.sql import functions as F

from vanewright.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    u = ann.unit(np.array([v for _, v in rows], float))
    out = {}
    for i, q in zip(ids, u, strict=True):
        if i % 50 == 0:
            s = u @ q
            out[int(i)] = [int(j) for _, j in sorted((-c, j) for c, j in zip(s, ids, strict=True) if j != i)[:k]]
    return out


def test_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in e.collect()])
    got = {}
    for r in ann.nearest(e).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_recall_on_clusters_with_few_probes(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[rng.integers(0, 60)] + 0.15 * rng.normal(size=32)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.fit(df, 6000, sample=2000)
    assert index.share < 0.25
    want, got = brute(rows), {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_many_equal_vectors_among_others(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 128)
    for seed in range(4):
        rng = np.random.default_rng(seed)
        same = rng.normal(size=24)
        copies = set(rng.choice(np.arange(1, 1500), 300, replace=False).tolist()) | {50}
        rows = [(i, same.tolist() if i in copies else rng.normal(size=24).tolist()) for i in range(1500)]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 50").orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == sorted(copies - {50})[:5]


def test_bounds_of_the_sample():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 6))
    x = ann.unit(v)
    ix = ann.Index(np.eye(6), x[:3], 1.0, np.arange(40), v)
    bound, held = ix.first_found(np.arange(40), x, 5)
    assert np.allclose(bound, [np.sort(np.delete(x @ x[i], i))[-5] for i in range(40)]) and all(len(h) == 5 and i not in h for i, h in enumerate(held))
    bound, held = ann.Index(np.eye(6), x[:3], 1.0, np.arange(5), v[:5]).first_found(np.arange(2), x[:2], 5)
    assert bound.max() == -np.inf and [len(h) for h in held] == [4, 4]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (9, [], 1), (None, [1.0, 0.0], 1), (50, [0.0, 3.0], 1), (50, [0.0, 3.0], 1), (11, [1e-300, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").withColumn("score", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 11, 50] and [g[1] for g in got if g[0] == 50] == [1, 2, 3, 4]
    assert ann.nearest(df.where("false")).count() == 0


def test_hot_list_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 16)
    rng = np.random.default_rng(0)
    rows = [(i, (np.ones(8) if i % 3 else rng.normal(size=8)).tolist()) for i in range(301)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), reached=1.0).where("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 4, 5, 7]


def test_repeated_neighbour_leaves_room(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_LISTS", 1)
    rng = np.random.default_rng(3)
    rows = [(50, [1.0, 0.0])] + [(1, [1.0, 1e-3 * j]) for j in range(12)] + [(1, [1.0, 0.0])] * 8 + [(i, [1.0, 0.1 * i]) for i in range(2, 9)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), reached=1.0).where("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and got[0]["score"] == 1.0


def test_equal_vectors_give_the_smallest_ids():
    rng = np.random.default_rng(4)
    for n in (5, 7, 101, 255, 700):
        for dim in (3, 64, 127):
            v, q = rng.normal(size=dim), rng.normal(size=dim)
            ids = rng.permutation(np.arange(1, n + 1))
            queries = ann.pd.DataFrame({"query_id": [50], "embedding": [q]})
            got = ann.search_part(ids, np.tile(v, (n, 1)) * 2.0 ** rng.integers(0, 3, size=(n, 1)), queries, np.eye(dim), 5, ann.EPSILON)
            assert [i for _, i, _ in got] == [1, 2, 3, 4, 5]
