import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import empty, odd
from vanewright.llm import neardup

SF = "/root/testdata/sf0.001"


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], k)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, k=k).collect()}
    assert got == want


def test_family_of_edits_is_not_expanded(spark):
    """Copies with growing numbers of edits: many are linked only through others, many not at all."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for p in rng.choice(120, i % 9, replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i * 7 % 701, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == brute(rows, 4)


def test_outlier_with_the_smallest_id_is_dealt_to_few(spark):
    """One node outside a component of 5,000: the large component stays apart, whatever the names are."""
    nodes = spark.range(1, 5001).select(F.lit(1).cast("long").alias("key"), "id", F.lit(True).alias("common"), F.lit(1).cast("long").alias("c"))
    nodes = nodes.union(spark.createDataFrame([(1, 0, True, 0)], "key long, id long, common boolean, c long"))
    rows = neardup.open_buckets(nodes).withColumn("n", F.lit(100).cast("long"))
    sizes = neardup.block_counts(rows)
    dealt = neardup.deal(rows, sizes)
    assert dealt.count() == 5000 + 1 + 20 and dealt.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 400
    # long texts make more blocks
    assert neardup.block_counts(rows.withColumn("n", F.lit(100_000).cast("long"))).first()["ni"] == 500


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_further_stars_change_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "DEALT", limit)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        w = [f"f{i % 2}w{j}" for j in range(100)]
        for p in rng.choice(100, i % 7, replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    rows.append((1000, " ".join(f"long{j}" for j in range(60_000))))
    rows.append((1001, " ".join(f"long{j}" for j in range(59_000))))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == brute(rows, 4)


def test_odd_rows(spark):
    got = sorted(neardup.near_duplicates(odd(spark), k=4).collect(), key=str)
    assert len(got) == 16
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["component_id"] == 1 and by[3][0]["component_id"] == 1 and by[1][0]["kept"] and not by[2][0]["kept"]
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (4, 5, 6)) and by[7][0]["n_shingles"] == 1 and len(by[7]) == 2
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    a, b = neardup._family(240)
    s = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.95, 0.8, 0.6):
        n = round(1000 * 2 * share / (1 + share))
        t = np.concatenate([s[:n], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])
        m = np.vstack([neardup.signature(x, a, b) for x in (s, t)])
        o = neardup.odd_sketches(m)
        z = int(np.bitwise_count(o[0] ^ o[1]).sum())
        estimate = 1 + 512 / 2 * np.log(1 - 2 * z / 512) / (2 * 240)
        assert abs(estimate - share) < 0.12


def test_forest_by_matrices_equals_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 200, 150).astype(np.uint64)) for _ in range(80)]
    x, y = np.triu_indices(80, 1)
    comp, z = np.arange(80), np.zeros(len(x), int)
    big = neardup.forest(sets, comp, x, y, z, 45)
    few = [neardup.forest(sets, comp, x[a : a + 1000], y[a : a + 1000], z[:1000][: len(x[a : a + 1000])], 45) for a in range(0, len(x), 1000)]

    def parts(edges):
        up = list(range(80))

        def find(v):
            while up[v] != v:
                v = up[v]
            return v

        for p, q in edges:
            up[find(p)] = find(q)
        return {frozenset(i for i in range(80) if find(i) == find(j)) for j in range(80)}

    assert len(x) > 2000 and parts(big) == parts(sum(few, []))


def test_nodes_of_one_bucket_without_links_stay_linear(spark):
    """Single nodes: beyond DEALT pairs of blocks for each, the bucket is refined by half bands instead."""
    rng = np.random.default_rng(11)
    made = {}
    for n in (1000, 4000, 16_000):
        nodes = spark.createDataFrame([(i, rng.bytes(160)) for i in range(n)], "id long, halves binary")
        now = nodes.select(F.lit(1).cast("long").alias("key"), F.lit(3).alias("band"), "id", F.lit(True).alias("common"), F.col("id").alias("c"))
        rows = neardup.open_buckets(now).withColumn("n", F.lit(100).cast("long"))
        sizes = neardup.block_counts(rows)
        if n < 4000:
            made[n] = neardup.deal(rows, sizes).count() / n
        else:
            made[n] = neardup.refined(rows, nodes, neardup.BANDS).count() / n
    assert made[1000] <= neardup.DEALT and max(made.values()) <= neardup.HALVES


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Texts around 0.75 alike, which share bands but no links, with linked pairs hidden among them."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "DEALT", 2)
    rng = np.random.default_rng(12)
    rows = []
    for i in range(80):
        w = [f"w{j}" for j in range(240)]
        for p in rng.choice(240, 9, replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    for i in range(0, 80, 9):
        rows.append((1000 + i, rows[i][1] + " tail"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    want = brute(rows, 4)
    assert got == want and len(set(want.values())) > 30


def test_texts_of_a_common_pivot_are_copied(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PIVOT_ROWS", 10)
    rows = [(i, " ".join(f"w{j}" for j in range(100)) + f" x{i}") for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert set(got.values()) == {0}


def test_closed_buckets_are_left_behind(spark, monkeypatch):
    """What one component holds stays so: its rows are not joined again in later steps."""
    monkeypatch.setattr(neardup, "DEALT", 0)
    monkeypatch.setattr(neardup, "STAR_SHARE", 1e-9)
    steps, plain = [], neardup.open_buckets

    def seen(now):
        some = plain(now)
        steps.append([{r["key"] for r in x.select("key").distinct().collect()} for x in (now, some)])
        return some if len(steps) == 1 else some.where("false")

    monkeypatch.setattr(neardup, "open_buckets", seen)
    rows = [(i, " ".join(f"y{j}" for j in range(240)) + " tail" * (i % 2)) for i in (2000, 2001)]
    for i in range(30):
        w = [f"w{j}" for j in range(240)]
        w[8 * i + 4] = f"x{i}"
        rows += [(i, " ".join(w)), (1000 + i, " ".join(w) + " tail")]
    neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=97, bands=2).collect()
    closed = steps[0][0] - steps[0][1]
    assert len(steps) == 2 and closed and not steps[1][0] & closed


def test_bucket_rows_meet_components_once(spark, monkeypatch):
    """Open buckets are found in a written table: it is read several times, and each reading would join all rows again."""
    plans, plain = [], neardup.open_buckets

    def seen(now):
        plans.append(now._jdf.queryExecution().executedPlan().toString())
        return plain(now)

    monkeypatch.setattr(neardup, "open_buckets", seen)
    rows = [(i, " ".join(f"w{j}" for j in range(100)) + f" x{i % 3}") for i in range(9)]
    assert {r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()} == {0}
    assert plans and not any("Join" in p for p in plans)
