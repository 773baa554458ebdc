"""Queries that have no SQL against plain versions."""

import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanewright.operators import fusion, ml
from vanewright.plans import catalog, queries_streaming
from vanewright.streaming import replay
from vanewright.streaming.step import State, step

SF = "/root/testdata/sf0.001"


def test_spaced_selection(spark):
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "value", "ts").collect():
        rows[r["user_id"]].append((-r["value"], r["event_id"], r["ts"]))
    want = set()
    for user, items in rows.items():
        chosen = []
        for _, i, t in sorted(items):
            if len(chosen) < 5 and all(abs((t - u).total_seconds()) >= 24 * 3600 for _, u in chosen):
                chosen.append((i, t))
        want |= {(user, i, k + 1) for k, (i, _) in enumerate(chosen)}
    got = {(r["user_id"], r["event_id"], r["rank"]) for r in catalog.QUERIES["t06_spaced_selection"](spark, SF).collect()}
    assert got == want


def test_replay_equals_a_plain_loop(spark):
    got = {(r["source"], r["ts"]): r for r in catalog.QUERIES["r01_causal_replay"](spark, SF).collect()}
    lay = replay.layout([f"{b}_{s}" for b in queries_streaming.BASES for s in queries_streaming.STATS], ["purchase_avg", "signup_avg", "view_avg"], {"shop": ["purchase", "signup"], "site": ["click", "view"], "faults": ["error"]})
    states, seen = {}, 0
    for r in queries_streaming._wide(spark, SF).orderBy("ts").collect():
        state = states.setdefault(r["source"], State())
        x = np.array([r["values"].get(s, np.nan) for s in lay["signals"]], float)
        out = step(state, {"time": r["ts"].timestamp(), "status": r["status"], "x": x, **{k: lay[k] for k in ("bases", "power", "groups")}}, queries_streaming.CFG)
        row = got[r["source"], r["ts"]]
        assert (row["state"], row["families"]) == (out["state"], out["families"]) and abs(row["score"] - out["score"]) < 1e-9
        seen += 1
    assert seen == len(got) > 300 and len(states) == 3


def merged(episodes, gap):
    out = []
    for s, e, v, f in sorted(episodes):
        if out and 0 <= s - out[-1][1] <= gap and out[-1][3] & f:
            p = out[-1]
            out[-1] = (p[0], max(p[1], e), max(p[2], v), p[3] | f, p[4] + 1)
        else:
            out.append((s, e, v, set(f), 1))
    return out


def test_merged_candidates_and_their_distance(spark):
    rng = np.random.default_rng(2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(hours=float(a)), t0 + dt.timedelta(hours=float(a + b)), float(v), [f"f{int(v * 7) % 3}"]) for k in range(4) for a, b, v in rng.random((40, 3)) * [400, 6, 1]]
    df = spark.createDataFrame(rows, "user_id int, start timestamp, end timestamp, score double, families array<string>")
    got = collections.Counter((r["user_id"], r["start"], r["end"], r["n"], tuple(r["families"])) for r in fusion.merge_candidates(df, ["user_id"], 6.0).collect())
    want = collections.Counter()
    for k in range(4):
        items = [((s - t0).total_seconds(), (e - t0).total_seconds(), v, set(f)) for u, s, e, v, f in rows if u == k]
        want.update((k, t0 + dt.timedelta(seconds=round(s, 6)), t0 + dt.timedelta(seconds=round(e, 6)), n, tuple(sorted(f))) for s, e, _, f, n in merged(items, 6 * 3600))
    assert {x[0::3] for x in got} == {x[0::3] for x in want} and sum(got.values()) == sum(want.values())
    out = catalog.QUERIES["d18_offlog_candidates"](spark, SF)
    log = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 97 = 0").select(F.col("user_id").alias("u"), F.col("ts").cast("timestamp").alias("a"))
    near = out.join(log, (F.col("u") == F.col("user_id")) & (F.col("end") >= F.col("a") - F.expr("interval 24 hours")) & (F.col("start") <= F.col("a") + F.expr("interval 48 hours")))
    assert near.count() == 0 and out.where("rank > 5 or priority < 0.4").count() == 0 and out.count() > 0


def test_reconstruction_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding is not null").collect()]
    x = np.array([v for _, v in rows], float)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    basis = vectors[:, np.argsort(-values)[:8]]
    error = np.abs(z - z @ basis @ basis.T).mean(axis=1)
    got = {r["vec_id"]: r["score"] for r in catalog.QUERIES["m12_reconstruction_scores"](spark, SF).collect()}
    assert len(got) == len(rows) and max(abs(got[i] - e) for (i, _), e in zip(rows, error, strict=True)) < 1e-6


def test_thresholds_and_comparison_equal_a_plain_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, m, "s", int(y), float(np.clip(0.5 * y + rng.random() * 0.6, 0, 1))) for m in ("a", "b") for i, y in enumerate(rng.random(90) < 0.3)]
    p = spark.createDataFrame(rows, "id int, fold int, model string, setting string, actual int, probability double")
    got = {r["model"]: r for r in ml.thresholds(p).collect()}
    for m in ("a", "b"):
        y, s = (np.array([r[k] for r in rows if r[2] == m]) for k in (4, 5))
        best = max(((y[s >= k / 20 - 1e-9].sum() / y.sum() + 1 - (1 - y)[s >= k / 20 - 1e-9].sum() / (1 - y).sum()) / 2, k) for k in range(22) if (1 - y)[s >= k / 20 - 1e-9].sum() / (1 - y).sum() <= 0.2)
        assert got[m]["threshold"] == pytest.approx(best[1] / 20) and got[m]["balanced_accuracy"] == pytest.approx(best[0])
        wins = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
        assert got[m]["auc"] == pytest.approx(wins)
    c = {r["model"]: r for r in ml.fold_comparison(p, ml.thresholds(p)).collect()}
    for m in ("a", "b"):
        per = []
        for k in range(3):
            y, hit = (np.array([f(r) for r in rows if r[2] == m and r[1] == k]) for f in (lambda r: r[4], lambda r: r[5] >= got[m]["threshold"]))
            per.append((hit[y == 1].mean() + (~hit)[y == 0].mean()) / 2)
        assert c[m]["mean_balanced_accuracy"] == pytest.approx(np.mean(per)) and c[m]["std_balanced_accuracy"] == pytest.approx(np.std(per, ddof=1))


def test_folds_are_stratified_and_ranks_whole(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "id int, label int")
    x = ml.folds(df, "id", "label", 5, 1).collect()
    assert all(collections.Counter(r["fold"] for r in x if r["label"] == y) == collections.Counter({k: n for k in range(5)}) for y, n in ((1, 20), (0, 60)))
    for k in range(5):
        halves = collections.Counter((r["label"], r["inner"]) for r in x if r["fold"] != k)
        assert abs(halves[1, 0] - halves[1, 1]) <= 4 and abs(halves[0, 0] - halves[0, 1]) <= 4


def test_votes_and_final_fit_score_every_row_once(spark):
    final = catalog.QUERIES["m05_final_fit"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/labels.parquet").count()
    assert len(final) == n == len({r["doc_id"] for r in final}) and all(0 <= r["probability"] <= 1 and r["decision"] in (0, 1) for r in final)
    x = spark.createDataFrame([(i, int(i % 3 == 0), float(i % 3 == 0) + 0.1 * (i % 7), float(i % 5)) for i in range(120)], "id int, label int, a double, b double")
    v = ml.nested_cv(x, "id", "label", ["a", "b"], 2, 2).collect()
    assert collections.Counter(r["id"] for r in v) == collections.Counter({i: 2 for i in range(120)})
    assert np.mean([(r["probability"] >= 0.5) == r["actual"] for r in v]) > 0.9
