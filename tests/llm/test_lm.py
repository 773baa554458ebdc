import collections
import math
import zlib

import pytest

from tests.llm.fixtures import empty, odd
from vanewright.llm import lm

SF = "/root/testdata/sf0.001"


def reference(rows, order):
    """Plain interpolated modified Kneser-Ney of any order."""
    seq = lambda t: ["<s>"] * (order - 1) + [*(t or "").encode().lower().split(), "</s>"]
    counts = {order: collections.Counter(), 0: collections.Counter()}
    for _, t in rows:
        s = seq(t)
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
            counts[0][s[i]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k in range(1, order + 1):
        n = collections.Counter(counts[k].values())
        disc[k] = (0.0, *lm.discounts({f"n{j}": n[j] for j in range(1, 5)}))
        ctx[k] = collections.defaultdict(lambda: [0, 0.0])
        for g, c in counts[k].items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][1] += disc[k][min(c, 3)]
    v = len(counts[1])

    def p(history, w):
        total, spare = ctx[1][()]
        c = counts[1][(w,)]
        out = max(c - disc[1][min(c, 3)], 0) / total + spare / total / (v + 1)
        for k in range(2, order + 1):
            h = tuple(history[len(history) - k + 1 :])
            if h in ctx[k]:
                total, spare = ctx[k][h]
                c = counts[k][(*h, w)]
                out = (max(c - disc[k][min(c, 3)], 0) + spare * out) / total
        return out

    def score(t):
        s = seq(t)
        return sum(math.log10(p(s[i - order + 1 : i], s[i])) for i in range(order - 1, len(s)))

    return score, counts[0], p, counts


@pytest.mark.parametrize("order", [2, 3])
def test_against_plain_model(spark, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    score, words, _, _ = reference(train, order)
    model = lm.train(docs.where(lm.crc_mod("doc_id", 5) != 1), order)
    got = {r["doc_id"]: r for r in lm.score_texts(docs, model).collect()}
    n, v = sum(words.values()), len(words)
    for i, t in rows:
        toks = [*(t or "").encode().lower().split(), "</s>"]
        assert got[i]["n_tokens"] == len(toks) and got[i]["n_known"] == sum(words[w] > 0 for w in toks)
        assert math.isclose(got[i]["score"], score(t), rel_tol=1e-5)
        assert math.isclose(got[i]["base_score"], sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks), rel_tol=1e-9)


def test_probabilities_add_up_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a", None])]
    score, words, p, counts = reference(rows, 2)
    for h in (["a"], ["b"], ["<s>"], ["never"]):
        assert math.isclose(sum(p(h, w) for w in words) + p(h, "unknown"), 1.0, rel_tol=1e-9)


def test_odd_rows(spark):
    docs = odd(spark)
    got = lm.score_texts(docs, lm.train(docs)).collect()
    assert len(got) == 16 and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in got)
    none = lm.train(empty(spark))
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in lm.score_texts(docs, none).collect())
    assert lm.score_texts(empty(spark), none).count() == 0
