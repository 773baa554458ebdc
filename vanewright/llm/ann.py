"""Approximate nearest neighbours by cosine with adaptive dimension scan.

Vectors are normalised, rotated by a seeded random orthogonal matrix and put into inverted lists by a k-means fitted on
a bounded sample. On that sample it is also measured how many of its nearest lists a query has to probe. Within a list
the rotated components are scanned in column blocks: after d of D dimensions the partial squared distance, scaled by
D/d, estimates the whole one, and a candidate whose estimate is beyond the query's k-th best distance by more than a
hypothesis test allows is abandoned. The k-th best among the sample bounds this from the first block on, in every list.
Survivors are scored by the exact cosine on the original vectors.

Lists are dealt in parts of bounded size, so that a list with a third of all vectors is scanned by many tasks, and
queries in blocks of bounded size; a block of queries meets each part of the lists it probes and no other, and the
parts' best are merged by an aggregation.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

#: Bound of the sample that the lists are fitted on.
SAMPLE = 20_000
#: Rows of the sample whose k-th best is a query's first bound.
BOUND_ROWS = 1024
#: There are half as many lists as the root of the rows, up to so many; beyond, lists are dealt in more parts.
MAX_LISTS = 4096
#: Rows that a part of a list, and queries that a block of queries, is meant to hold.
PART_ROWS, QUERY_ROWS = 2048, 16_384
#: Share of the sample's nearest pairs whose list has to be probed, and sample rows that are asked for it. Clustered
#: vectors need few lists for it, vectors without clusters most of them.
REACHED, ASKED = 0.97, 500
BLOCK = 16
#: Tolerance of the hypothesis test: larger abandons later.
EPSILON = 2.1


@dataclass
class Index:
    """Rotation, list centres, the share of lists to probe and the bounding rows: at most MAX_LISTS + BOUND_ROWS rows."""

    rotation: np.ndarray
    centres: np.ndarray
    share: float
    ids: np.ndarray
    vectors: np.ndarray

    def first_found(self, names: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For unit queries the cosine of the k-th best of the bounding rows without the query's own vec_id (-inf if
        there are fewer), and the places of these best."""
        score = queries @ unit(self.vectors).T
        own = names[:, None] == self.ids[None, :]
        score[own] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        held = [b[np.isfinite(s[b])] for b, s in zip(best, score, strict=True)]
        return np.array([s[b[-1]] if len(b) == k else -np.inf for b, s in zip(held, score, strict=True)]), held


def _valid(embedding: str):
    """Non-empty, all components finite, not all zero."""
    c = F.col(embedding)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, good) & F.exists(c, lambda x: x != 0)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (first by their largest component, so that squares neither overflow nor vanish)."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def fit(vectors: DataFrame, n_rows: int, k: int = 5, sample: int = SAMPLE, reached: float = REACHED) -> Index:
    """Fit on ``sample`` rows, those with the smallest hash of vec_id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "embedding").toArrow()
    raw = np.vstack([np.asarray(r, np.float64) for r in rows["embedding"].to_pylist()])
    x = unit(raw)
    dim = x.shape[1]
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(dim, dim)))
    turned = x @ q
    centres = kmeans(turned, max(1, min(MAX_LISTS, round(n_rows**0.5 / 2))))
    _, first = np.unique(rows["vec_id"].to_numpy(), return_index=True)
    few = first[np.argsort(first)][:BOUND_ROWS]
    return Index(q, centres, probe_share(turned, centres, k, reached), rows["vec_id"].to_numpy()[few], raw[few])


def probe_share(x: np.ndarray, centres: np.ndarray, k: int, reached: float) -> float:
    """The share of its nearest lists in which a query finds ``reached`` of its k nearest, measured within ``x``."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    ranks = []
    for i in np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(score, -min(k, len(x)))[-min(k, len(x)) :]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-near[i])] = np.arange(len(centres))
        ranks.append(place[home[best[np.isfinite(score[best])]]])
    found = np.sort(np.concatenate(ranks))
    if not len(found):
        return 1.0
    return float(found[min(len(found) - 1, int(np.ceil(reached * len(found))))] + 1) / len(centres)


def scan(query: np.ndarray, rotated: np.ndarray, alive: np.ndarray, partial: np.ndarray, worst: float, tail: np.ndarray) -> np.ndarray:
    """Rows that the block-wise test does not abandon, for one rotated query.

    ``alive`` are the rows left after the first block and ``partial`` their squared distances there; ``worst`` is the
    squared distance of the query's k-th best so far (inf: none yet); ``tail`` holds for each number of scanned
    dimensions the factor by which an estimate may exceed it.
    """
    dim = len(query)
    for at in range(BLOCK, dim, BLOCK):
        d = rotated[alive, at : at + BLOCK] - query[at : at + BLOCK]
        partial = partial + np.einsum("ij,ij->i", d, d)
        done = min(at + BLOCK, dim)
        if done < dim and np.isfinite(worst):
            keep = partial * (dim / done) <= worst * tail[done]
            alive, partial = alive[keep], partial[keep]
    return alive


def distinct(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], dict[int, list[int]]]:
    """Distinct vectors, the k + 1 smallest vec_ids of each, and the vectors of each vec_id.

    Equal vectors score the same and ties go to the smaller vec_id, so no other vec_id of a vector is among the best k
    for its sake, with the query's own vec_id left out.
    """
    rows, inverse = np.unique(vectors, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([inverse.ravel(), ids]), axis=0)
    held = np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1)
    of: dict[int, list[int]] = {}
    for u, i in pairs.tolist():
        of.setdefault(i, []).append(u)
    return rows, [h[: k + 1] for h in held], of


def search_part(ids: np.ndarray, vectors: np.ndarray, queries: pd.DataFrame, rotation: np.ndarray, k: int, epsilon: float) -> list[tuple[int, int, float]]:
    """(query, vec_id, exact cosine) of the best k vec_ids of one part for each query, without those that are worse
    than its ``bound`` (a column of ``queries`` that may be missing).

    The first column block is scanned for many queries at once. Products of whole blocks differ in their last bits
    between equal rows: everything within that rounding of the k-th is kept until the exact cosine has ranked it.
    """
    rows, held, of = distinct(ids, vectors, k)
    original = unit(rows)
    rotated = original @ rotation
    dim = rotated.shape[1]
    rounding = 16 * (dim + 16) * np.finfo(np.float64).eps
    tail = np.r_[1.0, (1 + epsilon / np.sqrt(np.arange(1, dim + 1))) ** 2]
    first = min(BLOCK, dim)
    head = np.ascontiguousarray(rotated[:, :first])
    norms = np.einsum("ij,ij->i", head, head)
    bounds = queries["bound"].to_numpy(np.float64) if "bound" in queries else np.full(len(queries), -np.inf)
    names, raw = queries["query_id"].to_numpy(np.int64), queries["embedding"].to_numpy()
    out = []
    for at in range(0, len(queries), 256):
        exact = unit(np.vstack(raw[at : at + 256]))
        turned = exact @ rotation
        near = norms[None, :] + np.einsum("ij,ij->i", turned[:, :first], turned[:, :first])[:, None] - 2 * (turned[:, :first] @ head.T)
        for row, q in enumerate(exact):
            name, bound = int(names[at + row]), bounds[at + row]
            # the bound is a cosine of other products: its own rounding is allowed for
            least = bound - rounding
            worst = max(0.0, 2 - 2 * bound) + 1e-9
            partial = near[row]
            alive = np.flatnonzero(partial * (dim / first) <= worst * tail[first]) if first < dim and np.isfinite(worst) else np.arange(len(rows))
            alive = scan(turned[row], rotated, alive, partial[alive], worst, tail)
            score = original[alive] @ q
            order = np.flatnonzero(score >= least)
            order = order[np.argsort(-score[order], kind="stable")]
            best: dict[int, float] = {}  # cosine by vec_id, of all within the rounding of the k-th
            for u, c in zip(alive[order].tolist(), score[order].tolist(), strict=True):
                if len(best) >= k and c < least:
                    break
                for i in held[u].tolist():
                    if i != name and c > best.get(i, -np.inf):
                        best[i] = c
                if len(best) >= k:
                    least = max(least, heapq.nlargest(k, best.values())[-1] - rounding)
            known = {u: cosine(raw[at + row], rows[u]) for u in {u for i in best for u in of[i]}}
            ranked = sorted((-max(known[u] for u in of[i]), i) for i in best)
            out += [(name, i, -c) for c, i in ranked[:k]]
    return out


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine in double precision, of original components."""
    x, y = (np.asarray(v, np.float64) / np.abs(v).max() for v in (x, y))
    return float(np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, reached: float = REACHED, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose vec_id is divisible by ``every``.

    Candidates are all rows but those with the query's vec_id; ties go to the smaller vec_id. Vectors that are null,
    empty, zero, or hold a null or non-finite component take no part, nor do rows with a null vec_id, nor vectors of
    another length than the most common one (the shorter, if two are). Rows that repeat a vec_id are one candidate with
    the best of their scores, and one query each with the first of their vectors. An empty table gives no rows.
    ``reached`` is the share of nearest pairs that probing has to reach on the sample; 1 probes all lists.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & _valid("embedding"))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]
    good = good.where(F.size("embedding") == dim)
    fitted = fit(good, n, k, reached=reached)
    if reached >= 1:
        fitted.share = 1.0
    index = spark.sparkContext.broadcast(fitted)  # bounded: (MAX_LISTS + BOUND_ROWS) x dim

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            x = unit(np.vstack([np.asarray(v, np.float64) for v in b.column("embedding").to_pylist()])) if b.num_rows else np.zeros((0, dim))
            near = (x @ ix.rotation @ ix.centres.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], [*b.schema.names, "list"])

    placed = scratch.save(good.mapInArrow(place, "vec_id long, embedding array<double>, list int"), "placed")
    # at most MAX_LISTS rows
    parts = {r["list"]: -(-r["count"] // PART_ROWS) for r in placed.groupBy("list").count().collect()}
    queries = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-placed.where(F.col("vec_id") % every == 0).count() // QUERY_ROWS))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                raw = [np.asarray(v, np.float64) for v in b.column("embedding").to_pylist()]
                bound, held = ix.first_found(b.column("query_id").to_numpy(), unit(np.vstack(raw)), k)
                ids, scores = ([[f(q, j) for j in js.tolist()] for q, js in zip(raw, held, strict=True)] for f in (lambda q, j: int(ix.ids[j]), lambda q, j: cosine(q, ix.vectors[j])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], [*b.schema.names, "bound", "ids", "scores"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        have = np.array(sorted(parts), np.int64)
        probes = max(1, int(np.ceil(ix.share * len(have))))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                x = unit(np.vstack([np.asarray(v, np.float64) for v in b.column("embedding").to_pylist()]))
                order = np.argsort(-(x @ ix.rotation @ ix.centres[have].T), axis=1)[:, :probes]
                dealt = [(i, int(have[j]), s) for i, row in enumerate(order) for j in row for s in range(parts[int(have[j])])]
                at, lists, salts = (np.array(x) for x in zip(*dealt, strict=True))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array(lists, pa.int32()), pa.array(salts, pa.int32())], [*b.schema.names, "list", "salt"])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    asked = "query_id long, embedding array<double>, block int, bound double"
    begun = scratch.save(queries.select(F.col("vec_id").alias("query_id"), "embedding", block).mapInArrow(begin, f"{asked}, ids array<long>, scores array<double>"), "begun")
    sent = begun.select("query_id", "embedding", "block", "bound").mapInArrow(probe, f"{asked}, list int, salt int")
    sent = scratch.save(sent, "sent")
    table = spark.createDataFrame(list(parts.items()), "list int, parts int")
    salted = placed.join(F.broadcast(table), "list").select("vec_id", "embedding", "list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("salt"))
    # a part goes to the blocks that probe it
    salted = salted.join(sent.select(*(F.col(c).alias(c) for c in ("list", "salt", "block"))).distinct(), ["list", "salt"])

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = search_part(left["vec_id"].to_numpy(np.int64), np.vstack(left["embedding"].to_numpy()), right, index.value.rotation, k, epsilon)
        pdf = pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return pdf

    key = ("list", "salt", "block")
    found = salted.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(find, "query_id long, vec_id long, score double")
    start = begun.select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("z")).select("query_id", "z.vec_id", "z.score")
    found = found.union(start).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # a query has at most k rows from each part
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth embedding."""
    return nearest(read(spark, sf_dir, "embeddings"))
