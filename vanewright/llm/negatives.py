"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm, largest first, and written as buckets: one file for each range partition, in slices of
bounded size. By Cauchy and Schwarz no score of a bucket exceeds the anchor's norm times the bucket's largest norm. An
anchor's windows of scores (one for each positive) each ask for the first few candidates within the window. A bucket is
passed over where that bound lies below every window's limit: the larger of its lower end and the score of the last one
found so far, if the window is full. As norms only fall, so does everything behind it.

A first round takes buckets of BUCKET_ROWS rows, each later one eight times the rows of all before: what earlier rounds
have found raises the limits of the next. In a round, groups of anchors meet spans of buckets; a task reads its span's slices one by one, scores them by a product of
integer matrices and keeps the best of each window. Positives come from the same search, by one window without ends
over candidates of the anchor's label.

All candidates with the same vector and label score alike, so those with the smallest ids come first: of each such group
as many are kept as a window asks for, and one more as the anchor may be among them.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, open_store, read

#: Candidates that a bucket is meant to hold at least, buckets at most (their list is the driver's), and rows of a slice.
BUCKET_ROWS, MAX_BUCKETS, SLICE = 65_536, 10_000, 4096
#: Anchors that a group is meant to hold, and spans of buckets in a round.
ANCHORS, SPANS = 2048, 32
#: Integer vectors of this norm or more take no part: 100 times a score has to fit into 64 bits.
MAX_NORM = 2.0**28
LEAST, MOST = -(2**63), 2**63 - 1
SLACK = 1 + 1e-9


@dataclass
class Bucket:
    """A file of candidates in falling norm, and its largest norm."""

    path: str
    rows: int
    top: float


def integer_rows(rows: DataFrame, label: Column) -> DataFrame:
    """(id, label, q, norm) of the rows that take part: q has the components floor(256 * x) as doubles, little-endian."""
    v = F.col("embedding")
    whole = F.col("vec_id").isNotNull() & v.isNotNull() & label.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    picked = rows.where(whole).select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), v.cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, qs, norms = [], [], []
            for i, x in enumerate(batch.column("v")):
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(256 * np.asarray(x.values.to_numpy(zero_copy_only=False), "<f8")) + 0.0
                    norm = float(np.sqrt(q @ q))
                if norm < MAX_NORM:
                    keep.append(i)
                    qs.append(q.tobytes())
                    norms.append(norm)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), pa.array(qs, pa.binary()), pa.array(norms, pa.float64())], ["id", "label", "q", "norm"])

    return picked.mapInArrow(run, "id long, label long, q binary, norm double").dropDuplicates(["id", "label", "q"])


def write_buckets(scratch: Scratch, candidates: DataFrame) -> list[Bucket]:
    """Candidates in buckets of falling norm. The list of buckets has MAX_BUCKETS entries at most."""
    n = candidates.count()
    root = scratch.path("buckets")
    size = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at, top, slices = f"{root}/{uuid.uuid4().hex}", 0, None, []
        store, inner = open_store(path)
        out = None
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                qs = [np.frombuffer(x.as_py(), "<f8") for x in batch.column("q")]
                v = np.zeros((len(qs), max(1, *map(len, qs))))
                for i, q in enumerate(qs):
                    v[i, : len(q)] = q
                small = bool(np.abs(v).max() < 2**15)
                norms = batch.column("norm").to_numpy()
                ids, labels = (batch.column(c).to_numpy().astype("<i8") for c in ("id", "label"))
                data = ids.tobytes() + labels.tobytes() + v.astype("<i2" if small else "<f8").tobytes()
                if out is None:
                    store.create_dir(os.path.dirname(inner), recursive=True)
                    out, top = store.open_output_stream(inner), float(norms[0])
                out.write(data)
                slices.append((at, len(ids), v.shape[1], int(small), float(norms[0])))
                at += len(data)
        if out is not None:
            out.close()
            with store.open_output_stream(inner + ".slices") as index:
                index.write(json.dumps(slices).encode())
            yield pa.RecordBatch.from_pylist([{"path": path, "rows": sum(s[1] for s in slices), "top": top}])

    parts = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    ordered = candidates.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    written = scratch.save(ordered.mapInArrow(run, "path string, rows long, top double"), "written")
    return [Bucket(*r) for r in written.orderBy(F.desc("top"), "path").collect()]


def read_slices(buckets: Iterable[Bucket]) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """(largest norm, ids, labels, vectors) of the slices of some buckets in turn; the first ones in small pieces, as they
    are scored before anything is found."""
    piece = 64
    for bucket in buckets:
        store, inner = open_store(bucket.path)
        with store.open_input_stream(inner + ".slices") as f:
            slices = json.loads(f.read())
        with store.open_input_file(inner) as f:
            for at, n, dim, small, top in slices:
                f.seek(at)
                data = f.read((16 + dim * (2 if small else 8)) * n)
                ids, labels = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n)
                v = np.frombuffer(data, "<i2" if small else "<f8", n * dim, 16 * n).reshape(n, dim)
                start = 0
                while start < n:
                    yield top, ids[start : start + piece], labels[start : start + piece], v[start : start + piece]
                    start += piece
                    piece = min(SLICE, 2 * piece)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer rows as 64-bit integers; ``bound`` is at least any product of two norms, and so at
    least any partial sum."""
    width = max(a.shape[1], b.shape[1])
    a, b = (x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Windows:
    """The best found so far in each window of a group of anchors."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.limit, self.high, self.k = low.copy(), high, k
        self.score = np.full((*low.shape, k), LEAST, np.int64)
        self.id = np.full((*low.shape, k), MOST, np.int64)
        self.n = np.zeros(low.shape, np.int64)

    def add(self, j: int, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores into window j of the anchors ``row``."""
        touched = np.unique(row)
        have = np.arange(self.k)[None, :] < self.n[touched, j][:, None]
        r = np.concatenate([row, np.broadcast_to(touched[:, None], have.shape)[have]])
        s = np.concatenate([score, self.score[touched, j][have]])
        i = np.concatenate([ids, self.id[touched, j][have]])
        by = np.lexsort((i, -s, r))
        r, s, i = r[by], s[by], i[by]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < self.k
        r, s, i, rank = r[keep], s[keep], i[keep], rank[keep]
        self.score[r, j, rank], self.id[r, j, rank] = s, i
        self.n[touched, j] = np.minimum(self.k, np.bincount(r, minlength=len(self.n))[touched])
        full = touched[self.n[touched, j] == self.k]
        self.limit[full, j] = np.maximum(self.limit[full, j], self.score[full, j, self.k - 1])


def search(anchors: pd.DataFrame, buckets: list[Bucket], same: bool, k: int) -> tuple[Windows, int]:
    """Each window's first k of some buckets among rows with (``same``) or without the anchor's label, and how many
    products of an anchor and a candidate were made. Anchors have id, label, q, norm, low and high (lists)."""
    qs = [np.frombuffer(q, "<f8") for q in anchors["q"]]
    q = np.zeros((len(qs), max(1, *map(len, qs))))
    for i, x in enumerate(qs):
        q[i, : len(x)] = x
    width = max(map(len, anchors["low"]))
    low, high = np.full((len(qs), width), MOST), np.full((len(qs), width), LEAST)
    for i, (a, b) in enumerate(zip(anchors["low"], anchors["high"], strict=True)):
        low[i, : len(a)], high[i, : len(b)] = a, b
    names, labels, norm = (anchors[c].to_numpy() for c in ("id", "label", "norm"))
    found, made = Windows(low, high, k), 0
    top_end = high.max(axis=1)
    for top, ids, other, v in read_slices(buckets):
        active = np.flatnonzero(norm * top * SLACK >= found.limit.min(axis=1))
        if not len(active):
            break
        made += len(active) * len(ids)
        s = products(q[active], v, float(norm[active].max()) * top * SLACK)
        r, c = np.nonzero((s >= found.limit[active].min(axis=1)[:, None]) & (s <= top_end[active][:, None]))
        s, r = s[r, c], active[r]
        ok = (ids[c] != names[r]) & ((other[c] == labels[r]) == same)
        s, r, c = s[ok], r[ok], c[ok]
        for j in range(width):
            inside = (s >= found.limit[r, j]) & (s <= high[r, j])
            if inside.any():
                found.add(j, r[inside], s[inside], ids[c[inside]])
    return found, made


HITS = "id long, row string, window int, other long, score long"


def best_of_windows(scratch: Scratch, anchors: DataFrame, buckets: list[Bucket], same: bool, k: int) -> DataFrame:
    """(id, row, window, other, score): the first k candidates, by score and then by id, in each window of each anchor.

    Anchors have id, row (which tells rows of one id apart), label, q, norm, and arrays low and high of the same length.
    """
    groups = max(-(-anchors.count() // ANCHORS), 2 * anchors.sparkSession.sparkContext.defaultParallelism)
    anchors = scratch.save(anchors.withColumn("part", F.pmod(F.xxhash64("id", "row"), groups)), "anchors")
    best = anchors.sparkSession.createDataFrame([], HITS)
    done, window = 0, Window.partitionBy("id", "row", "window").orderBy(F.desc("score"), "other")
    while done < len(buckets):
        rows = list(accumulate(b.rows for b in buckets))
        least = max(BUCKET_ROWS, 9 * rows[done - 1] if done else 0)
        now = buckets[done : bisect_left(rows, least) + 1]
        spans = [now[i : i + -(-len(now) // SPANS)] for i in range(0, len(now), -(-len(now) // SPANS))]
        live = anchors
        if done:
            full = best.groupBy("id", "row", "window").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") == k)
            raised = full.groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct("window", "last"))).alias("last"))
            live = anchors.join(raised, ["id", "row"], "left").withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.element_at("last", i)))).drop("last")
        at = F.array(*(F.when(F.col("norm") * (s[0].top * SLACK) >= F.array_min("low"), F.lit(i)) for i, s in enumerate(spans)))
        dealt = live.withColumn("span", F.explode(F.array_compact(at)))
        hits = dealt.groupBy("span", "part").applyInPandas(_scan(spans, same, k), HITS)
        merged = best.union(hits).withColumn("place", F.row_number().over(window)).where(F.col("place") <= k).drop("place")
        best = scratch.save(merged, "best")
        done += len(now)
    return best


def _scan(spans: list[list[Bucket]], same: bool, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _hits(pdf, spans[int(pdf["span"].iloc[0])], same, k)


def _hits(pdf: pd.DataFrame, buckets: list[Bucket], same: bool, k: int) -> pd.DataFrame:
    pdf = pdf.reset_index(drop=True)
    found, _ = search(pdf, buckets, same, k)
    r, j, at = np.nonzero(np.arange(k)[None, None, :] < found.n[:, :, None])
    return pd.DataFrame({"id": pdf["id"].to_numpy()[r], "row": pdf["row"].to_numpy()[r], "window": j.astype(np.int32), "other": found.id[r, j, at], "score": found.score[r, j, at]})


def hard_negatives(rows: DataFrame, label: Column, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows have vec_id and embedding; ``label`` tells their label. Components x count as floor(256 * x), scores are integer
    inner products. Anchors are the rows whose vec_id is divisible by ``every``; their positives are the first other rows
    of the same label, and for each positive come the first rows of different labels whose score lies between low and
    high per cent of the positive's. Higher scores come first, ties by smaller vec_id. An anchor or positive without such
    rows gives none.

    Rows with a null vec_id, label, vector or component, a non-finite component or an integer norm of 2^28 or more take no
    part. A shorter vector counts as filled up with zeros. Rows that agree in vec_id, label and vector count once; other
    rows with the same vec_id count each, as anchors too, but an anchor's own vec_id is never its positive or negative.
    Other columns are ignored. No rows give none.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    base = scratch.save(integer_rows(rows, label), "rows")
    kept = F.row_number().over(Window.partitionBy("label", "q").orderBy("id")) <= max(positives, negatives) + 1
    candidates = base.withColumn("kept", kept).where("kept").drop("kept")
    buckets = write_buckets(scratch, candidates)
    row = F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("q")))
    anchors = scratch.save(base.where(F.col("id") % every == 0).withColumn("row", row), "asked")
    whole = anchors.withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
    order = Window.partitionBy("id", "row").orderBy(F.desc("score"), "other")
    pairs = best_of_windows(scratch, whole, buckets, True, positives).where("score >= 0")
    pairs = scratch.save(pairs.select("id", "row", (F.row_number().over(order) - 1).alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    ends = pairs.withColumn("low", F.expr(f"({low} * positive_score + 99) div 100")).withColumn("high", F.expr(f"({high} * positive_score) div 100"))
    ends = ends.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    asked = anchors.join(ends.select("id", "row", F.col("w.low").alias("low"), F.col("w.high").alias("high")), ["id", "row"])
    found = best_of_windows(scratch, asked, buckets, False, negatives)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id", "row", "window").orderBy(F.desc("score"), "other")))
    out = pairs.join(ranked, ["id", "row", "window"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 10
"""


def op11_norm_bucket_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings; the label of every seventh vec_id is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), label)
