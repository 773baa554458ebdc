"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embedding rows, with their first 4, 5 and 6 bytes as further rows, so that inflected and compound
forms share what their stems have learned; filters of several widths slide over the word sequence; each filter keeps its
maximum over the whole text; a logistic layer reads the maxima. Only places that win the pooling get a gradient.

All labelled texts are learned from. They are dealt to learners of bounded size; in each pass every learner goes over
its rows from the common parameters, and the next common parameters are their average, an embedding row's by how often
each learner has moved it. A fifth of all labelled texts is held back: it ends the fit, calibrates scores to
probabilities and picks a threshold for each language. Scoring is one pass over whole texts: the first layer is a table
of each hashed word's contribution to each filter tap.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, crc_mod, hashes, mapped, read, small_batches, write_bytes

BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)
#: Rows, and bytes of text, that a learner is meant to hold; there are as many learners as all labelled texts need.
LEARNER_ROWS, LEARNER_BYTES = 8_000, 32_000_000
#: Labelled ids up to which they are broadcast to meet their texts; beyond, texts are shuffled to meet them.
BROADCAST_IDS = 500_000
#: Embedding rows in a block of parameters, and how many learners' blocks are averaged at once.
BLOCK_ROWS, FAN = 1024, 64
#: The stopping rule, the same at every size: at most PASSES passes, and none after PATIENCE passes in a row in which
#: the held-back log loss did not fall by LEAST_GAIN.
PASSES, PATIENCE, LEAST_GAIN = 12, 2, 0.001
CUT = 0.3

#: A-Z to a-z; ASCII punctuation and blanks to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


#: Bytes of the stems that a word is also known by.
STEMS = (4, 5, 6)
PARTS = 1 + len(STEMS)


def tokens(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Embedding rows (word, stems) of the words of a whole text, shape (words, PARTS)."""
    w = text.encode("utf-8", "replace").translate(_FOLD).split() if text else []
    keys = [hashes(w), *(hashes([x[:n] for x in w]) + np.uint64(n) for n in STEMS)]
    return np.stack([k % np.uint64(buckets) for k in keys], axis=1).astype(np.int16 if buckets <= 1 << 15 else np.int32)


@dataclass
class TextCNN:
    """Hashed embeddings, filters of several widths, max pooling, a logistic layer."""

    buckets: int = BUCKETS
    dim: int = 8
    filters: int = 8
    widths: tuple[int, ...] = WIDTHS
    seed: int = 7
    rate: float = 0.05
    batch: int = 32
    prior: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    fitted: bool = False

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.emb = rng.normal(0, 0.1, (self.buckets + 1, self.dim)).astype(np.float32)
        self.emb[-1] = 0  # stands behind the end of a text
        self.taps = [rng.normal(0, 0.5, (w, self.dim, self.filters)).astype(np.float32) for w in self.widths]
        self.bias = np.zeros(self.filters * len(self.widths), np.float32)
        self.out = rng.normal(0, 0.3, self.filters * len(self.widths)).astype(np.float32)
        self.base = np.float32(-1.0)

    def _padded(self, idx: np.ndarray) -> np.ndarray:
        none = np.full((max(self.widths) - 1 + (not len(idx)), PARTS), self.buckets, np.int32)
        return np.concatenate([idx, none])

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, held: list[np.ndarray] | None = None, held_labels: np.ndarray | None = None, passes: int = PASSES) -> None:
        """At most ``passes`` passes, ended by the loss of held-back texts (if there are any), whose lowest decides
        which parameters stay."""
        rng, memory = np.random.default_rng(self.seed + 1), self.memory()

        def one() -> None:
            self.one_pass(texts, labels, rng.permutation(len(texts)), memory)

        self.rounds(one, (lambda: log_loss(self.logits(held, self.table()), held_labels)) if held else None, passes)

    def rounds(self, one: Callable[[], None], loss_of: Callable[[], float] | None, passes: int = PASSES) -> None:
        """Passes until the stopping rule ends them; the parameters with the lowest loss stay."""
        best, best_loss, mark, since = None, np.inf, np.inf, 0
        for _ in range(passes):
            one()
            if loss_of:
                loss = loss_of()
                if loss < best_loss:
                    best, best_loss = ([p.copy() for p in self.params()], self.base), loss
                mark, since = (loss, 0) if loss <= mark - LEAST_GAIN else (mark, since + 1)
                if since == PATIENCE:
                    break
        if best:
            self.put(*best)
        self.fitted = True

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.taps, self.bias, self.out]

    def put(self, params: list[np.ndarray], base: float) -> None:
        for p, new in zip(self.params(), params, strict=True):
            p[...] = new
        self.base = np.float32(base)

    def memory(self) -> list[np.ndarray]:
        """Sums of squared gradients of all parameters, and of the base."""
        return [*(np.full_like(p, 1e-4) for p in self.params()), np.full(1, 1e-4)]

    def one_pass(self, texts: list[np.ndarray], labels: np.ndarray, order: np.ndarray, memory: list[np.ndarray]) -> np.ndarray:
        """One pass in the given order; returns how often each embedding row was moved."""
        params, pad = self.params(), max(self.widths) - 1
        moved = np.zeros(len(self.emb))
        for at in range(0, len(order), self.batch):
            grads = [np.zeros_like(p) for p in params[1:]]
            rows, steps, base_grad = [], [], 0.0
            for i in order[at : at + self.batch]:
                seq = self._padded(texts[i])
                x = self.emb[seq[:, 0]]
                for part in range(1, PARTS):
                    x += self.emb[seq[:, part]]
                n = len(seq) - pad
                places, pooled = [], []
                for taps in self.taps:
                    z = sum(x[o : n + o] @ taps[o] for o in range(len(taps)))
                    p = z.argmax(axis=0)
                    places.append(p)
                    pooled.append(z[p, np.arange(self.filters)])
                raw = np.concatenate(pooled) + self.bias
                act = np.maximum(raw, 0)
                g = 1 / (1 + np.exp(-np.clip(act @ self.out + self.base, -30, 30))) - labels[i]
                grads[-1] += g * act
                base_grad += g
                d = g * self.out * (raw > 0)
                grads[-2] += d
                for k, (taps, p) in enumerate(zip(self.taps, places, strict=True)):
                    dk = d[k * self.filters : (k + 1) * self.filters]
                    for o in range(len(taps)):
                        grads[k][o] += x[p + o].T * dk
                        rows.append(seq[p + o].ravel())
                        steps.append(np.repeat((taps[o] * dk).T, PARTS, axis=0))
            flat = np.concatenate(rows)
            by = np.argsort(flat, kind="stable")
            starts = np.flatnonzero(np.diff(flat[by], prepend=-1))
            uniq = flat[by[starts]]
            ge = np.add.reduceat(np.concatenate(steps)[by], starts, axis=0)
            ge[uniq == self.buckets] = 0
            ge += 1e-3 * self.emb[uniq]
            memory[0][uniq] += ge * ge
            self.emb[uniq] -= self.rate * ge / np.sqrt(memory[0][uniq])
            moved[uniq] += 1
            for p, m, gr in zip(params[1:], memory[1:-1], grads, strict=True):
                gr += 1e-3 * p
                m += gr * gr
                p -= self.rate * gr / np.sqrt(m)
            memory[-1] += base_grad**2
            self.base -= np.float32(self.rate * base_grad / np.sqrt(memory[-1][0]))
        return moved

    def table(self) -> np.ndarray:
        """Each hashed word's contribution to each tap of each filter."""
        return np.concatenate([self.emb @ t[o] for t in self.taps for o in range(len(t))], axis=1)

    def logits(self, texts: list[np.ndarray], table: np.ndarray, words_at_once: int = 1 << 14) -> np.ndarray:
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= words_at_once:
                out.append(self._logits(group, table))
                group, size = [], 0
        if group:
            out.append(self._logits(group, table))
        return np.concatenate(out) if out else np.zeros(0)

    def _logits(self, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        pad, f = max(self.widths) - 1, self.filters
        seqs = [self._padded(t) for t in texts]
        lengths = np.array([len(s) for s in seqs])
        ends = np.cumsum(lengths)
        cuts = np.stack([ends - lengths, ends - pad], axis=1).ravel()
        idx = np.concatenate([*seqs, np.full((pad, PARTS), self.buckets, np.int32)])
        pooled, col = [], 0
        n = len(idx) - pad
        taken = table[idx[:, 0]]
        for part in range(1, PARTS):
            taken += table[idx[:, part]]
        for w in self.widths:
            z = taken[:n, col * f : (col + 1) * f]
            for o in range(1, w):
                z = z + taken[o : n + o, (col + o) * f : (col + o + 1) * f]
            pooled.append(np.maximum.reduceat(z, cuts[:-1] if cuts[-1] >= n else cuts, axis=0)[::2])
            col += w
        act = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return act.astype(np.float64) @ self.out.astype(np.float64) + float(self.base)

    def scores(self, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.prior)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts, table) + b, -30, 30)))


def log_loss(logits: np.ndarray, labels: np.ndarray) -> float:
    """Mean negative log likelihood of labels 0 and 1."""
    return float(np.logaddexp(0, np.where(labels == 1, -logits, logits)).mean())


def platt(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Scale and shift that make logits probabilities (Newton steps on smoothed targets); each row counts so often."""
    n = np.ones(len(labels)) if counts is None else counts
    pos, neg = (n * labels).sum(), (n * (1 - labels)).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = np.array([(n * (p - target) * logits).sum(), (n * (p - target)).sum()])
        v = n * (p * (1 - p) + 1e-9)
        h = np.array([[(v * logits * logits).sum(), (v * logits).sum()], [(v * logits).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def calibration(scored: DataFrame) -> tuple[float, float]:
    """``platt`` over all rows of (logit, toxic), counted in steps of 0.01 of the logit."""
    step = F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit"))) * 100).cast("int")
    # at most 6,001 steps for each label
    got = scored.groupBy("toxic", step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("logit") * 1e6).cast("long")).alias("s")).orderBy("toxic", "step").toPandas()
    n = got["n"].to_numpy(np.float64)
    return platt(got["s"].to_numpy(np.float64) / 1e6 / n, got["toxic"].to_numpy(np.float64), n)


def language_thresholds(scored: DataFrame, scale: tuple[float, float], low: float = 0.2, high: float = 0.5, least: int = 15) -> dict[str, float]:
    """The cut in [low, high] with the best F1 over all rows of (lang, toxic, logit), for each language that has enough
    toxic ones."""
    cuts = np.arange(low, high + 1e-9, 0.05)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), scale[0] * F.col("logit") + scale[1]))))
    over = [F.count_if(p >= float(c)).alias(f"n{i}") for i, c in enumerate(cuts)] + [F.sum(F.when(p >= float(c), F.col("toxic")).otherwise(0)).alias(f"y{i}") for i, c in enumerate(cuts)]
    out = {}
    # one row for each language
    for r in scored.where("lang is not null").groupBy("lang").agg(F.sum("toxic").alias("y"), *over).where(F.col("y") >= least).collect():
        f1 = [2 * r[f"y{i}"] / max(1, r["y"] + r[f"n{i}"]) for i in range(len(cuts))]
        best = [c for c, v in zip(cuts, f1, strict=True) if v >= max(f1) - 1e-9]
        out[r["lang"]] = round(float(min(best, key=lambda c: abs(c - CUT))), 4)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_words: int) -> DataFrame:
    """(doc_id, text_hash, lang, toxic, text) of at most ``sample_rows`` labelled texts with ``sample_words`` words at
    most, in the order of a hash of doc_id: a text that no longer fits is left out, shorter ones behind it are still
    taken. Repeated rows count once. For looks at a corpus; the fit takes all labelled texts."""
    chosen = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "lang", "text")
    # at most sample_rows rows, of 12 bytes each
    slim = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text_hash", "lang", "toxic", F.regexp_count("text", F.lit(r"\S+")).alias("n_words"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash"), F.col("lang")]
    # at most sample_rows rows of a few numbers on the driver
    left, taken = sample_words, []
    for row in slim.distinct().orderBy(*order).limit(sample_rows).collect():
        if row["n_words"] <= left:
            left -= row["n_words"]
            taken.append((row["doc_id"], row["text_hash"], row["lang"], row["toxic"]))
    keys = docs.sparkSession.createDataFrame(taken, "doc_id long, text_hash long, lang string, toxic int")
    found = texts.withColumnRenamed("lang", "lang_of").join(F.broadcast(keys), ["doc_id", "text_hash"]).where(F.col("lang").eqNullSafe(F.col("lang_of")))
    return found.dropDuplicates(["doc_id", "text_hash", "lang"]).select("doc_id", "text_hash", "lang", "toxic", "text")


def learners_of(scratch: Scratch, docs: DataFrame, labels: DataFrame, learner_rows: int = LEARNER_ROWS, learner_bytes: int = LEARNER_BYTES) -> DataFrame:
    """(learner, path, ends, toxic, langs): all labelled texts, dealt by a hash of doc_id. The words of a learner's texts
    are in a file of the shared folder, as embedding rows; ``ends`` tells where each text ends. Repeated rows count
    once; texts are in the order of a hash."""
    chosen = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = scratch.save(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen.hint("merge")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    size = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(few, "doc_id").agg(F.count("*"), F.sum("bytes")).first()
    n = max(1, -(-size[0] // learner_rows), -(-(size[1] or 0) // learner_bytes))
    dealt = texts.join(few, "doc_id").withColumns({"text_hash": F.xxhash64("text"), "learner": F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")}).repartition("learner")
    once = dealt.groupBy("learner", "doc_id", "text_hash", "lang").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    root = scratch.path("words")

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        names = [f"{a}:{b}:{c}".encode() for a, b, c in zip(*(rows[x].to_pylist() for x in ("doc_id", "text_hash", "lang")), strict=True)]
        rows = rows.take(pa.array(sorted(range(len(names)), key=lambda i, h=hashes(names): (h[i], names[i]))))
        ids = [tokens(t.as_py()) for t in rows["text"]]
        path = f"{root}/{key[0].as_py()}"
        flat = np.concatenate(ids) if ids else np.zeros((0, PARTS), np.int16)
        write_bytes(path, pa.Codec("zstd").compress(flat.astype("<i2").tobytes(), asbytes=True))
        ends = np.cumsum([len(x) for x in ids]).tolist()
        return pa.table({"learner": pa.array([key[0].as_py()], pa.int32()), "path": [path], "ends": pa.array([ends], pa.list_(pa.int64())), "toxic": pa.array([rows["toxic"].to_pylist()], pa.list_(pa.int32())), "langs": pa.array([rows["lang"].to_pylist()], pa.list_(pa.string()))})

    table = scratch.save(once.groupBy("learner").applyInArrow(pack, "learner int, path string, ends array<long>, toxic array<int>, langs array<string>"), "learners")
    return table.repartition(n)


def _texts(row: dict) -> list[np.ndarray]:
    """The texts of a learner, as views of its words."""
    ends = row["ends"]
    flat = pa.Codec("zstd").decompress(mapped(row["path"], np.uint8), ends[-1] * PARTS * 2) if ends[-1] else b""
    flat = np.frombuffer(flat, "<i2").reshape(-1, PARTS)
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _back(n: int) -> np.ndarray:
    return np.arange(n) % 5 == 4


def _average(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The average of a block's values, each row's by its weights."""
    rows = rows.sort_by("learner")
    weights = total = None
    for w, v in zip(rows["weights"], rows["values"], strict=True):
        w = np.frombuffer(w.as_buffer(), np.float64)
        v = np.frombuffer(v.as_buffer(), np.float32).reshape(len(w), -1) * w[:, None]
        weights, total = (w, v) if weights is None else (weights + w, total + v)
    mean = (total / np.maximum(weights, 1e-300)[:, None]).astype(np.float32)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "learner": pa.array([key[1].as_py() if len(key) > 1 else 0], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary()), "values": pa.array([mean.tobytes()], pa.binary())})


BLOCKS = "block int, learner int, weights binary, values binary"


def one_round(learners: DataFrame, n: int, number: int, model: TextCNN, memory: list[np.ndarray], back: bool) -> None:
    """A pass of all learners from the model's parameters, which become the average of theirs."""
    shared = learners.sparkSession.sparkContext.broadcast((model, memory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            m, mem = copy.deepcopy(shared.value)
            keep = np.flatnonzero(~_back(len(row["ends"]))) if back else np.arange(len(row["ends"]))
            order = np.random.default_rng([m.seed + 1, number, row["learner"]]).permutation(keep)
            moved = m.one_pass(_texts(row), np.array(row["toxic"], np.float64), order, mem)
            whole = np.concatenate([m.emb, mem[0]], axis=1)
            at = range(0, len(whole), BLOCK_ROWS)
            dense = np.stack([np.concatenate([x.ravel() for x in (*m.params()[1:], np.array([m.base]))]), np.concatenate([x.ravel() for x in mem[1:]])], axis=1)
            weights = [moved[i : i + BLOCK_ROWS].tobytes() for i in at] + [np.full(len(dense), float(len(order))).tobytes()]
            values = [whole[i : i + BLOCK_ROWS].tobytes() for i in at] + [dense.astype(np.float32).tobytes()]
            blocks = pa.array(range(len(values)), pa.int32())
            yield pa.RecordBatch.from_arrays([blocks, pa.array([row["learner"]] * len(values), pa.int32()), pa.array(weights, pa.binary()), pa.array(values, pa.binary())], ["block", "learner", "weights", "values"])

    rows = learners.mapInArrow(run, BLOCKS)
    while n > FAN:
        rows = rows.withColumn("learner", F.floor(F.col("learner") / FAN).cast("int")).groupBy("block", "learner").applyInArrow(_average, BLOCKS)
        n = -(-n // FAN)
    # the size of the model, whatever the input
    got = {r["block"]: (np.frombuffer(r["weights"], np.float64), np.frombuffer(r["values"], np.float32)) for r in rows.groupBy("block").applyInArrow(_average, BLOCKS).collect()}
    shared.destroy()
    _, dense = got.pop(max(got))
    for block, (weights, values) in got.items():
        at, values = np.flatnonzero(weights), values.reshape(len(weights), -1)
        model.emb[block * BLOCK_ROWS + at], memory[0][block * BLOCK_ROWS + at] = values[at, : model.dim], values[at, model.dim :]
    dense, start = dense.reshape(-1, 2), 0
    for p, m in zip(model.params()[1:], memory[1:-1], strict=True):
        p[...], m[...] = (dense[start : start + p.size, k].reshape(p.shape) for k in (0, 1))
        start += p.size
    model.base, memory[-1][...] = np.float32(dense[-1, 0]), dense[-1, 1]


def logits_of(learners: DataFrame, model: TextCNN, back: bool) -> DataFrame:
    """(lang, toxic, logit) of all held-back texts; of all texts if none is held back."""
    shared = learners.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table()
        for row in (r for b in batches for r in b.to_pylist()):
            keep = np.flatnonzero(_back(len(row["ends"]))) if back else np.arange(len(row["ends"]))
            texts = _texts(row)
            z = m.logits([texts[i] for i in keep], table)
            yield pa.RecordBatch.from_arrays([pa.array([row["langs"][i] for i in keep], pa.string()), pa.array([row["toxic"][i] for i in keep], pa.int32()), pa.array(z, pa.float64())], ["lang", "toxic", "logit"])

    return learners.mapInArrow(run, "lang string, toxic int, logit double")


def mean_loss(scored: DataFrame) -> float:
    """``log_loss`` over all rows, summed in whole billionths so that the order of rows doesn't matter."""
    margin = F.when(F.col("toxic") == 1, -F.col("logit")).otherwise(F.col("logit"))
    loss = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    return scored.agg((F.sum(F.round(loss * 1e9).cast("decimal(20,0)")).cast("double") / F.count("*") / 1e9).alias("loss")).first()["loss"]


def fit_toxicity(docs: DataFrame, labels: DataFrame, learner_rows: int = LEARNER_ROWS, learner_bytes: int = LEARNER_BYTES) -> TextCNN:
    """Fit on all labelled texts; a fifth of them is held back to end the fit, to calibrate scores and to pick
    thresholds. Learners hold ``learner_rows`` texts and ``learner_bytes`` bytes or somewhat more; a text of any length
    is one learner's whole.

    Rows with a null doc_id, null label or null text are not learned from; repeated rows are learned from once, and an
    id with several labels is toxic if one is. Without labelled rows of both kinds the model is not fitted and scores
    every text with the share of toxic labels (0 without labels).
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    learners = learners_of(scratch, docs, labels, learner_rows, learner_bytes)
    each = learners.select("learner", F.posexplode("toxic").alias("i", "y")).select("learner", "y", (F.col("i") % 5 == 4).alias("back"))
    n, rows, toxic, back_rows, back_toxic = each.agg(F.max("learner"), F.count("*"), F.sum("y"), F.count_if("back"), F.sum(F.when(F.col("back"), F.col("y")).otherwise(0))).first()
    model = TextCNN(prior=toxic / rows if rows else 0.0)
    if not rows or toxic in (0, rows):
        return model
    back = back_toxic >= 5 and back_rows - back_toxic >= 5
    memory, numbers = model.memory(), itertools.count()
    model.rounds(lambda: one_round(learners, n + 1, next(numbers), model, memory, back), (lambda: mean_loss(logits_of(learners, model, True))) if back else None)
    scored = scratch.save(logits_of(learners, model, back), "logits")
    model.scale = calibration(scored)
    model.thresholds = language_thresholds(scored, model.scale)
    return model


def score_toxicity(docs: DataFrame, model: TextCNN, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``toxicity`` (0 to 1) and ``rejected`` (at or over the language's threshold) at the end.

    Null and empty texts are scored as one empty word. Rows are never dropped; a column of docs that has one of the
    two names is replaced. Languages without a threshold of their own, and null, take 0.3. ``keep`` names the columns of
    docs to return, if not all: texts that nobody reads afterwards needn't come back from Python.
    """
    docs = docs.drop("toxicity", "rejected")
    kept = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField("toxicity", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    text_at = docs.columns.index("text")
    lang_at = docs.columns.index("lang") if "lang" in docs.columns else None
    # the model's size is fixed by its parameters: buckets * dim floats and the taps
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table()
        for batch in batches:
            score = np.concatenate([m.scores([tokens(t) for t in batch.column(text_at).slice(at, 256).to_pylist()], table) for at in range(0, batch.num_rows, 256)])
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
            cut = np.array([m.thresholds.get(x, CUT) for x in langs])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(score), pa.array(score >= cut)], schema.names)

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of three quarters of them."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    scored = score_toxicity(docs, fit_toxicity(docs, labels), ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"), "rejected")
