"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, scored from memory-mapped sorted hash arrays.

Counting. Each task counts the distinct n-grams of its texts and sends them as compressed column blocks, one for each
range of context hashes, so that what is shuffled is pre-aggregated and dense. The task that merges a range has whole
contexts: it writes the range's n-gram hashes and counts and the contexts' totals as sorted arrays into the shared
folder, and passes on the (n-1)-grams that end its n-grams, each counted once for every distinct word before it. The
same step then makes the next lower order from these continuation counts, down to single words. Only counts of counts
reach the driver.

Scoring. Workers map the arrays into memory (a remote folder's files are first fetched to the executor's file root),
look up the distinct n-grams of a batch by binary search in sorted order and sum log probabilities. Nothing is pruned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, hashes, mapped, mix, read, words, write_bytes

ORDER = 2
#: Characters of text for each range of context hashes: what a task merges is bounded by it, whatever the input's size.
RANGE_CHARS = 16_000_000
LEAST_RANGES = 16
#: Tokens that a task holds before it sends what it has counted.
FLUSH_TOKENS = 3_000_000
BEGIN = np.uint64(0x1B873593CC9E2D51)
END = np.uint64(0xE6546B64F1BBCDCA)
_ROOT = np.uint64(0x85EBCA77C2B2AE3D)
_STEP = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "p int, block binary"


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of word sequences that continue the hashed ``context`` by ``word``."""
    return mix(context * _STEP + word)


def context_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of the sequences in the columns (one column for each place)."""
    acc = np.full(len(columns[0]) if columns else 1, _ROOT, np.uint64)
    for c in columns:
        acc = extend(acc, c)
    return acc


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of the hash space, in order."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


@dataclass
class Grams:
    """Distinct n-grams: word columns, the Kneser-Ney count and the number of occurrences."""

    columns: list[np.ndarray]
    count: np.ndarray
    raw: np.ndarray

    def home(self) -> np.ndarray:
        """What decides the range: the context's hash, or the word's own for single words."""
        context = self.columns[:-1] or self.columns
        return context_hash(context)

    def merged(self) -> tuple[Grams, np.ndarray]:
        """Equal n-grams added up, with their hashes in order."""
        g = context_hash(self.columns)
        order = np.argsort(g)
        g = g[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        at = order[first]
        sums = [np.add.reduceat(x[order], first) if len(first) else x for x in (self.count, self.raw)]
        return Grams([c[at] for c in self.columns], *sums), g[first]

    def blocks(self, ranges: int) -> list[tuple[int, bytes]]:
        if not len(self.count):
            return []
        home = self.home()
        order = np.argsort(home)
        part = range_of(home[order], ranges)
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        packer = zstandard.ZstdCompressor(level=1)
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            data = b"".join([np.int64(len(rows)).tobytes(), *(c[rows].tobytes() for c in self.columns), self.count[rows].tobytes(), self.raw[rows].tobytes()])
            out.append((int(part[a]), packer.compress(data)))
        return out

    @staticmethod
    def of_blocks(blocks: list[bytes], order: int) -> Grams:
        parts: list[list[np.ndarray]] = [[] for _ in range(order + 2)]
        for b in blocks:
            data = zstandard.ZstdDecompressor().decompress(b)
            n = int(np.frombuffer(data, np.int64, 1)[0])
            for k in range(order + 2):
                parts[k].append(np.frombuffer(data, np.uint64 if k < order else np.int64, n, 8 + 8 * n * k))
        whole = [np.concatenate(p) for p in parts]
        return Grams(whole[:order], *whole[order:])


def sequences(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with ``order - 1`` begin marks before each text and an end after it, places of tokens, tokens a text)."""
    chunks, lengths = [], []
    begin, end = np.full(order - 1, BEGIN), np.array([END])
    for t in texts:
        h = hashes(words(t))
        chunks += [begin, h, end]
        lengths.append(len(h) + 1)
    s = np.concatenate(chunks) if chunks else np.zeros(0, np.uint64)
    n = np.array(lengths, np.int64)
    starts = np.cumsum(n + order - 1) - n
    places = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    return s, places, n


def _arrays(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["p", "block"])


def _count(batches: Iterator[pa.RecordBatch], order: int, ranges: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate([h[k] for h in held]) for k in range(order)]
        one = np.ones(len(columns[0]), np.int64)
        return _arrays(Grams(columns, one, one).merged()[0].blocks(ranges))

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            s, places, _ = sequences(batch.column(0).slice(at, 500).to_pylist(), order)
            held.append(np.stack([s[places - k] for k in range(order - 1, -1, -1)]))
            size += len(places)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


#: Of each order and range: number of n-grams, occurrences, sum of counts, and how many have count 1, 2, 3, 4 and 3+.
STATS = ("grams", "raw", "total", "n1", "n2", "n3", "n4", "n3up")


def _merge(table: pa.Table, order: int, ranges: int, root: str) -> pa.Table:
    p = table["p"][0].as_py()
    grams, keys = Grams.of_blocks(table["block"].to_pylist(), order).merged()
    c = grams.count
    base = f"{root}/{order}-{p}"
    write_bytes(f"{base}.keys", keys.tobytes())
    narrow = lambda x: x.astype(np.int64 if x.max(initial=0) >= 1 << 32 else np.uint32).tobytes()
    write_bytes(f"{base}.counts", narrow(c))
    if order == 1:
        write_bytes(f"{base}.raw", narrow(grams.raw))
    else:
        home = grams.home()
        by = np.argsort(home)
        home, cc = home[by], c[by]
        first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        write_bytes(f"{base}.contexts", home[first].tobytes())
        sums = [np.add.reduceat(x, first) for x in (cc, (cc == 1) * 1, (cc == 2) * 1, (cc >= 3) * 1)]
        write_bytes(f"{base}.totals", np.stack(sums, axis=1).astype(np.float64 if sums[0].max() >= 1 << 24 else np.float32).tobytes())
    stats = [len(c), grams.raw.sum(), c.sum(), *((c == k).sum() for k in (1, 2, 3, 4)), (c >= 3).sum()]
    down = []
    if order > 1:
        down = Grams(grams.columns[1:], np.ones(len(c), np.int64), grams.raw).merged()[0].blocks(ranges)
    return pa.table({"p": pa.array([-1, *(q for q, _ in down)], pa.int32()), "block": pa.array([np.array(stats, np.int64).tobytes(), *(b for _, b in down)], pa.binary())})


def _merger(order: int, ranges: int, root: str):
    def merge(table):
        return _merge(table, order, ranges, root)

    return merge


def discounts(n: dict[str, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.5, 1 and 1.5 where those give none."""
    n1, n2, n3, n4 = (n[f"n{k}"] for k in range(1, 5))
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.95, 2.95), strict=True))


@dataclass
class Model:
    """Where the arrays are, and a few numbers for each order."""

    root: str
    order: int
    ranges: int
    stats: dict[int, dict[str, int]]


def train(docs: DataFrame, order: int = ORDER, scratch: Scratch | None = None, ranges: int | None = None) -> Model:
    """Count the texts of ``docs`` and write the model's arrays; null and empty texts count as one end each.

    The number of ranges follows from the characters of all texts, which are added up first. A range holds whole
    contexts, so a context with very many different continuations makes its range larger.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    ranges = ranges or max(LEAST_RANGES, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // RANGE_CHARS))
    root = scratch.path("model")
    blocks = docs.select("text").mapInArrow(lambda it: _count(it, order, ranges), BLOCKS)
    stats, last = {}, None
    for k in range(order, 0, -1):
        done = scratch.save(blocks.groupBy("p").applyInArrow(_merger(k, ranges, root), BLOCKS), f"order{k}")
        # a row of eight numbers for each range
        rows = [np.frombuffer(bytes(r["block"]), np.int64) for r in done.where("p = -1").collect()]
        stats[k] = dict(zip(STATS, (int(x) for x in np.sum(rows, axis=0)), strict=True)) if rows else dict.fromkeys(STATS, 0)
        if last is not None:
            scratch.drop(last)
        last, blocks = done, done.where("p >= 0")
    scratch.drop(last)
    return Model(root, order, ranges, stats)


@functools.lru_cache(maxsize=1 << 14)
def _file(path: str, dtype: str) -> np.ndarray | None:
    try:
        return mapped(path, np.dtype(dtype))
    except FileNotFoundError:
        return None


class Scorer:
    """Log probabilities from a model's arrays."""

    def __init__(self, model: Model):
        self.m = model
        self.d = {k: np.array((0.0, *discounts(s))) for k, s in model.stats.items()}

    def _find(self, wanted: np.ndarray, home: np.ndarray, order: int, keys: str, values: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each wanted hash is among the keys of its range, and its rows of the value files."""
        uniq, at, inverse = np.unique(wanted, return_index=True, return_inverse=True)
        part = range_of(home[at], self.m.ranges)
        by = np.argsort(part, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(part[by])) + 1, len(by)] if len(by) else np.zeros(1, np.int64)
        hit = np.zeros(len(uniq), bool)
        width = 4 if values == ["totals"] else 1
        out = [np.zeros((len(uniq), width)) if width > 1 else np.zeros(len(uniq)) for _ in values]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = by[a:b]
            base = f"{self.m.root}/{order}-{int(part[rows[0]])}"
            have = _file(f"{base}.{keys}", "u8")
            if have is None or not len(have):
                continue
            pos = np.searchsorted(have, uniq[rows])
            pos[pos == len(have)] = 0
            ok = have[pos] == uniq[rows]
            hit[rows] = ok
            for v, o in zip(values, out, strict=True):
                o[rows[ok]] = self._values(f"{base}.{v}", len(have) * width).reshape(len(have), -1)[pos[ok]].reshape(ok.sum(), -1) if width > 1 else self._values(f"{base}.{v}", len(have))[pos[ok]]
        return hit[inverse], [o[inverse] for o in out]

    def _values(self, path: str, n: int) -> np.ndarray:
        """An array of n numbers: 4- or 8-byte counts or totals."""
        raw = _file(path, "u1")
        wide = len(raw) == 8 * n
        if path.endswith(".totals"):
            return raw.view(np.float64 if wide else np.float32)
        return raw.view(np.int64 if wide else np.uint32)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        m, n = self.m, self.m.order
        s, places, lengths = sequences(texts, n)
        one = m.stats[1]
        word = s[places]
        root = np.full(len(word), _ROOT, np.uint64)
        key = extend(root, word)
        _, (count, raw) = self._find(key, key, 1, "keys", ["counts", "raw"])
        base = np.log10((raw + 0.5) / (one["raw"] + 0.5 * (one["grams"] + 1)))
        d = self.d[1]
        total = max(1, one["total"])
        spare = (d[1] * one["n1"] + d[2] * one["n2"] + d[3] * one["n3up"]) / total if one["total"] else 1.0
        p = np.maximum(count - d[np.minimum(count, 3).astype(int)], 0) / total + spare / (one["grams"] + 1)
        for k in range(2, n + 1):
            context = context_hash([s[places - j] for j in range(k - 1, 0, -1)])
            seen, (t,) = self._find(context, context, k, "contexts", ["totals"])
            _, (c,) = self._find(extend(context, word), context, k, "keys", ["counts"])
            d = self.d[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                mixed = (np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) + (t[:, 1] * d[1] + t[:, 2] * d[2] + t[:, 3] * d[3]) * p) / t[:, 0]
            p = np.where(seen, mixed, p)
        ends = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x, ends) if len(ends) else np.zeros(0) for x in ((raw > 0).astype(np.int64), base, np.log10(p))]
        return (lengths, *sums)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) of every row.

    A null or empty text consists of its end. A model of no texts gives every token the same probability of an unknown
    word. Repeated rows and null ids each give a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 800):
                part = batch.slice(at, 800)
                n, known, base, score = scorer.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(known), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / n, 300))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of four fifths of them."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 5) != 1))
    return score_texts(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.stats[1]["raw"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
