"""Best-two-fit packing of documents into fixed-length token sequences.

The packing decision needs only how many documents have each length, and lengths are bounded by the sequence
capacity. So the plan is made from that histogram (at most ``capacity`` rows, whatever the corpus size): fill a bin
greedily with the largest length that fits, then exchange its smallest document for two unpacked ones that use the
widened gap better. One pattern is repeated as often as the counts allow. Documents then find their place by their
exact rank among documents of the same length, which is counted over salted buckets, so that a length shared by a
third of all documents does not meet in one task.
"""

from __future__ import annotations

import itertools
import operator
import os
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

CAPACITY = 1024
END_ID = 2
#: Chunks from which the cache of a worker begins a new generation; the one before is kept beside it.
CACHE_ENTRIES = 800_000
_ID = operator.attrgetter("id")
#: UTF-8 bytes of texts that are cut, and whose ids are held, at once (a longer text goes alone).
SLICE_BYTES = 4_000_000
#: Bytes that may stand behind the blank before which a text is cut: those that begin no blank.
_BEHIND = np.ones(256, bool)
_BEHIND[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: The pre-tokens of a chunk of these characters. An apostrophe begins pre-tokens of its own (``'s``), and what is a letter
#: further on depends on the library's Unicode tables: chunks with those are left to its own pre-tokenisation.
_RUNS = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n(?=\S)")
RANK_BUCKETS = 256


class ChunkEncoder:
    """Byte-level BPE ids of whole texts by the ``tokenizers`` library, which sees each distinct chunk once.

    In this vocabulary's pre-tokenisation a token never spans the place before a space or line end with a non-blank
    behind it, and what stands before that place is cut alike with and without what follows. So a text is the
    concatenation of the ids of its chunks between such places (or some of them). Each distinct chunk of some texts is
    looked up once in a cache. A new chunk of plain characters is cut into its pre-tokens here and the library's model
    gets those that are new: its way from a text to pre-tokens takes longer than the model. Texts that hold an added
    token's string (which has the id of that token) are encoded whole. ``encode`` returns little-endian uint32.
    """

    def __init__(self, tokenizer_file: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores out
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.entries = entries
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        alphabet = ByteLevel.alphabet()  # printable bytes are their own characters, others follow from 256 on
        others = iter(sorted(x for x in alphabet if ord(x) > 255))
        self._names = {b: chr(b) if chr(b) in alphabet else next(others) for b in range(256)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        got = [array("I", x.ids) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for x in got:
                x.byteswap()
        return [x.tobytes() for x in got]

    def whole(self, text: str) -> bytes:
        return self._ids([text])[0]

    def _missing(self, keys: Iterable[str]) -> set[str]:
        """Keys that neither generation holds; those of the older one are moved to the younger."""
        cache, held = self.cache, self.old
        keys = [k for k in keys if k not in cache]  # a set less ``cache.keys()`` would go over the whole cache
        old = [k for k in keys if k in held]
        cache.update(zip(old, map(held.__getitem__, old), strict=True))
        return set(keys).difference(old)

    def _learn_runs(self, runs: list[str]) -> None:
        """Ids of single pre-tokens by the library's model, which takes a character for each byte."""
        names, text = self._names, "\0".join(runs)
        text = text.replace(" ", names[32]).replace("\n", names[10]).replace("\0", names[0]) if text.isascii() else text.encode().decode("latin-1").translate(names)
        tokens = list(map(self._tokenizer.model.tokenize, text.split(names[0])))
        ids = np.fromiter(map(_ID, itertools.chain.from_iterable(tokens)), "<u4").tobytes()
        ends = itertools.accumulate(map(len, tokens), initial=0)
        self.cache.update(zip(runs, [ids[4 * a : 4 * b] for a, b in itertools.pairwise(ends)], strict=True))

    def _learn(self, new: set[str]) -> None:
        cache, single, made, other = self.cache, set(), [], []
        for c in new:
            if c.isascii() and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()):
                single.add(c)
            elif "".join(runs := _RUNS.findall(c)) == c:
                single.update(runs)
                made.append((c, runs))
            else:
                other.append(c)
        runs = list(self._missing(single))
        for at in range(0, len(runs), 1000):
            self._learn_runs(runs[at : at + 1000])
        for c, runs in made:
            cache[c] = b"".join([cache[x] for x in runs])
        if other:
            cache.update(zip(other, self._ids(other), strict=True))

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        if len(self.cache) > self.entries:
            self.old, self.cache = self.cache, {}
        ids = list(map(self.cache.get, chunks))
        if holes := list(itertools.compress(itertools.count(), map(operator.not_, ids))):
            self._learn(self._missing([chunks[i] for i in holes]))
            for i in holes:
                ids[i] = self.cache[chunks[i]]
        return ids

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        ends = np.cumsum([len(t) for t in texts])
        if not ends[-1]:
            return [b""] * len(texts)
        data = b"".join(texts)
        seen = np.frombuffer(data, np.uint8)
        first = np.zeros(len(seen), bool)
        first[:-1] = ((seen == 0x20) | (seen == 0x0A))[:-1] & _BEHIND[seen[1:]]
        first[ends[ends > 0] - 1] = False  # a blank at a text's end; what follows is another text
        bounds = np.concatenate([[0], ends])
        first[bounds[bounds < len(seen)]] = True
        starts = np.flatnonzero(first)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(seen))), pa.py_buffer(data)).dictionary_encode()

        ids = self._look_up(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())  # ``to_pylist`` is slower
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        which = chunks.indices.to_numpy()
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        # the ids of each chunk's place, one after another
        out = flat[np.arange(upto[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], n)].tobytes()
        cuts = 4 * upto[np.searchsorted(starts, bounds)]
        return [out[a:b] for a, b in itertools.pairwise(cuts.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i: self.whole(t) for i, t in enumerate(texts) if any(x in t for x in self._added)}
        parts, size = [[]], 0
        for i, t in enumerate(texts):
            t = b"" if i in whole else t.encode()
            if parts[-1] and size + len(t) > SLICE_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(t)
            size += len(t)
        out = [ids for part in parts if part for ids in self._encode(part)]
        for i, ids in whole.items():
            out[i] = ids
        return out


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def _encoder(tokenizer_file: str, entries: int) -> ChunkEncoder:
    if (tokenizer_file, entries) not in _encoders:
        _encoders[tokenizer_file, entries] = ChunkEncoder(tokenizer_file, entries)
    return _encoders[tokenizer_file, entries]


def pieces_of(ids: bytes, capacity: int) -> list[int]:
    """crc32 of each piece; every piece but the first has ``capacity`` ids."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    cuts = [0, *range(first * 4, n * 4 + 1, capacity * 4)]
    return [zlib.crc32(ids[a:b]) for a, b in itertools.pairwise(cuts)]


def tokenized(docs: DataFrame, capacity: int, end_id: int, tokenizer_file: str, entries: int = CACHE_ENTRIES) -> DataFrame:
    """(doc_id, n_tokens, crcs): the length with the end id and the checksum of each piece."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file, entries)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):  # bounds what is held as texts and ids at once
                part = batch.slice(at, 2000)
                ids = [x + end for x in encoder.encode([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([pieces_of(x, capacity) for x in ids], pa.list_(pa.int64()))], ["doc_id", "n_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, crcs array<long>")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, how often in a bin)] with the number of bins made so, over lengths 1..capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        used: Counter[int] = Counter()
        gap = capacity
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            length = int(fits[-1])
            n = min(int(left[length]), gap // length)
            used[length] += n
            left[length] -= n
            gap -= n * length
        smallest = min(used)
        if gap and (pair := _two_for(left, gap + smallest, smallest)):
            left[smallest] += 1
            used[smallest] -= 1
            for x in pair:
                used[x] += 1
                left[x] -= 1
        pattern = sorted(((length, n) for length, n in used.items() if n), reverse=True)
        for length, n in pattern:
            left[length] += n
        times = min(int(left[length]) // n for length, n in pattern)
        for length, n in pattern:
            left[length] -= n * times
        plan.append((pattern, times))
    return plan


def _two_for(left: np.ndarray, room: int, beaten: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum within ``room``, if it is larger than ``beaten``."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, side="right") - 1
    other = np.where(at >= 0, have[at], -room - 1)
    single = (other == have) & (left[have] < 2)
    if single.any():
        lower = at[single] - 1
        other[single] = np.where(lower >= 0, have[lower], -room - 1)
    sums = have + other
    best = int(np.argmax(sums))
    return (int(have[best]), int(other[best])) if sums[best] > beaten else None


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_file: str | None = None, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Place every document's token pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document's ids end with ``end_id``; a longer one than ``capacity`` is cut so that only its first piece can be
    short. Null or empty texts consist of the end id. Rows with the same doc_id are packed one by one; rows with a
    null doc_id too, and keep the null. An empty table gives an empty result. Further columns are ignored.
    ``tokenizer_file`` is a byte-level vocabulary of the ``tokenizers`` library (its path on every executor). The
    string of one of its added tokens in a text has that token's id. Fewer ``entries`` of a worker's cache of ids take
    less memory and more time; the result is the same.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession, "packing")
    items = scratch.save(tokenized(docs, capacity, end_id, tokenizer_file, entries), "items")
    items = items.select("doc_id", "n_tokens", "crcs", (F.col("n_tokens") % capacity).cast("int").alias("tail"), F.floor(F.col("n_tokens") / capacity).alias("n_full"), F.pmod(F.xxhash64("doc_id", "n_tokens", "crcs"), F.lit(RANK_BUCKETS)).cast("int").alias("bucket"))
    groups = scratch.save(items.groupBy("tail", "bucket").agg(F.count("*").alias("g_rows"), F.sum("n_full").alias("g_full")), "groups")
    # at most `capacity` rows, whatever the input
    histogram = {r["tail"]: (r["n"], r["full"]) for r in groups.groupBy("tail").agg(F.sum("g_rows").alias("n"), F.sum("g_full").alias("full")).collect()}
    plan = best_two_fit({t: n for t, (n, _) in histogram.items() if t}, capacity)

    keys, mult, seq, off = [], [], [], []  # where the ranks of a length begin in each pattern
    nxt, base, shift = Counter(), 0, 1 << 48
    for shape, times in plan:
        at = 0
        for length, n in shape:
            keys.append(length * shift + nxt[length])
            mult.append(n)
            seq.append(base)
            off.append(at)
            nxt[length] += n * times
            at += n * length
        base += times
    order = np.argsort(keys, kind="stable")
    keys, mult, seq, off = (np.asarray(x, np.int64)[order] for x in (keys, mult, seq, off))
    full_base = {}
    for tail in sorted(histogram):
        full_base[tail] = base
        base += histogram[tail][1]

    # at most capacity * RANK_BUCKETS rows
    within = Window.partitionBy("tail").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("tail", "bucket", F.coalesce(F.sum("g_rows").over(within), F.lit(0)).alias("row_base"), F.coalesce(F.sum("g_full").over(within), F.lit(0)).alias("full_base"))
    w = Window.partitionBy("tail", "bucket").orderBy("doc_id", "n_tokens", "crcs")
    ranked = items.withColumns({"rank": F.row_number().over(w), "full_upto": F.sum("n_full").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = ranked.join(offsets, ["tail", "bucket"]).select("doc_id", "n_tokens", "crcs", "tail", "n_full", (F.col("rank") - 1 + F.col("row_base")).alias("rank"), (F.col("full_upto") - F.col("n_full") + F.col("full_base")).alias("full_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail, full, rank, full_at = (batch.column(c).to_numpy().astype(np.int64) for c in ("tail", "n_full", "rank", "full_at"))
            has = (tail > 0).astype(np.int64)
            n = full + has
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            is_tail = (piece == 0) & (has[doc] == 1)
            at = np.searchsorted(keys, tail * shift + rank, side="right") - 1 if len(keys) else np.zeros(len(n), np.int64)
            sequence = full_at[doc] + np.array([full_base.get(int(t), 0) for t in tail], np.int64)[doc] + piece - has[doc]
            offset = np.zeros(len(doc), np.int64)
            if is_tail.any():
                d = doc[is_tail]
                q = tail[d] * shift + rank[d] - keys[at[d]]
                sequence[is_tail] = seq[at[d]] + q // mult[at[d]]
                offset[is_tail] = off[at[d]] + q % mult[at[d]] * tail[d]
            start = np.where(is_tail | (has[doc] == 0), 0, tail[doc]) + np.where(has[doc] == 1, np.maximum(piece - 1, 0), piece) * capacity
            arrays = [batch.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), start, np.where(is_tail, tail[doc], capacity), batch.column("crcs").flatten(), sequence, offset]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(read(spark, sf_dir, "documents"))
