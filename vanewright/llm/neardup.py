"""MinHash near-duplicates with Odd sketches.

1. One pass makes each text's distinct word shingles and from them a set digest, a MinHash signature, the band keys
   of that signature, and its Odd sketch: the signature's (index, value) pairs folded into a parity bitmap. The number
   of bits in which two such bitmaps differ estimates the signatures' symmetric difference, most precisely where
   similarity is high.
2. Equal sets become one node, so exact copies cost one aggregated row, however many there are.
3. Nodes that share a band key are candidates. A bucket's nodes are held against one pivot each (a star, linear in
   the bucket), whatever passes the size and Odd sketch tests is confirmed on the full sets, and linked nodes are
   contracted. Buckets that still hold several components are cut into blocks of bounded size which meet in pairs,
   except those of the bucket's largest component among themselves: the sketches first tell which nodes have a partner
   in another component at all, then only these bring their texts, and all their pairs are confirmed at once. A pair of
   blocks returns a spanning forest of its links. A bucket whose nodes would be dealt out too often is crowded: further
   pivots take stars of it, and when they find nothing more it is refined: its nodes are dealt by half bands, other
   samples of their signatures, so that rows stay linear in the bucket. So a bucket with very many nodes, linked or
   not, is never expanded into its pairs.
4. Components come from alternating large-star and small-star steps on the confirmed links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hashes, is_common, join_keys, mix, read, signed, words

BANDS, ROWS = 40, 6
BITS = 512
LANES = BITS // 64
#: Nodes, and shingles, that a block is meant to hold.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Rows dealt to pairs of blocks for each row of an open bucket, beyond which the bucket is crowded.
DEALT = 8
#: Half bands by which a crowded bucket is refined, once. A pair at the threshold misses all of them with probability
#: 2e-5 (and every other bucket that it shares would have to be crowded too).
HALVES = 16
#: Crowded buckets get another star as long as one links at least this share of the nodes it has looked at.
STAR_SHARE = 0.05
#: Rows of a star that meet one copy of their pivot's text.
PIVOT_ROWS = 1024
#: Node ids up to which they are broadcast to pick out texts; beyond, texts are shuffled to meet them.
BROADCAST_IDS = 500_000
#: Odd sketch tests pass estimates down to this far below the threshold (about six standard deviations).
MARGIN = 0.18


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it has fewer words."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(w), seed=k)], np.uint64)
    h = hashes(w)
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[i : i + n]
    return np.unique(mix(acc))


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of len(a) hash functions over a set; the set is worked through in blocks."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = np.multiply.outer(a, x[at : at + 2048])
        v += b[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def odd_sketches(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps (rows of uint64 lanes) of signatures (rows of m)."""
    pos = mix((m.astype(np.uint64) << np.uint64(16)) ^ np.arange(m.shape[1], dtype=np.uint64)) % np.uint64(bits)
    cell = pos.astype(np.int64) + np.arange(len(m))[:, None] * bits
    parity = (np.bincount(cell.ravel(), minlength=len(m) * bits) & 1).astype(np.uint8).reshape(len(m), bits)
    return np.packbits(parity, axis=1).view(np.uint64).reshape(len(m), bits // 64)


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.zeros((len(m), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    cut = m.astype(np.uint64).reshape(len(m), bands, rows)
    for i in range(rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return acc


def half_keys(m: np.ndarray, rows: int) -> np.ndarray:
    """16-bit keys of half bands: of the first and of the other samples of each band."""
    cut = m.astype(np.uint64).reshape(len(m), -1, rows)
    out = np.zeros((len(m), cut.shape[1], 2), np.uint64)
    for i in range(rows):
        side = int(i >= rows // 2)
        out[:, :, side] = mix(out[:, :, side] * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return (out >> np.uint64(48)).astype("<u2").reshape(len(m), -1)


def most_differing(similarity: float, samples: int, bits: int = BITS) -> int:
    """The number of differing bits up to which an estimate is at least ``similarity``."""
    difference = 2 * samples * (1 - similarity)
    return math.ceil(bits / 2 * (1 - math.exp(-2 * difference / bits)))


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, digest, odd, bands, halves); the last four are null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(bands * rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ns, digests, sigs = [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingles(text, k)
                    ns.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(s, a, b))
                m = np.vstack(sigs)
                empty = np.array(ns) == 0
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(ns) * x.shape[1] + 1, x.shape[1], dtype=np.int32)), pa.array(signed(x.ravel())), mask=pa.array(empty)) for x in (odd_sketches(m), band_keys(m, bands, rows))]
                halves = pa.array([None if e else x.tobytes() for e, x in zip(empty, half_keys(m, rows), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), *lists, halves], ["doc_id", "n", "digest", "odd", "bands", "halves"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n long, digest binary, odd array<long>, bands array<long>, halves binary")


def confirmed(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b, text_a, text_b), those (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, int, np.ndarray] = (None, 0, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            for i in range(batch.num_rows):
                right = tb[i].as_py()
                key = (b[i].as_py(), hash(right))
                if key != last[:2]:
                    last = (*key, shingles(right, k))
                x, y = shingles(ta[i].as_py(), k), last[2]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component) of every linked node but the smallest of each component, which is its name."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        after = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if after == before or not after[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = after
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, edges = edges, scratch.save(small, "edges")
        scratch.drop(old, large)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two texts are linked if their sets of k-word shingles have 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable over links; kept marks it. A text of fewer than k words has its whole sequence as
    one shingle. Null, empty and blank texts have none and are linked with nothing. Rows with the same doc_id count as
    one document (it is linked if one of its texts is); each still gives a row. A row with a null doc_id can't be named
    as a component: it takes no part, has a null component_id and is kept. Other columns are ignored.

    With 40 bands of 6 rows a pair at the threshold misses all bands with probability 5e-6. Buckets with most of the
    rows are broadcast by key (10,000 at most); a text of any length is worked on whole, and blocks hold fewer of long
    ones.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.save(sketch(docs, k, bands, rows), "sketches")
    whole = sig.where("digest is not null and doc_id is not null")
    classes = scratch.save(whole.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    nodes = whole.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    nodes = scratch.save(nodes.select(F.col("doc_id").alias("id"), "n", "odd", "bands", "halves"), "nodes")
    lanes = nodes.select("id", "n", "odd")

    # Buckets with two nodes or more; of buckets with the same nodes, one.
    keyed = nodes.select(F.posexplode("bands").alias("band", "key"), "id")
    total = nodes.count() * bands
    keys = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot"), F.max("id").alias("last"), F.bit_xor(F.xxhash64("id")).alias("print")).where("pivot <> last")
    keys = keys.groupBy("size", "pivot", "last", "print").agg(F.min("key").alias("key")).select("key", "pivot", is_common(F.col("size"), total).alias("common"))
    buckets = scratch.save(join_keys(keyed, scratch.save(keys, "keys"), ["key"]).select("key", "band", "id", "pivot", "common"), "buckets")
    ids = scratch.save(buckets.select(F.col("id").alias("doc_id")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    members = scratch.save(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").distinct(), "texts")

    most = most_differing(percent / 100 - MARGIN, bands * rows)

    def side(name: str, table: DataFrame) -> DataFrame:
        return table.select(*(F.col(c).alias({"id": name, "doc_id": name}.get(c, f"{c}_{name}")) for c in table.columns))

    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(LANES)))
    near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differ <= most)

    def linked(pairs: DataFrame) -> DataFrame:
        """The confirmed of pairs (a, b)."""
        close = scratch.save(pairs.distinct().join(side("a", lanes), "a").join(side("b", lanes), "b").where(near).select("a", "b").distinct(), "stars")
        found = confirmed(close_texts(scratch, close, side("a", members), side("b", members)), k, percent)
        return scratch.save(found.distinct(), "links")

    links = linked(buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    comp = components(scratch, links)
    buckets, final, fine = buckets.drop("pivot"), comp, False
    crowding = F.expr(f"outer * (no + ni) + inner * no > {DEALT} * (outer + inner)")
    while True:
        # written, as it is read three times: each reading would join all rows again
        now = scratch.save(buckets.join(comp, "id", "left").select("key", "band", "id", "common", F.coalesce("component", "id").alias("c")), "now")
        open_ = scratch.save(open_buckets(now), "open")
        if open_.isEmpty():
            break
        buckets = open_.select("key", "band", "id", "common")  # a bucket within one component stays so
        rows = open_.join(lanes.select("id", "n"), "id")
        sizes = scratch.save(block_counts(rows), "sizes")
        if fine or sizes.where(crowding).isEmpty():
            more = scratch.save(across(scratch, deal(rows, sizes), lanes, members, k, percent, most).distinct(), "more")
            final = components(scratch, links.union(more))
            break
        # a star of each open bucket's nodes outside its largest component, around one of them
        rest = open_.where("c <> low")
        pivots = rest.groupBy("key", "common").agg(F.min(F.struct("id", "c")).alias("p")).select("key", "common", F.col("p.id").alias("b"), F.col("p.c").alias("pc"))
        new = linked(join_keys(rest.drop("common", "low", "band"), pivots, ["key"]).where("c <> pc").select(F.col("id").alias("a"), "b"))
        n_new = new.count()
        if n_new:
            links = links.union(new)
            final = comp = components(scratch, links)
        if n_new < STAR_SHARE * rest.select("id").distinct().count():
            crowded = sizes.where(crowding).select("key", "common")
            calm = join_keys(open_.drop("common"), sizes.where(~crowding).select("key", "common"), ["key"]).select("key", "band", "id", "common")
            finer = refined(join_keys(open_.drop("common"), crowded, ["key"]), nodes, bands)
            buckets, fine = scratch.save(calm.unionByName(finer), "buckets"), True

    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    rest = sig.where("digest is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = whole.select("doc_id", "n", "digest").join(named, "digest").select("doc_id", "n", "component_id").union(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def close_texts(scratch: Scratch, close: DataFrame, texts_a: DataFrame, texts_b: DataFrame) -> DataFrame:
    """Pairs (a, b) with the texts of both. A pivot b that many pairs share has its text copied once for PIVOT_ROWS of
    them, so that they don't meet it in one task; there are at most COMMON such pivots."""
    sizes = close.groupBy("b").agg(F.count("*").alias("n"))
    many = sizes.where(is_common(F.col("n"), close.count()) & (F.col("n") > PIVOT_ROWS))
    slots = F.broadcast(scratch.save(many.select("b", F.ceil(F.col("n") / PIVOT_ROWS).alias("slots")), "slots"))
    one = F.coalesce("slots", F.lit(1))
    dealt = close.join(slots, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), one).alias("slot"))
    copies = texts_b.join(slots, "b", "left").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("slots")
    return dealt.join(texts_a, "a").join(copies, ["b", "slot"])


def refined(crowded: DataFrame, nodes: DataFrame, bands: int) -> DataFrame:
    """(key, band, id, common) of the buckets that nodes of a crowded bucket share by HALVES half bands each, none of
    the bucket's own band."""
    step = max(1, 2 * bands // HALVES)
    at = F.array(*(F.when(F.col("band") != i // 2, F.struct(F.lit(i).alias("i"), F.substring("halves", 2 * i + 1, 2).alias("h"))) for i in range(0, 2 * bands, step)))
    dealt = crowded.select("key", "band", "id").join(nodes.select("id", "halves"), "id").withColumn("at", F.explode(F.array_compact(at)))
    dealt = dealt.select(F.xxhash64("key", "at.i", "at.h").alias("key"), "band", "id")
    total = crowded.count() * HALVES
    keys = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", is_common(F.col("n"), total).alias("common"))
    return join_keys(dealt, keys, ["key"]).select("key", "band", "id", "common")


def open_buckets(now: DataFrame) -> DataFrame:
    """(key, band, id, common, c, low) of buckets with several components c; ``low`` is the one with most of its nodes."""
    parts = now.groupBy("key", "common", "c").agg(F.count("*").alias("n"))
    ends = parts.groupBy("key", "common").agg(F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return join_keys(now.drop("common"), ends.select("key", "common", (-F.col("top.c")).alias("low")), ["key"])


def block_counts(rows: DataFrame) -> DataFrame:
    """(key, common, outer, inner, no, ni): nodes outside and in the largest component, and blocks of each."""
    rest = F.col("c") != F.col("low")
    sides = {"outer": rest, "inner": ~rest}
    out = rows.groupBy("key", "common").agg(*(F.count(F.when(on, 1)).alias(x) for x, on in sides.items()), *(F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias(f"{x}_n") for x, on in sides.items()))
    blocks = lambda x: F.ceil(F.greatest(F.col(x) / BLOCK, F.col(f"{x}_n") / BLOCK_SHINGLES)).cast("int")
    return out.select("key", "common", "outer", "inner", blocks("outer").alias("no"), blocks("inner").alias("ni"))


def deal(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, i, j, rest, block, id, c): the nodes of open buckets, once for each pair of blocks that they belong to."""
    rows = join_keys(rows.drop("common"), sizes, ["key"]).select("key", "id", "c", (F.col("c") != F.col("low")).alias("rest"), "no", "ni")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("no")).otherwise(F.col("ni"))).cast("int"))
    other_rest = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda i: F.struct(F.least("block", i).alias("i"), F.greatest("block", i).alias("j")))
    with_inner = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(F.col("block").alias("i"), (-1 - i).alias("j")))
    to_outer = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j")))
    dealt = rows.select("key", "id", "c", F.explode(F.when(F.col("rest"), F.concat(other_rest, with_inner)).otherwise(to_outer)).alias("at"), "rest", "block")
    return dealt.select("key", "at.i", "at.j", "rest", "block", "id", "c")


def across(scratch: Scratch, dealt: DataFrame, lanes: DataFrame, members: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """Confirmed links (a, b) between different components of a bucket, as a spanning forest for each pair of blocks.

    A bucket's largest component is kept apart from the rest, both are cut into blocks of bounded size, and blocks meet
    in pairs; blocks within the largest component don't meet. So a task holds two blocks at a time, and work is linear
    in the largest component.
    """
    dealt = dealt.join(lanes, "id").select("key", "i", "j", "rest", "block", "id", "c", "n", "odd")

    def partners(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows that have a partner by size and sketch."""
        x, y, _ = candidates(pdf, percent, most)
        return pdf.iloc[np.unique(np.concatenate([x, y]))]

    kept = dealt.groupBy("key", "i", "j").applyInPandas(partners, dealt.schema)
    kept = scratch.save(kept, "partners").join(members.withColumnRenamed("doc_id", "id"), "id")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, z = candidates(pdf, percent, most)
        sets = [shingles(t, k) for t in pdf["text"]]
        ids = pdf["id"].to_numpy(np.int64)
        found = forest(sets, pdf["c"].to_numpy(np.int64), x, y, z, percent)
        return pd.DataFrame([(max(ids[p], ids[q]), min(ids[p], ids[q])) for p, q in found], columns=["a", "b"]).astype("int64")

    return kept.groupBy("key", "i", "j").applyInPandas(verify, "a long, b long")


def candidates(pdf: pd.DataFrame, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (x, y) of the pairs of two blocks that lie in different components and pass the size and sketch
    tests, with the number of differing bits."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    rest, block = pdf["rest"].to_numpy(bool), pdf["block"].to_numpy()
    left = np.flatnonzero(rest & (block == i))
    right = np.flatnonzero(~rest) if j < 0 else np.flatnonzero(rest & (block == j))
    if not len(left) or not len(right):
        return (np.zeros(0, np.int64),) * 3
    odd = np.vstack(pdf["odd"].to_numpy()).astype(np.int64).view(np.uint64)
    n, c = pdf["n"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
    differ = np.zeros((len(left), len(right)), np.int32)
    for lane in range(odd.shape[1]):
        differ += np.bitwise_count(odd[left, lane][:, None] ^ odd[right, lane][None, :])
    small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    ok = (c[left][:, None] != c[right][None, :]) & (100 * small >= percent * large) & (differ <= most)
    p, q = np.nonzero(ok)
    x, y, z = left[p], right[q], differ[p, q]
    once = x < y if i == j else np.ones(len(x), bool)
    return x[once], y[once], z[once]


def forest(sets: list[np.ndarray], comp: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the pairs whose sets are similar enough.

    Few pairs are intersected one by one, the likeliest first, and pairs that are joined already are passed over. For
    many, all intersection sizes come from products of 0/1 matrices over the elements that two sets share at all.
    """
    names, root = np.unique(comp, return_inverse=True)
    parent = np.arange(len(names))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    size = np.array([len(s) for s in sets], np.int64)
    if len(x) > 2000:
        rows, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
        flat = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), size[rows])
        _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[element] > 1
        column = (np.cumsum(count > 1) - 1)[element[shared]]
        owner = owner[shared]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        both = np.zeros((len(rows), len(rows)), np.float32)
        width = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            m = np.zeros((len(rows), width), np.float32)
            m[owner[a:b], column[a:b] - at] = 1
            both += m @ m.T
        xi, yi = inverse[: len(x)], inverse[len(x) :]
        common = both[xi, yi].astype(np.int64)
        good = 100 * common >= percent * (size[x] + size[y] - common)
        x, y, checked = x[good], y[good], True
    else:
        order = np.argsort(z, kind="stable")
        x, y, checked = x[order], y[order], False
    out = []
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(root[p]), find(root[q])
        if a == b:
            continue
        if not checked:
            common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 100 * common < percent * (len(sets[p]) + len(sets[q]) - common):
                continue
        parent[max(a, b)] = min(a, b)
        out.append((p, q))
    return out


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)
