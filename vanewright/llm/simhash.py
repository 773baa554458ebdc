"""SimHash near-duplicates by multi-index hashing.

1. One pass makes each text's 64-bit fingerprint: bit i is set where it is set in over half of the hashes of the text's
   word shingles, repeats included. Equal fingerprints become one node.
2. A fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most two bits differ in at most
   one bit of the first segment, or not at all in the second. So each fingerprint looks up, in the table of first
   segments, the Hamming ball of radius one around its own, and in the table of second segments its own. Of two segments
   that differ in one bit only the one without the bit looks for the other. Whatever is fetched is verified on all 64
   bits inside the join.
3. An entry that over BUCKET look-ups meet would fetch their pairs. All fingerprints that meet there are linked by
   midpoints instead: two fingerprints differ in at most two bits exactly if some 64-bit value differs in at most one bit
   from both. Each gives its 65 values; at most 65 fingerprints share one, and all that do are linked with one another.
   So no link is lost, and rows stay linear in the fingerprints however many fall together.
4. Components come from alternating large-star and small-star steps on the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, is_common, join_keys, read, words
from .neardup import components

#: Fingerprints link at so many differing bits or fewer. Segments, ball radii and midpoints follow from it.
DISTANCE = 2
SEGMENT = 32
#: Look-ups of one table entry beyond which its fingerprints are linked by midpoints.
BUCKET = 128
SEED = 42
#: Shingles hashed at a time.
CHUNK = 1 << 16

_bit = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: str | None, k: int = 3) -> int:
    """The fingerprint of a text's k-word shingles; of the whole sequence if it has fewer words; zero without words."""
    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(w) - k + 1)
    starts, ends = starts[:n].tolist(), ends[len(w) - n :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        octets = h.view(np.uint8).reshape(-1, 8)
        ones += np.stack([np.bincount(octets[:, j], minlength=256) @ _bit for j in range(8)])
    return int(np.packbits(2 * ones.ravel() > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, print) of every row, the fingerprint as signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                prints = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, print long")


def _flips(value: Column, bits: int) -> list[Column]:
    """The value with each of its ``bits`` lowest bits flipped, one by one."""
    return [value.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(bits)]


def lookups(prints: DataFrame) -> DataFrame:
    """(segment, key, print, own): the table entries that each fingerprint looks up; ``own`` marks its own entries."""
    first, second = F.shiftrightunsigned("print", SEGMENT), F.col("print").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    entry = lambda segment, key, own: F.struct(F.lit(segment).alias("segment"), key.alias("key"), F.lit(own).alias("own"))
    ball = F.filter(F.array(*_flips(first, SEGMENT)), lambda x: x > first)
    at = F.concat(F.array(entry(0, first, True), entry(1, second, True)), F.transform(ball, lambda x: entry(0, x, False)))
    return prints.select("print", F.explode(at).alias("at")).select("at.segment", "at.key", "print", "at.own")


def midpoint_links(prints: DataFrame) -> DataFrame:
    """(a, b): of all fingerprints within two bits of one another, links that join the same components."""
    values = F.array(F.col("print"), *_flips(F.col("print"), 64))
    shared = prints.select("print", F.explode(values).alias("value")).groupBy("value").agg(F.collect_list("print").alias("met")).where(F.size("met") > 1)
    return shared.select(F.explode("met").alias("a"), F.array_min("met").alias("b")).where("a <> b")


def links(scratch: Scratch, prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (print), whose components are those of all links."""
    looked = lookups(prints)
    total = prints.count() * (2 + SEGMENT // 2)
    counts = looked.groupBy("segment", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    hot = scratch.save(counts.select("segment", "key", is_common(F.col("n"), total).alias("common")), "hot")
    key = ["segment", "key"]
    cold = looked.join(F.broadcast(hot.where("common")), key, "left_anti").join(hot.where("not common"), key, "left_anti")
    table = cold.where("own").select(*key, F.col("print").alias("other"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= DISTANCE
    once = ~F.col("own") | (F.col("other") < F.col("print"))
    fetched = cold.join(table, key).where(once & near).select(F.col("print").alias("a"), F.col("other").alias("b"))
    crowded = join_keys(looked, hot, key).select("print").distinct()
    return scratch.save(fetched.union(midpoint_links(crowded)).distinct(), "links")


def similar(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, print) of every row.

    Fingerprints of k-word shingles link at DISTANCE or fewer differing bits; component_id is the smallest doc_id
    reachable over links. ``fingerprint`` has 16 lowercase hex digits, ``print`` is the same as signed long. Null, empty
    and blank texts have fingerprint zero, which links like any other. A text of fewer than k words is one shingle. Rows
    with the same doc_id are each a document, with their own text. A row with a null doc_id links others but names
    nothing: a component of such rows alone has a null component_id. Other columns are ignored. No rows give none.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    made = scratch.save(fingerprints(docs, k), "prints")
    classes = scratch.save(made.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    found = components(scratch, links(scratch, classes.select("print")))
    named = scratch.save(classes.join(found.withColumnRenamed("id", "print"), "print", "left").select("print", "rep", "size", F.coalesce("component", "print").alias("root")), "named")
    roots = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    roots = roots.select("root", "component_id", is_common(F.col("n"), classes.count()).alias("common"))
    whole = join_keys(named, roots, ["root"]).select("print", "component_id", is_common(F.col("size"), made.count()).alias("common"))
    out = join_keys(made, scratch.save(whole, "whole"), ["print"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "print")


def op12_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents on 3-word shingles."""
    return similar(read(spark, sf_dir, "documents")).drop("print")
