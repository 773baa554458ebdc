"""Prefix trie of conversations.

1. A conversation becomes the array of its turns' digests with the word count of each. The arrays are sorted globally by
   range partitions, so that conversations with a common beginning stand together, and those that end at a node stand
   before those that go on.
2. Each partition is swept once with a stack: the longest common prefix (LCP) with the conversation before closes the
   nodes that are deeper, and the rest of the array opens new ones. A node that is closed is an LCP interval: it hands
   its sums to its parent and is whole.
3. Nodes of the first conversation of a partition may have begun in an earlier one, and those that are open at its end
   may go on in a later one. A partition reports these two paths instead of closing them, and the stitch carries one
   stack over the reports in order: it merges reports of the same node and closes what the next partition doesn't
   continue. It reads one report for each level of two paths of a partition, so a few rows for TURNS turns.
4. Children of a reported node learn their parent's smallest member by a join with the stitched reports.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, read

#: Turns that a partition is meant to hold; a partition keeps a few numbers for each of its nodes.
TURNS = 500_000
#: Conversations take their first turns from the one whose id is the next lower multiple of this, HEADS turns or fewer.
FAMILY, HEADS = 20, 4
DIGEST = 16

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SWEPT = f"{NODE}, part long, slot long, report boolean, open boolean, words long, ends binary, first binary, last binary"
STITCHED = f"{NODE}, part long, slot long"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def turn_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, t): each conversation's turns in order, as structs of turn, digest (hex) and word count."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    words = F.regexp_count(text, F.lit(f"[^{BLANKS}]+")).cast("long")
    one = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("d"), words.alias("w"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, t) with the first h turns taken from the family's first conversation, h = crc32(conv_id) % HEADS."""
    heads = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("family"), F.slice("t", 1, HEADS - 1).alias("head"))
    joined = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.slice("t", 1, 0)
    head = F.coalesce(F.slice("head", F.lit(1), h), none)
    return joined.select("conv_id", F.concat(head, F.slice("t", h + 1, F.greatest(F.size("t"), F.lit(1)))).alias("t"))


class Node:
    """An open node: what its members, as far as they are whole, have added up to."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "words", "ends", "kids", "slot", "places")

    def __init__(self, words: int, slot: int | None = None):
        self.conv: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.words, self.slot = words, slot
        self.ends: list = []
        self.kids: list[tuple] = []
        self.places: list[tuple[int, int]] = []

    def meet(self, conv: int | None, n: int) -> None:
        if conv is not None:
            self.conv = conv if self.conv is None else min(conv, self.conv)
        self.n += n

    def adopt(self, child: Node) -> None:
        """Take over the sums of a child that is whole."""
        self.meet(child.conv, child.n)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def close(self) -> None:
        """All members and children are known."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.words

    def row(self, depth: int, digest: str) -> tuple:
        return self.conv, depth, self.n, self.children, self.leaves, self.saved, digest


def common_turns(a: bytes, b: bytes) -> int:
    """The number of turns with which both arrays begin."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def full(row: tuple, parent: int | None) -> tuple:
    return row[0], row[1], parent, *row[2:]


def sweep(rows: Iterable[tuple[int, bytes, list[int]]], part: int) -> Iterator[tuple]:
    """Rows of SWEPT from a partition's (conv_id, key, word counts) in the order of (key, conv_id)."""
    blank = (None,) * 8
    stack: list[Node] = []
    first, last, free = None, b"", 0

    def report(node: Node, depth: int, is_open: bool) -> Iterator[tuple]:
        ends = ",".join(map(str, node.ends)).encode()
        keys = (first, last) if node.slot == 0 else (None, None)
        yield (node.conv, depth, None, node.n, node.children, node.leaves, node.saved, None, part, node.slot, True, is_open, node.words, ends, *keys)
        for kid in node.kids:
            yield (*full(kid, None), part, node.slot, False, *blank[:5])

    for conv, key, counts in rows:
        depth = len(key) // DIGEST
        if first is None:
            first = key
            stack = [Node(w, slot) for slot, w in enumerate([0, *counts])]
            free = len(stack)
        else:
            shared = common_turns(last, key)
            while len(stack) - 1 > shared:
                at = len(stack) - 1
                node = stack.pop()
                if node.slot is not None:
                    yield from report(node, at, False)
                    continue
                node.close()
                for kid in node.kids:
                    yield (*full(kid, node.conv), None, None, False, *blank[:5])
                stack[-1].adopt(node)
                stack[-1].kids.append(node.row(at, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()))
            stack.extend(Node(w) for w in counts[shared:])
        last = key
        stack[depth].meet(conv, 1)
        stack[depth].ends.append(conv)
    for depth, node in enumerate(stack):
        if node.slot is None:
            node.slot = free
            free += 1
        yield from report(node, depth, True)


def stitch(reports: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of STITCHED from reports (part, slot, depth, open, conv_id, n, children, leaves, saved, words, ends, first,
    last) in the order of (part, slot): the nodes, and for each report (part, slot) its node's smallest member."""
    stack: list[Node] = []
    before, path, part, opened = b"", 0, None, 0

    def pop() -> Iterator[tuple]:
        node = stack.pop()
        node.close()
        for kid in node.kids:
            yield (*full(kid, node.conv), None, None)
        for place in node.places:
            yield (node.conv, *(None,) * 7, *place)
        row = node.row(len(stack), (node.ends[0] if node.ends else hashlib.sha256()).hexdigest())
        if stack:
            stack[-1].adopt(node)
            stack[-1].kids.append(row)
        else:
            yield (*full(row, None), None, None)

    for at, slot, depth, is_open, conv, n, children, leaves, saved, words, ends, first, last in reports:
        if at != part:
            shared = common_turns(before, first) if part is not None else 0
            while len(stack) - 1 > shared:
                yield from pop()
            before, path, part, opened = last, len(first) // DIGEST, at, -1
        if slot == path + 1:
            while len(stack) - 1 > opened:
                yield from pop()
        if slot <= path and is_open:
            opened = depth
        if depth == len(stack):
            stack.append(Node(words))
        node = stack[depth]
        node.meet(conv, n)
        node.children += children
        node.leaves += leaves
        node.saved += saved
        node.places.append((at, slot))
        if ends:
            if node.ends:
                node.ends[0].update(b"," + ends)
            else:
                node.ends = [hashlib.sha256(ends)]
    while stack:
        yield from pop()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True)


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, t), t an array of structs with ``d`` (digest in hex) and ``w`` (word count).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node: smallest
    member, its parent's smallest member (null for the root), members, children, childless nodes in its subtree, the
    subtree's sum of (n_convs - 1) times the words of the last turn, and the SHA-256 of the conv_ids that end here. No
    sequences have no nodes, not even a root.

    The sums of a node that many partitions share are merged from one report of each; the ids that end there are hashed
    in order as they stream by, since SHA-256 can't be merged. A task holds the digests of one conversation at a time
    and a few numbers for each node of its partition.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark, "trie")
    keyed = sequences.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), "")).alias("key"), F.transform("t", lambda x: x["w"]).alias("counts"))
    keyed = scratch.save(keyed, "keyed")
    turns = keyed.agg(F.sum(F.size("counts") + 1)).first()[0] or 0
    parts = max(-(-turns // TURNS), spark.sparkContext.defaultParallelism)
    swept_schema, stitched_schema = _schema(SWEPT), _schema(STITCHED)

    def run_sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(sweep(_rows(batches), TaskContext.get().partitionId()), swept_schema)

    def run_stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(stitch(_rows(batches)), stitched_schema)

    ordered = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = scratch.save(ordered.mapInArrow(run_sweep, SWEPT), "swept")
    reports = swept.where("report").select("part", "slot", "depth", "open", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "ends", "first", "last")
    stitched = scratch.save(reports.repartition(1).sortWithinPartitions("part", "slot").mapInArrow(run_stitch, STITCHED), "stitched")
    places = stitched.where("part is not null").select("part", "slot", F.col("conv_id").alias("parent"))
    inner = swept.where("not report")
    below = inner.where("part is not null").drop("parent_conv_id").join(places, ["part", "slot"]).withColumnRenamed("parent", "parent_conv_id")
    return inner.where("part is null").select(*COLUMNS).union(below.select(*COLUMNS)).union(stitched.where("part is null").select(*COLUMNS))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """Prefix trie of rebuilt conversations of a table (conv_id, turn, role, text); see prefix_nodes for its columns.

    Turns are ordered by turn, null first; turns with the same number by their digests, so that repeated rows and ties
    have one order. A null role or text is empty. Every conversation c begins with the first h turns of conversation
    c - c % 20 (all if fewer, none if absent), h = crc32(c as text) % 4, and goes on with its own turns after its first
    h; it may end up without turns and is then a member of the root. Two turns are the same if role and text are. Rows
    with a null conv_id belong to no conversation. Other columns are ignored. An empty table has no nodes.
    """
    own = Scratch(turns.sparkSession, "conversations").save(turn_arrays(turns), "own")
    return prefix_nodes(rebuilt(own))


OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+')) AS BIGINT) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'d': d, 'w': w}} ORDER BY turn NULLS FIRST, d) AS t FROM t GROUP BY 1),
crc(i, v) AS (
  SELECT i, list_reduce(list_prepend(i, generate_series(1, 8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) FROM generate_series(0, 255) AS s(i)),
tab AS (SELECT list(v ORDER BY i) AS v FROM crc),
h AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda a, b: xor(a // 256, v[xor(a % 256, b) % 256 + 1])), 4294967295) % 4 AS h
  FROM own, tab),
r AS (
  SELECT o.conv_id, list_concat(coalesce(p.t, [])[:h.h], o.t[h.h + 1:]) AS t
  FROM own o JOIN h USING (conv_id) LEFT JOIN own p ON p.conv_id = o.conv_id - o.conv_id % 20),
x AS (SELECT conv_id, t, unnest(generate_series(0, len(t))) AS depth FROM r),
p AS (SELECT conv_id, depth, len(t) AS n_turns, sha256(CAST(list_transform(t[:depth], lambda y: y.d) AS VARCHAR)) AS node, CASE WHEN depth = 0 THEN 0 ELSE t[depth].w END AS w FROM x),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
up AS (SELECT n.node, q.node AS above, q.depth AS above_depth, n.depth, n.own FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth),
kids AS (SELECT above AS node, count(*) AS n FROM up WHERE depth = above_depth + 1 GROUP BY 1),
sums AS (SELECT above AS node, sum(own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM up LEFT JOIN kids ON kids.node = up.node GROUP BY 1)
SELECT n.conv_id, n.depth, b.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sums ON sums.node = n.node LEFT JOIN kids ON kids.node = n.node
LEFT JOIN up ON up.node = n.node AND up.above_depth = n.depth - 1 LEFT JOIN n b ON b.node = up.above
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations."""
    return conversation_trie(read(spark, sf_dir, "conversations"))
