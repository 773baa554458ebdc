"""Secret scan: base patterns plus dictionary-primed compression novelty.

A string in a sensitive context is a secret if it is news to a compressor that already knows ordinary identifiers and
the text around it: its marginal cost is the compressed size of "surroundings + string" less that of the surroundings
alone, under a zstandard dictionary of identifiers. Random keys cost nearly their entropy, names and words next to
nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make their line a sensitive context for the novelty measure.
CONTEXT_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential", "private", "signature", "akia", "key=", "key:")
#: What may stand between a separator and the end of its line: an opening quote, bracket or block mark.
_OPENING = "\"'`([{|>\\"
_TEXT = re.compile(r"\S")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
_WORDS = """access account action address admin algorithm alias amount api app application archive array async attribute auth
author backend batch binary block body boolean branch buffer build byte cache callback category certificate channel char check class
client cloud cluster code collection column command comment commit component config connection console constant container content
context control cookie copy count create credential current cursor data database date debug default delete dependency deploy
description detail device dictionary directory display document domain download driver element email enable encoding endpoint engine
entity entry environment error event example exception execute export expression extension factory false feature field file filter
flag folder format frame function gateway generate get global group handler hash header height hidden host html http identifier image
import index info input insert instance integer interface internal item iterator json key label language layout length level library
limit line link list listener load local lock log login loop manager map master match memory menu merge message metadata method model
module monitor mount name namespace network node null number object offset open operation option order output owner package page panel
parameter parent parse password patch path pattern payload permission plugin pointer policy pool port position post prefix private
process product profile project property protocol provider proxy public query queue random range read record redirect reference region
register release remote remove render replace report repository request resource response result return role root route rule runtime
sample schedule schema scope script search secret section select sequence serial server service session set setting shared signature
size socket sort source stack start state static status storage store stream string style submit subject suffix support sync syntax
system table target task template test text thread time timeout timestamp title token tool topic total transaction transfer trigger
true type unit update upload url user username utility validate value variable vector vendor verify version view virtual visible web
width window worker workspace wrapper write zone"""


def dictionary(words: str = _WORDS) -> bytes:
    """Identifiers in the usual spellings (snake, camel, upper), made from a word list."""
    w = words.split()
    pairs = list(zip(w, w[1:], strict=False))
    return "\n".join([*w, *(f"{a}_{b}" for a, b in pairs), *(a + b.title() for a, b in pairs), *(f"{a}_{b}".upper() for a, b in pairs), "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx ----------------"]).encode()


class Novelty:
    """Marginal compressed bytes of a string, given its surroundings and the identifier dictionary."""

    def __init__(self, words: str = _WORDS, level: int = 6):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._size = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def cost(self, candidate: str, around: str) -> int:
        ctx = around.encode()
        return len(self._size.compress(ctx + b"\n" + candidate.encode())) - len(self._size.compress(ctx + b"\n"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the base patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def carried(low: str, hits: set[int]) -> list[int]:
    """Starts of the lines in a sensitive context: ``hits``, the next line with text after one that ends in a separator,
    and all lines from a BEGIN mark in a hit to the next END mark, or to the end of the text if there is none."""
    lines, reach = set(hits), 0
    for start in sorted(hits):
        end = low.find("\n", start)
        line = low[start:] if end < 0 else low[start:end]
        to = 0
        if (begin := line.rfind("-----begin ")) >= 0 and "-----end " not in line[begin:]:
            if start < reach:
                continue
            mark = low.find("-----end ", start)
            to = reach = len(low) if mark < 0 else mark
        elif line.rstrip().rstrip("+-").rstrip(_OPENING).rstrip().endswith((":", "=")) and (value := _TEXT.search(low, start + len(line))):
            to = value.end()
        while 0 <= end < to:
            lines.add(end + 1)
            end = low.find("\n", end + 1)
    return sorted(lines)


def disjoint(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, sorted by start, cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, ratio: float, window: int) -> list[tuple[int, int, int]]:
    """Strings of 16 or more characters in a sensitive context, outside base spans, that cost at least ``ratio`` bytes
    a character beyond what the ``window`` characters on both sides and the dictionary explain. The context is a line
    with a context word and what ``carried`` adds to it; nothing but the cost decides."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length: fold ASCII only
        low = text.encode("utf-32-le").decode("utf-32-le").translate({c: c + 32 for c in range(65, 91)})
    hits: set[int] = set()
    for w in CONTEXT_WORDS:
        at = low.find(w)
        while at >= 0:
            hits.add(low.rfind("\n", 0, at) + 1)
            end = low.find("\n", at)
            at = low.find(w, end) if end >= 0 else -1
    out = []
    starts, ends = disjoint(base)
    for start in carried(low, hits):
        end = low.find("\n", start)
        end = len(low) if end < 0 else end
        for m in _CANDIDATE.finditer(text, start, end):
            a, b = m.span()
            if (i := bisect_left(ends, a + 1)) < len(ends) and starts[i] < b:
                continue
            s = m[0]
            around = text[max(0, a - window) : a] + text[b : b + window]
            if novelty.cost(s, around) >= ratio * len(s):
                out.append((a, b, 3))
    return out


_novelty: dict[str, Novelty] = {}


def find_secrets(docs: DataFrame, ratio: float = 0.6, window: int = 400, words: str = _WORDS) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every text; offsets are code points, end exclusive.

    Spans are sorted by start, then kind. Null and empty texts have no spans; every input row gives one row, repeated
    rows and null ids included. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = _novelty.setdefault(words, Novelty(words))
        for batch in batches:
            spans = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                found = sorted(base + novel_spans(text, base, novelty, ratio, window), key=lambda s: (s[0], s[2])) if text else []
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents with digests of the base spans."""
    found = find_secrets(read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("novel").alias("n_novel"))
