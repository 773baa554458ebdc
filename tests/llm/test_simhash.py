import random

import numpy as np
import xxhash

from tests.llm.fixtures import PROSE, empty, odd
from vanewright.llm import simhash
from vanewright.llm.common import Scratch
from vanewright.llm.neardup import components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, k=3):
    """Bit by bit over the listed shingles."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def plain_components(nodes):
    """Smallest name by brute force over all pairs of (name, fingerprint)."""
    values = sorted({p for _, p in nodes})
    v = np.array(values, np.uint64)
    root = np.arange(len(v))
    near = [np.flatnonzero(np.bitwise_count(v ^ x) <= 2) for x in v]
    seen = np.zeros(len(v), bool)
    for s in range(len(v)):
        todo = [s] if not seen[s] else []
        while todo:
            i = todo.pop()
            if not seen[i]:
                seen[i], root[i] = True, s
                todo.extend(near[i].tolist())
    of = dict(zip(values, root.tolist(), strict=True))
    least = {}
    for name, p in nodes:
        if name is not None:
            least[of[p]] = min(name, least.get(of[p], name))
    return [(name, f"{p:016x}", least.get(of[p])) for name, p in nodes]


def ordered(rows):
    return sorted(rows, key=str)


def got(df):
    return ordered((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows])
    assert got(simhash.op12_simhash_multi_index(spark, SF)) == ordered(want)
    assert len({c for _, _, c in want}) < len(want)


def test_odd_rows(spark):
    rows = odd(spark).select("doc_id", "text").collect()
    assert got(simhash.similar(odd(spark))) == ordered(plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]))
    assert simhash.similar(empty(spark)).count() == 0


def test_texts_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 7, 9, 10, 400):
        text = " \n".join(rng.choice(PROSE.split()).title() for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("ab " * 300_000) == plain_fingerprint("ab ab ab")


def near_values(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def linked(spark, values):
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    scratch = Scratch(spark, "test")
    prints = spark.createDataFrame(signed, "print long")
    found = simhash.links(scratch, prints)
    comp = {r["id"]: r["component"] for r in components(scratch, found).collect()}
    groups = {}
    for (s,), v in zip(signed, values, strict=True):
        groups.setdefault(comp.get(s, s), []).append(v)
    return ordered(groups.values()), found.count()


def brute_groups(values):
    groups = {}
    for name, _, c in plain_components([(v, v) for v in values]):
        groups.setdefault(c, []).append(name)
    return ordered(groups.values())


def test_links_by_segments_and_by_midpoints(spark, monkeypatch):
    values = near_values(random.Random(1), 40, 12, 4) + [0, (1 << 64) - 1, 1 << 63, (1 << 63) | 3, 3 << 31]
    for bucket in (128, 4, 1):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert linked(spark, values)[0] == brute_groups(values)


def test_pairs_at_every_two_bits(spark):
    """Two flipped bits anywhere are found, three never link."""
    rng = random.Random(3)
    values = []
    for i in range(0, 64, 3):
        for j in range(i + 1, 64, 5):
            x = rng.getrandbits(64)
            values += [x, x ^ (1 << i) ^ (1 << j)]
    values += [7 << 40, 0]
    assert linked(spark, values)[0] == brute_groups(values)


def test_one_crowd_gives_linear_links(spark, monkeypatch):
    """All fingerprints share their first segment: midpoints keep the links linear."""
    monkeypatch.setattr(simhash, "BUCKET", 32)
    rng = random.Random(2)
    made = []
    for n in (500, 2000):
        values = sorted({(0xABC << 40) | rng.getrandbits(14) for _ in range(n)})
        groups, count = linked(spark, values)
        assert groups == brute_groups(values)
        made.append(count / len(values))
    assert made[1] < 65
