import hashlib
import random
import zlib
from collections import defaultdict

from tests.oracle import differences
from vanewright.llm import trie

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, t string"


def words(text):
    return len("".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ")) - "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ").count("")


def plain(rows):
    """Nodes of the trie of rebuilt conversations, node by node from dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(turns.get(family, [])[:h] + t[h:])
    return nodes_of(whole)


def nodes_of(whole):
    members = defaultdict(list)
    for c, t in sorted(whole.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (words(p[-1][1]) if p else 0)
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = own + sum(saved[k] for k in children[p])
        ends = ",".join(str(c) for c in members[p] if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in trie.COLUMNS) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def test_query_equals_sql_and_brute_force(spark):
    assert differences(spark, SF, trie.op13_prefix_trie, trie.OP13_SQL) == []
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(trie.op13_prefix_trie(spark, SF)) == plain(rows)


def made(seed, convs, letters, longest):
    """Conversations over few turns, so that they share beginnings and repeat, over several partitions."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-convs, 2 * convs), convs):
        hot = rng.random() < 0.35
        n = 3 if hot else rng.choice([1, 2, 3, rng.randrange(1, longest)])
        for i in range(n):
            rows.append((c, i, "user" if i % 2 else "assistant", "same turn" if hot or rng.random() < 0.4 else f"turn {rng.randrange(letters)}"))
    rng.shuffle(rows)
    return rows


def test_stacks_across_partitions(spark, monkeypatch):
    for turns, seed in ((40, 1), (7, 2), (3, 3)):
        monkeypatch.setattr(trie, "TURNS", turns)
        rows = made(seed, 60, 3, 12)
        assert got(trie.conversation_trie(table(spark, rows))) == plain(rows)


def test_any_cut_of_the_sorted_arrays():
    """The stitch of swept pieces gives the nodes of the whole, wherever it is cut."""
    rng = random.Random(4)
    for _ in range(300):
        whole = {c: tuple(("u", rng.choice("ab")) for _ in range(rng.choice([0, 1, 2, 3, 6]))) for c in rng.sample(range(-30, 90), rng.randrange(1, 25))}
        ordered = sorted((b"".join(hashlib.md5(t[1].encode()).digest() for t in v), c) for c, v in whole.items())
        rows = [(c, k, [1] * (len(k) // 16)) for k, c in ordered]
        cuts = [0, *sorted(rng.choices(range(len(rows) + 1), k=rng.randrange(6))), len(rows)]
        swept = [r for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b for r in trie.sweep(rows[a:b], i)]
        reports = sorted((r[8], r[9], r[1], r[11], r[0], *r[3:7], r[12], r[13], r[14], r[15]) for r in swept if r[10])
        out = list(trie.stitch(reports))
        places = {(r[8], r[9]): r[0] for r in out if r[8] is not None}
        found = [r[:8] for r in swept if not r[10] and r[8] is None] + [(*r[:2], places[r[8], r[9]], *r[3:8]) for r in swept if not r[10] and r[8] is not None] + [r[:8] for r in out if r[8] is None]
        assert sorted(found, key=str) == nodes_of(whole)


def test_odd_rows(spark):
    rows = [
        (20, 0, "user", "a b"), (20, None, None, "null first"), (20, 1, "user", None), (20, 1, "user", None), (21, 5, "user", "own\tturn \n here"), (21, 5, "assistant", "tie"), (22, 0, "user", ""), (22, 0, None, ""),
        (40, 0, "", ""), (None, 0, "user", "nobody"), (-7, 0, "user", "a b"), (-7, 1, "user", "a b"), (0, 0, "user", "a b"), (1, 0, "user", "été \U0001f600"), (119, None, None, None), (20_000_000_001, 3, "user", "x" * 100_000),
    ]
    assert got(trie.conversation_trie(table(spark, rows))) == plain(rows)
    turnless = [(c, 0, "user", "only") for c in (61, 62, 63, 64, 65, 66, 67, 68)]
    nodes = got(trie.conversation_trie(table(spark, turnless)))
    assert nodes == plain(turnless) and len(nodes) == 2
    assert trie.conversation_trie(table(spark, []).where("false")).count() == 0


def test_one_very_long_conversation(spark):
    rows = [(20, i, "user", f"t{i % 7}") for i in range(3000)] + [(40, i, "user", f"t{i % 7}") for i in range(2500)]
    nodes = got(trie.conversation_trie(table(spark, rows)))
    assert nodes == plain(rows)
