"""The secret scan against a plain version over whole texts, planted secrets, and its cost on long texts."""

import hashlib
import random
import string
import time

from vanewright.llm import secrets

SF = "/root/testdata/sf0.01"
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def plain_base(text):
    """The base patterns character by character."""
    out, low, i, n = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text), 0, len(text)
    while i < n:
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(word, i):
                continue
            j = i + len(word)
            j += j < n and text[j] in "\"'"
            while j < n and text[j] == " ":
                j += 1
            if not (j < n and text[j] in ":="):
                continue
            j += 1
            while j < n and text[j] == " ":
                j += 1
            j += j < n and text[j] in "\"'"
            k = j
            while k < n and text[k] in VALUE:
                k += 1
            if k > j:
                if k - j >= 12:
                    out.append((i, k, 0))
                i = k - 1
                break
        i += 1
    for first, kinds, least, kind in (("AKIA", set(string.ascii_uppercase + string.digits), 18, 1), ("", set("0123456789abcdef"), 16, 2)):
        i = 0
        while i < n:
            k = i + len(first)
            if text.startswith(first, i):
                while k < n and text[k] in kinds:
                    k += 1
            if text.startswith(first, i) and k > i + len(first):
                if k - i >= least:
                    out.append((i, k, kind))
                i = k
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_query_equals_a_plain_scan(spark):
    got = {r["doc_id"]: r for r in secrets.op8_secret_scan(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    found = 0
    for r in rows:
        base = plain_base(r["text"] or "")
        g, text = got[r["doc_id"]], ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(k == x for _, _, k in base) for x in range(3)]
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(g["spans"].split(","))
        found += len(base)
    assert found > 0


def test_base_on_random_texts():
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "AKIAABCDEFGHIJ0123", "'", '"', " ", ":", "=", "abcdef0123456789", "x" * 11, "y" * 12, "\n", "é", "ß", ".", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert secrets.base_spans(text) == plain_base(text), text


def test_planted_secrets_by_novelty():
    """Random keys in a sensitive context that no base pattern covers, and identifiers in the same places."""
    rng, novelty = random.Random(4), secrets.Novelty()
    alphabet = string.ascii_letters + string.digits
    names = ["connection_manager_configuration", "default_session_timeout_seconds", "request_handler_factory_provider", "application_resource_directory", "database_connection_string_name", "user_account_settings_page"]
    caught = wrong = 0
    n = 200
    for i in range(n):
        key = "".join(rng.choice(alphabet) for _ in range(rng.choice([20, 24, 32, 40])))
        lines = [f"import {rng.choice(names)}", f"auth bearer {key}", f"return {rng.choice(names)}"]
        text = "\n".join(lines)
        spans = [text[a:b] for a, b, _ in secrets.novel_spans(text, plain_base(text), novelty, 0.6, 400)]
        caught += key in spans
        text = "\n".join([lines[0], f"auth bearer {names[i % len(names)]}", lines[2]])
        wrong += bool(secrets.novel_spans(text, plain_base(text), novelty, 0.6, 400))
    assert caught >= 0.98 * n and wrong <= 0.02 * n


def test_long_texts_stay_linear():
    """Base spans and candidates by thousands: none is compared with all others."""

    class Free(secrets.Novelty):
        def cost(self, candidate, around):
            return 0

    took = []
    for n in (4000, 16_000):
        text = "\n".join(f"secret: abcdefghijkl{i:06d} auth zyxwvutsrqponmlkj_{i}" for i in range(n))
        base = secrets.base_spans(text)
        began = time.perf_counter()
        assert len(base) >= n and secrets.novel_spans(text, base, Free(), 0.6, 40) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5
    starts, ends = secrets.disjoint([(0, 5, 0), (3, 9, 2), (9, 12, 1), (20, 21, 0)])
    assert (starts, ends) == ([0, 9, 20], [9, 12, 21])
