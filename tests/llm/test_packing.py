import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import empty, odd
from vanewright.llm import packing

SF = "/root/testdata/sf0.001"
ENCODER = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "hello", "x", "\n", "<|", "endoftext", "|>", "\0", "."]), max_size=8).map("".join))
def test_added_tokens_have_their_ids(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_generations_of_the_cache():
    small = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), entries=3)
    for text in ("one two three, four", "two five. one", "six seven eight nine ten", "one two, five", "two"):
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids
    assert len(small.cache) + len(small.old) < 20


def test_look_ups_do_not_go_over_the_cache():
    class Held(dict):
        def __iter__(self):
            raise AssertionError("the whole cache was read")

        keys = items = values = __iter__

    encoder = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = encoder.encode(["one two three. four"])
    encoder.cache, encoder.old = Held(encoder.cache), Held(encoder.cache)
    assert encoder.encode(["one two three. four"]) == want and encoder._missing({" two", " five"}) == {" five"}


def test_plain_words_go_to_the_model_and_each_is_looked_up_once():
    class Counted(dict):
        seen = 0

        def get(self, *key):
            self.seen += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.seen += 1
            return super().__getitem__(key)

    encoder = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder._ids = lambda texts: [].index(texts)  # the whole way of the library
    texts = ["Plain words, schöne Wörter;\nand 42 (more)..." + " again and again" * 100] * 3
    want = np.array(PLAIN.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(texts) == [want] * 3
    encoder.cache = Counted(encoder.cache)
    assert encoder.encode(texts) == [want] * 3 and encoder.cache.seen < 20


PARTS = [*" \n\t.,'9#é×ÿȕɏɐßªµ²\x1c\x85\xa0\u2003\u2028\u3000\u1680\x00\u0301٣中\U0001f600", "ab", " the", "  ", "\n\n", "\r\n", "'s", " 'll", "<|endoftext|>", "Ab\nCd", "x.", "!?"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=5), st.sampled_from([1, 12, 4_000_000]))
def test_texts_of_any_characters_equal_the_tokenizer(texts, slice_bytes):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "SLICE_BYTES", slice_bytes)
        got = ENCODER.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_letter_and_symbol_is_cut_as_by_the_tokenizer():
    texts = [f"a{c}b {c} {c}{c} 1{c}.\n{c}" for c in map(chr, range(0x3000)) if c.isprintable() or c.isspace()]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_the_added_token_between_words():
    assert np.frombuffer(ENCODER.encode(["hello <|endoftext|> x"])[0], "<u4").tolist() == [31373, 220, 50256, 2124]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\n\n", "\r\n", "ab", "A.", ".", "9", "9,", "'s", "é", "\t", "!?"]), max_size=10).map("".join))
def test_lines_and_marks_equal_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Z\n\t\r  .,'é\U0001f600\x000 s<|>", max_size=60))
def test_chunks_equal_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    ids = [(r["doc_id"], [*PLAIN.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    rows = packing.pack(docs).collect()
    want = collections.Counter()
    for i, x in ids:
        first = len(x) % 1024 or min(len(x), 1024)
        cuts = [0, *range(first, len(x) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(len(x) for _, x in ids) / 1024) * 1.03 + 1
    assert packing.pack(empty(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_every_length_once(counts):
    used, bins = collections.Counter(), 0
    for pattern, times in packing.best_two_fit(counts, 64):
        assert sum(length * n for length, n in pattern) <= 64 and times > 0
        for length, n in pattern:
            used[length] += n * times
        bins += times
    assert used == collections.Counter(counts)
    total = sum(k * v for k, v in counts.items())
    assert bins <= max(2 * math.ceil(total / 64), 1)
