"""Packing: the tree against a plain first fit, token ids against the tokenizer, each id in exactly one piece."""

import collections
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from vellum.llm import packing

SCHEMA = "doc_id long, text string, start string, ids string, group string"


def plain_first_fit(sizes, capacity):
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(bins))
        if b == len(bins):
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] -= sizes[i]
    return bins


def test_tree_equals_first_fit():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([8, 64, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(120))]
        assert packing.first_fit_decreasing(sizes, capacity) == plain_first_fit(sizes, capacity)


def test_groups_hold_every_token_once_with_little_padding():
    rng = random.Random(6)
    for trial in range(80):
        sizes = [[rng.randint(1, 63) for _ in range(rng.randrange(90))], [40] * rng.randrange(30), [63] * 7, [1], []][trial % 5]
        packed = packing.pack_group(sizes, 64, 4)
        seen = [[0] * n for n in sizes]
        for pieces in packed:
            n = sum(size for _, _, size in pieces)
            assert 0 < n <= 64 and (64 - n < 4 or n & (n - 1) == 0)
            for item, at, size in pieces:
                assert size > 0
                for j in range(at, at + size):
                    seen[item][j] += 1
        assert all(x == 1 for row in seen for x in row)


def test_ids_are_the_tokenizers():
    made, plain = packing.Encoder(), Tokenizer.from_file(packing.TOKENIZER)
    rng = random.Random(7)
    bits = ["word", "word", "été", "日本", "don't", "12", "…", "<|endoftext|>", "\U0001f600", "a.\nB", " ", " ", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é"]
    texts = ["", " ", "  ", "x", " x", "x ", "a  b", "a \n b", "a  b", "word " * 3000, "w" * 5000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(made.encode(text), made.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], text


def test_slices_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    monkeypatch.setattr(packing, "WORDS", 12)
    made, plain = packing.Encoder(), Tokenizer.from_file(packing.TOKENIZER)
    rng = random.Random(8)
    for _ in range(40):
        text = rng.choice(["", " ", "\n"]) + " ".join(rng.choice(["ab", "cde", "f\n", "", "gé", "h" * 9]) + str(rng.randrange(9)) for _ in range(rng.randrange(80)))
        assert np.frombuffer(made.encode(text), made.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_pieces_make_up_the_documents(spark):
    rng = random.Random(9)
    words = ["plain", "words", "of", "a", "text", "été", "longer-words"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 30, 400, 3000, 9000]))) for _ in range(40)]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(100, None, None, None, None), (101, "", None, None, None), (None, "no id", None, None, None), (3, texts[3], None, None, None), (102, "a  b \n c", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(docs).collect()
    plain = Tokenizer.from_file(packing.TOKENIZER)
    sequences, ids = collections.defaultdict(list), collections.Counter()
    for r in got:
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.start + r.length <= r.doc_tokens
    want = collections.Counter()
    for i, t, *_ in rows:
        whole = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, j, x) for j, x in enumerate(whole))
    for r in got:
        ids.update((r.doc_id, r.start + j, x) for j, x in enumerate(np.frombuffer(r.ids, "<u4").tolist()))
    assert ids == want
    padded = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padded += 2048 - at if at & (at - 1) else 0
    assert padded < 0.02 * sum(want.values())
    assert packing.pack(docs.limit(0)).count() == 0


def test_query_digests(spark, tiny):
    got = {(r.doc_id, r.start): r for r in packing.query(spark, tiny).collect()}
    plain = Tokenizer.from_file(packing.TOKENIZER)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert {i for i, _ in got} == set(docs)
    for (i, start), r in got.items():
        whole = np.array([*plain.encode(docs[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[start : start + r.length].tobytes())
