"""Spelling variants: automata over tries against all pairs; counting against a plain count; odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from vellum.llm import spelling


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("states", [3, 1 << 18])
def test_neighbours_equal_all_pairs(monkeypatch, states):
    monkeypatch.setattr(spelling, "STATES", states)
    rng = random.Random(states)
    for trial in range(60):
        letters = "abzàéÿ"[: rng.choice([2, 3, 6])]
        make = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))).encode("latin-1")  # noqa: B023, E731
        words = list({make() for _ in range(rng.randrange(1, 60))} | ({b"a" * 60, b"a" * 61, b"a" * 59 + b"b", b"b" + b"a" * 60} if trial % 6 == 0 else set()))
        asked = words + [make() for _ in range(10)]
        trie = spelling.Trie.unpack(spelling.Trie.of(words, [1] * len(words)).pack())
        q, w = spelling.neighbours(spelling.Words(asked), trie)
        assert sorted((asked[i], trie.word(j)) for i, j in zip(q, w)) == sorted((a, b) for a in asked for b in words if one_apart(a, b))


def plain(rows, odds):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % odds == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: min(x, key=lambda v: (-n[v], v)) if (x := near[w]) else None for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n[w], len(near[w]), form[w] or "", form[w] and n[form[w]] or 0, root(w)) for w in n)


def digest(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_groups_equal_plain(spark, monkeypatch, small):
    if small:  # many shards in many blocks
        monkeypatch.setattr(spelling, "SHARD", 20)
        monkeypatch.setattr(spelling, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(spelling.sized, "__defaults__", (3,))
    rng = random.Random(11)
    stems = ["letter", "Écriture", "naïve", "straße", "colour", "abcde", "x" * 70, "short"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "e", "É"]) + w[at + rng.randrange(2) :]
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "日", "1"]).join(words)))
    rows += [(None, rows[0][1]), (None, rows[0][1]), (5, rows[5][1]), (500, None), (501, ""), (502, "a b c")]
    docs = spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows], "doc_id long, text string, n int, word string, form string")
    assert digest(spelling.group_variants(docs, odds=7)) == plain(rows, 7)


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two three")], "doc_id long, text string")
    assert spelling.group_variants(docs).count() == 0
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_long_chain_of_forms(spark):
    chain = ["aaaaaaaa"[: 8 - i] + "b" * i for i in range(8)]
    rows = [(1, " ".join(" ".join([w] * (3 << i)) for i, w in enumerate(chain)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = digest(spelling.group_variants(docs, odds=1 << 40))
    assert found == plain(rows, 1 << 40) and {r[5] for r in found} == {chain[-1]}
