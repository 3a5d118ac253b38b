"""Lattices are built once for a word that comes again; what is known changes no sample."""

import numpy as np

from vellum.llm import pieces

TEXTS = [
    "the cat sat on the mat",
    "the dog sat on a naïve ▁ café \n 中文 x",
    "  two  spaces and the cat ",
    "x" * 300 + " the end",
    "plain words that come again and again, the mat",
    "\U0001f600 é the ▁▁mark",
]


def drawn(texts, keys, vocabulary, known=None):
    stretch = pieces.Stretch([np.frombuffer(t.encode(), np.uint8) for t in texts], keys, 3, vocabulary, known)
    found = []
    for i, k in enumerate(keys):
        ids, log, score = pieces.sample(stretch.text(i, k), 3)
        found.append(([pieces.spelt(x, vocabulary).tolist() for x in ids], log.tolist(), score.tolist()))
    return found


def same(got, want):
    for (ids, log, score), (ids_2, log_2, score_2) in zip(got, want, strict=True):
        assert ids == ids_2
        np.testing.assert_allclose(log, log_2, rtol=1e-12)
        np.testing.assert_allclose(score, score_2, rtol=1e-9, atol=1e-12)


def test_a_word_is_built_once():
    vocabulary = pieces.Vocabulary()
    known = pieces.Known(vocabulary)
    keys = list(range(len(TEXTS)))
    want = drawn(TEXTS, keys, vocabulary)
    same(drawn(TEXTS, keys, vocabulary, known), want)
    built = known.words, known.rows, known.arcs
    same(drawn(TEXTS[::-1], keys[::-1], vocabulary, known), want[::-1])
    assert (known.words, known.rows, known.arcs) == built
    for (samples, _, _), text in zip(want, TEXTS, strict=True):
        assert all(pieces.decode(np.array(ids, np.int32), vocabulary).decode() == text for ids in samples)


def test_words_give_way(monkeypatch):
    vocabulary = pieces.Vocabulary()
    keys = list(range(len(TEXTS)))
    want = [drawn([t], [k], vocabulary)[0] for t, k in zip(TEXTS, keys, strict=True)]
    for most in (1, 20, 60, 200):
        monkeypatch.setattr(pieces, "KNOWN", most)
        known, longest = pieces.Known(vocabulary), max(map(len, TEXTS))
        for _ in range(5):
            same([drawn([t], [k], vocabulary, known)[0] for t, k in zip(TEXTS, keys, strict=True)], want)
            assert known.rows <= most + 2 * longest + 2


def test_every_piece_is_found():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.Vocabulary()
    plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    for i in plain:
        at = 0
        for c in model.id_to_piece(i):
            to = int(v.base[at] + v.kind[min(ord(c), len(v.kind) - 1)])
            assert v.parent[to] == at
            at = to
        assert v.id[at] == i and np.isfinite(v.score[at])
    assert np.isfinite(v.score).sum() == len(plain)
