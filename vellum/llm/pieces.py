"""SentencePiece encoding and decoding with distinct sampled segmentations.

A text's lattice has an arc for every vocabulary piece at every place. Segmentations
are drawn without replacement by Gumbel top-k: an A* search over sets of paths, each
ranked by its perturbed log-probability, which is exact as the greatest of a Gumbel
per path, so the leaves come out in falling order. Pieces never cross the start of a
run of spaces, so the lattice is a chain of one small lattice per word: a word's
segmentations are drawn backwards from forward sums, and a node of the search is a
prefix of words with the segmentations of the next word that no leaf has used.
Every random number is a hash of the row's key, the place and the draw; a result
depends neither on the batch nor on the task.

A unigram model's scores are log-probabilities. A BPE model has merge ranks only;
its pieces take the log-probability of their rank under Zipf's law.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import documents, lean, small_batches
from vellum.llm.textbytes import U, mix, raw

#: The tokenizer's file; a parameter of every function that reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations drawn for each text.
SAMPLES = 2
#: Code points whose words are drawn together.
SLICE = 1 << 17
#: Places of lattices that a task keeps for later words.
KNOWN = 1 << 19
SPACE = 0x2581
#: Stands for the space mark where a text has it itself; beyond Unicode, so no piece holds it and it is spelt in bytes.
MARK = 0x110000
_BASE = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Vocabulary:
    """Pieces of a model, looked up in a trie; small enough to go with each task (its size is the tokenizer's)."""

    def __init__(self, path: str = MODEL, smooth: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        score = np.array([model.get_score(i) for i in plain])
        if len(score) and np.all(score == np.round(score)):  # merge ranks
            score = -np.log1p(-score - score.max() * -1) - np.log(np.log(len(score)) + 0.5772)
        self.text = [model.id_to_piece(i).encode() for i in range(n)]
        self.bytes = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[value], self.text[i] = i, bytes([value])
        self.plain = pa.array([t.replace("▁".encode(), b" ") for t in self.text], pa.binary())
        self.longest = max(len(model.id_to_piece(i)) for i in plain)
        self.unknown = float(score.min() - 10) * smooth
        # a trie of the pieces in two arrays: from a node, a code point of kind c leads to node base + c if its parent says so
        names = [model.id_to_piece(i) for i in plain]
        often = Counter(c for name in names for c in name)
        kind = {c: k for k, (c, _) in enumerate(often.most_common(), 1)}  # frequent ones first, so that nodes lie close
        self.kind = np.zeros(max(map(ord, kind), default=0) + 2, np.int32)  # the last is for all beyond
        self.kind[[ord(c) for c in kind]] = list(kind.values())
        below: dict[str, list[str]] = {}
        for prefix in {name[:j] for name in names for j in range(1, len(name) + 1)}:
            below.setdefault(prefix[:-1], []).append(prefix)
        node, base, taken = {"": 0}, {}, bytearray(b"\1") + bytes(2 * sum(map(len, below.values())) + 2 * len(kind))
        free, crowded = 1, True
        for parent, longer in sorted(below.items(), key=lambda x: (-len(x[1]), x[0])):
            codes = sorted(kind[prefix[-1]] for prefix in longer)
            if len(codes) == 1 and crowded:  # single ones fill the gaps
                free, crowded = 1, False
            at, tries = max(free, codes[0]), 0
            while (at := taken.find(0, at)) >= 0 and any(taken[at + c - codes[0] : at + c - codes[0] + 1] == b"\1" for c in codes[1:]):
                at, tries = at + 1, tries + 1
            if at < 0:
                at = len(taken)
            taken.extend(bytes(max(0, at + codes[-1] - codes[0] + 1 - len(taken))))
            if tries > 16 or (len(codes) == 1 and codes[0] <= free):
                free = at
            base[parent] = at - codes[0]
            for prefix in longer:
                node[prefix] = base[parent] + kind[prefix[-1]]
                taken[node[prefix]] = 1
        n = max(node.values()) + len(kind) + 2
        self.base, self.parent = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        self.id, self.score, self.longer = np.zeros(n, np.int32), np.full(n, -np.inf, np.float32), np.zeros(n, bool)
        for prefix, x in base.items():
            self.base[node[prefix]] = x
            self.longer[node[prefix]] = bool(prefix)
            self.parent[[node[longer] for longer in below[prefix]]] = node[prefix]
        for name, i, x in zip(names, plain, score.tolist(), strict=True):
            self.id[node[name]], self.score[node[name]] = i, x * smooth


_UP, _DOWN = _powers(_BASE, SLICE + 1), _powers(pow(_BASE, -1, 1 << 64), SLICE + 1)


class Known:
    """Lattices of the words met so far, each built once; beyond KNOWN places the words met least give way.

    A word's lattice depends on the word alone, so what is known changes no result.
    A row is a place 0..size of a word: ``owner`` has its word's number, ``last`` the last
    of the arcs that end there; these follow those of the row before, by length. ``top``
    has a word's row at its end. ``begin`` has an arc's row at its start, -1 at its word's
    start, ``lower`` the share of a row's arcs before the arc, ``share`` the log of its own.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.name, self.number = np.zeros(0, U), np.zeros(0, np.int64)  # sorted hashes and whose they are
        self.words = self.rows = self.arcs = 0
        self.top, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.owner, self.last = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.share, self.lower = np.zeros(0), np.zeros(0, np.float32)
        self.piece, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, points: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Numbers of the words that begin at ``edge`` (the last is the end) in ``points``; those not known are built."""
        if self.rows > KNOWN:
            self._thin()
        n = len(points)
        up, down = (_UP, _DOWN) if n <= SLICE else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
        sums = np.zeros(n + 1, U)
        np.cumsum(points.astype(U) * up[:n], out=sums[1:])
        size = np.diff(edge)
        name = mix((sums[edge[1:]] - sums[edge[:-1]]) * down[edge[:-1]] + size.astype(U))
        name, one, word = np.unique(name, return_index=True, return_inverse=True)
        at = np.searchsorted(self.name, name)
        number = np.full(len(name), -1)
        if self.words:
            near = np.minimum(at, self.words - 1)
            number = np.where(self.name[near] == name, self.number[near], -1)
        new = np.flatnonzero(number < 0)
        if len(new):
            new = new[np.argsort(-size[one[new]], kind="stable")]  # longer words first
            number[new] = self.words + np.arange(len(new))
            self._build(points, edge[one[new]], size[one[new]])
            new.sort()
            self.name, self.number = np.insert(self.name, at[new], name[new]), np.insert(self.number, at[new], number[new])
        self.met[number] += 1
        return number[word]

    def _build(self, points: np.ndarray, edge: np.ndarray, size: np.ndarray) -> None:
        """Add the lattices of the words of ``size`` at ``edge``, the longest first."""
        v = self.vocabulary
        # rows: place 0 of each word, place 1 of each word that has it, ...
        count = np.searchsorted(-size, -np.arange(size[0] + 1), "right")
        first = np.concatenate(([0], np.cumsum(count)))
        rows = int(first[-1])
        place = np.repeat(np.arange(size[0] + 1), count)
        word = np.arange(rows) - first[place]
        after = np.arange(rows) + count[place]  # row of the word's next place
        r = np.flatnonzero(place < size[word])
        point = points[edge[word[r]] + place[r]].astype(np.int32)
        code = np.zeros(rows, np.int32)  # 0 at a word's end
        code[r] = v.kind[np.minimum(point, len(v.kind) - 1)]
        # arcs: every piece at every place, and the spelling in bytes of a code point that is no piece
        at = v.base[0] + code[r]
        at = np.where(v.parent[at] == 0, at, 0)
        end, value, name_of = after[r], v.score[at], v.id[at]
        missing = np.flatnonzero(~np.isfinite(value))
        point = point[missing]
        value[missing], name_of[missing] = v.unknown, np.where(point < 128, v.bytes[np.minimum(point, 127)], -point - 1)
        arcs = [(r, end, value, name_of)]
        held = np.zeros(rows + 1, np.int64)
        held[end + 1] = 1
        while True:
            on = np.flatnonzero(v.longer[at])  # where a longer piece may follow
            r, end, at = r[on], end[on], at[on]
            to = v.base[at] + code[end]
            on = np.flatnonzero(v.parent[to] == at)
            if not len(on):
                break
            r, at, end = r[on], to[on], after[end[on]]
            value = v.score[at]
            hit = np.flatnonzero(np.isfinite(value))
            arcs.append((r[hit], end[hit], value[hit], v.id[at[hit]]))
            held[arcs[-1][1] + 1] += 1  # a row has one arc of a length at most
        # by the row where they end and by length
        held = np.cumsum(held)
        stop, total = held[1:].copy(), int(held[-1])
        begin, value, piece = np.empty(total, np.int32), np.empty(total, np.float32), np.empty(total, np.int32)
        for r, end, x, i in arcs:
            to = held[end]
            held[end] += 1
            begin[to], value[to], piece[to] = r, x, i
        forward = np.zeros(rows)
        share, lower = np.empty(total), np.empty(total, np.float32)
        for a, b in zip(first[1:-1].tolist(), first[2:].tolist(), strict=True):  # rows at equal distance from their words' starts
            low, high = int(stop[a - 1]), int(stop[b - 1])
            group = stop[a - 1 : b - 1] - low
            count = np.diff(group, append=high - low)
            w = forward[begin[low:high]] + value[low:high]
            top = np.maximum.reduceat(w, group)
            p = np.exp(w - np.repeat(top, count))
            whole = np.add.reduceat(p, group)
            log = top + np.log(whole)
            forward[a:b] = log
            running = np.cumsum(p)
            upper = (running - np.repeat(running[group] - p[group], count)) / np.repeat(whole, count)
            lower[low + 1 : high] = upper[:-1]
            lower[low + group] = 0
            share[low:high] = w - np.repeat(log, count)
        words, new_rows, new_arcs = self.words + len(size), self.rows + rows, self.arcs + total
        self.top, self.met = (_room(x, self.words, words) for x in (self.top, self.met))
        self.owner, self.last = (_room(x, self.rows, new_rows) for x in (self.owner, self.last))
        self.share, self.lower, self.piece, self.begin = (_room(x, self.arcs, new_arcs) for x in (self.share, self.lower, self.piece, self.begin))
        self.top[self.words : words], self.met[self.words : words] = first[size] + np.arange(len(size)) + self.rows, 0
        self.owner[self.rows : new_rows], self.last[self.rows : new_rows] = word + self.words, stop + (self.arcs - 1)
        own = slice(self.arcs, new_arcs)
        self.share[own], self.lower[own], self.piece[own], self.begin[own] = share, lower, piece, np.where(begin < len(size), -1, begin + self.rows)
        self.words, self.rows, self.arcs = words, new_rows, new_arcs

    def _thin(self) -> None:
        """Keep the words met most, up to half of KNOWN places; arrays that were handed out stay as they are."""
        owner, met = self.owner[: self.rows], self.met[: self.words]
        order = np.argsort(-met, kind="stable")
        keep = np.sort(order[np.cumsum(np.bincount(owner, minlength=self.words)[order]) <= KNOWN // 2])
        new = np.full(self.words, -1)
        new[keep] = np.arange(len(keep))
        number = new[self.number]
        self.name, self.number = self.name[number >= 0], number[number >= 0]
        stay = new[owner] >= 0
        row, arcs = np.cumsum(stay) - 1, np.diff(self.last[: self.rows], prepend=-1)
        self.top, self.met = row[self.top[keep]], met[keep] // 2
        self.owner, self.last = new[owner[stay]].astype(np.int32), (np.cumsum(arcs[stay]) - 1).astype(np.int32)
        on = np.flatnonzero(np.repeat(stay, arcs))
        self.share, self.lower, self.piece, begin = self.share[on], self.lower[on], self.piece[on], self.begin[on]
        self.begin = np.where(begin < 0, -1, row[begin]).astype(np.int32)
        self.words, self.rows, self.arcs = len(keep), len(self.owner), len(on)


def _room(array: np.ndarray, used: int, size: int) -> np.ndarray:
    """The array, or a longer one with what is used of it."""
    if size <= len(array):
        return array
    out = np.empty(max(size, len(array) * 3 // 2), array.dtype)
    out[:used] = array[:used]
    return out


class Words:
    """The words of a stretch of code points with their lattices, to draw from them.

    ``points`` holds whole words; ``edge`` their starts and the end.
    """

    def __init__(self, points: np.ndarray, edge: np.ndarray, known: Known):
        self.word = known.find(points, edge)
        self.top, self.last = known.top, known.last
        self.share, self.lower, self.piece, self.begin = known.share, known.lower, known.piece, known.begin

    def draw(self, which: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation for each of the words ``which``: pieces of all in order, pieces of each, log-probability of each."""
        at = self.top[self.word[which]]
        live, sum_of = np.arange(len(which)), np.zeros(len(which))
        log, count = np.empty(len(which)), np.empty(len(which), np.int64)
        owner, found, step = [], [], 0
        while len(live):
            x = (seed + U(0xD1B54A32D192ED03 * (step + 1) & FULL)) * U(0xBF58476D1CE4E5B9)  # seeds are mixed already
            u = (((x ^ (x >> U(32))) * U(0x94D049BB133111EB)) >> U(40)).astype(np.float32) * np.float32(2.0**-24)
            arc = self.last[at].astype(np.int64)  # from the longest piece, which is often the likeliest
            on = np.flatnonzero(self.lower[arc] > u)
            while len(on):
                arc[on] -= 1
                on = on[self.lower[arc[on]] > u[on]]
            sum_of = sum_of + self.share[arc]
            owner.append(live)
            found.append(self.piece[arc])
            at = self.begin[arc]
            step += 1
            more = at >= 0
            done = np.flatnonzero(~more)
            if len(done):
                log[live[done]], count[live[done]] = sum_of[done], step
                more = np.flatnonzero(more)
                live, seed, at, sum_of = live[more], seed[more], at[more], sum_of[more]
        end = np.cumsum(count)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.int32)
        for k, (live, ids) in enumerate(zip(owner, found, strict=True)):
            out[end[live] - 1 - k] = ids
        return out, count, np.minimum(log, 0.0)

    def outside(self, which: int, used: set[tuple[int, ...]], seed: int) -> tuple[tuple[int, ...], float] | None:
        """A segmentation of one word given that it is none of ``used``, drawn backwards: an arc's share is less by that of the used paths through it."""
        at, log, found, step = int(self.top[self.word[which]]), 0.0, [], 0
        paths = [self._shares(at, u) for u in used]
        while at >= 0:
            arcs = range(int(self.last[at - 1]) + 1, int(self.last[at]) + 1)
            weight = []
            for j in arcs:
                through = sum(rest[step] for ids, rest in paths if step < len(ids) and ids[step] == self.piece[j])
                weight.append(max(0.0, float(np.exp(self.share[j])) - through))
            total = sum(weight)
            if total <= 0.0:
                return None
            seed = (seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & FULL
            u, pick = _unit(seed) * total, 0
            while pick + 1 < len(weight) and (u >= weight[pick] or not weight[pick]):
                u, pick = u - weight[pick], pick + 1
            j = arcs[pick]
            found.append(int(self.piece[j]))
            log += float(self.share[j])
            at = int(self.begin[j])
            paths = [(ids, rest) for ids, rest in paths if step < len(ids) and ids[step] == found[-1]]
            step += 1
        out = tuple(reversed(found))
        return None if out in used else (out, min(log, 0.0))

    def _shares(self, at: int, ids: tuple[int, ...]) -> tuple[list[int], list[float]]:
        """A path's pieces from the end, and for each step its probability from there on."""
        back, logs = list(reversed(ids)), []
        for i in back:
            j = next(j for j in range(int(self.last[at - 1]) + 1, int(self.last[at]) + 1) if self.piece[j] == i)
            logs.append(float(self.share[j]))
            at = int(self.begin[j])
        return back, np.exp(np.cumsum(logs[::-1])[::-1]).tolist()


def _unit(seed: int) -> float:
    x = (seed ^ (seed >> 32)) * 0xBF58476D1CE4E5B9 & FULL
    return ((x ^ (x >> 29)) >> 11) * 2.0**-53


def _exponential(base: np.ndarray, path: int, turn: int) -> np.ndarray:
    u = (seeded(base, 7_000_000 + path * 1000 + turn) >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    return -np.log(u)


def _other_share(log: np.ndarray) -> np.ndarray:
    """Log of the share that a segmentation leaves to a word's others; so close to 1, rounding leaves nothing."""
    rest = -np.expm1(log)
    with np.errstate(divide="ignore"):
        return np.log(np.where(rest < 1e-13, 0.0, rest))


def _below(location, bound: float, e):
    """A Gumbel at ``location`` given that it is at most ``bound``; ``e`` is exponential."""
    with np.errstate(over="ignore"):
        return location - np.log(np.exp(location - bound) + e)


class Stretch:
    """The words of several texts with one draw of them for each sample.

    Lattices are shared by equal words, also of other stretches with the same ``known``. Numbers are seeded by the
    text's key and the word's place in it, so they are the same in any stretch.
    """

    def __init__(self, texts: list[np.ndarray], keys: list[int], samples: int, vocabulary: Vocabulary, known: Known | None = None):
        """``texts`` are UTF-8 bytes, none of them empty; equals normalising and splitting each on its own."""
        known = known or Known(vocabulary)
        plain, start = normalised(texts)
        fresh = np.zeros(len(plain), bool)
        fresh[1:] = (plain[1:] == SPACE) & (plain[:-1] != SPACE)  # a word begins with a run of spaces
        fresh[start] = True
        edge = np.append(np.flatnonzero(fresh), len(plain))
        self.first = np.append(np.searchsorted(edge, start), len(edge) - 1)
        sizes = np.diff(self.first)
        points = plain
        inner = np.arange(len(edge) - 1) - np.repeat(self.first[:-1], sizes)
        self.base = mix(np.repeat(np.array([k & FULL for k in keys], U), sizes) + inner.astype(U) * U(0xA24BAED4963EE407))
        self.parts: list[tuple[Words, int]] = []
        draws: list[list] = [[] for _ in range(samples)]
        at = 0
        while at < len(edge) - 1:
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + SLICE, "right")) - 1)
            words = Words(points[edge[at] : edge[to]], edge[at : to + 1] - edge[at], known)
            self.parts.append((words, at))
            for d in range(samples):
                draws[d].append(words.draw(np.arange(to - at), seeded(self.base[at:to], d)))
            at = to
        self.draws = []
        for parts in draws:
            ids, count, log = (np.concatenate([p[j] for p in parts]) for j in range(3))
            self.draws.append((ids, count, log, np.concatenate(([0], np.cumsum(count)))))
        # the first leaf of every text: its perturbed log-probability and the nodes beside it
        log = self.draws[0][2]
        total = np.concatenate(([0.0], np.cumsum(log)))
        self.before = total[:-1] - np.repeat(total[self.first[:-1]], sizes)
        u = (mix(mix(np.array([k & FULL for k in keys], U)) + U(_BASE)) >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        self.root = -np.log(-np.log(u))
        self.value = _below(self.before + _other_share(log), np.repeat(self.root, sizes), _exponential(self.base, 0, 0))

    def text(self, i: int, key: int) -> Drawn:
        a, b = int(self.first[i]), int(self.first[i + 1])
        return Drawn(self, key, a, b, [(ids[end[a] : end[b]], count[a:b], log[a:b]) for ids, count, log, end in self.draws])


def seeded(base: np.ndarray, draw: int) -> np.ndarray:
    return mix(base + U(_BASE * (draw + 1) & FULL))


class Drawn:
    """A text's part of a stretch."""

    def __init__(self, stretch: Stretch, key: int, start: int, stop: int, draws: list):
        self.stretch, self.key, self.start, self.n, self.draws = stretch, key, start, stop - start, draws
        self.base = stretch.base[start:stop]

    def other(self, word: int, used: set[tuple[int, ...]], draw: int) -> tuple[tuple[int, ...], float] | None:
        """A segmentation of one word, drawn from those that are not among ``used``; null if rounding leaves none."""
        words, first = next((w, f) for w, f in reversed(self.stretch.parts) if f <= self.start + word)
        base = int(self.base[word]) + draw * 0x8CB92BA72F3D8DD7
        return words.outside(int(self.start + word - first), used, base)


def sample(drawn: Drawn, samples: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct segmentations in falling order of their perturbed log-probabilities: pieces, log-probabilities, log inclusion scores.

    A score is the log of the chance that the segmentation's own Gumbel exceeds the
    first one left out; it is 0 for all if none is left out.
    """
    n = drawn.n
    ids, count, log = drawn.draws[0]
    own = slice(drawn.start, drawn.start + n)
    paths: list[dict] = [{"ids": ids, "count": count, "log": log, "value": drawn.stretch.value[own].copy(), "before": drawn.stretch.before[own], "used": {}, "total": float(log.sum())}]

    def leaf(ids, count, log, start: int, bound: float) -> None:
        """A further leaf; the nodes beside it begin at its word ``start``."""
        before = np.cumsum(log) - log
        value = np.full(n, -np.inf)
        value[start:] = _below(before[start:] + _other_share(log[start:]), bound, _exponential(drawn.base[start:], len(paths), 0))
        paths.append({"ids": ids, "count": count, "log": log, "value": value, "before": before, "used": {}, "total": float(log.sum())})

    while len(paths) < samples and n:
        best = [int(np.argmax(p["value"])) for p in paths]
        k = int(np.argmax([p["value"][i] for p, i in zip(paths, best, strict=True)]))
        path, i = paths[k], best[k]
        bound = float(path["value"][i])
        if np.isneginf(bound):
            break
        end = np.cumsum(path["count"])
        a, b = int(end[i] - path["count"][i]), int(end[i])
        used = path["used"].setdefault(i, {tuple(path["ids"][a:b].tolist()): float(path["log"][i])})
        new_ids, new_count, new_log = drawn.draws[len(paths)]
        head, tail = int(new_count[:i].sum()), int(new_count[: i + 1].sum())
        other, other_log = tuple(new_ids[head:tail].tolist()), float(new_log[i])  # the draw's own segmentation, if it is new
        if other in used:
            drawn_other = drawn.other(i, set(used), len(paths))
            if drawn_other is None:  # rounding: nothing is left there
                path["value"][i] = -np.inf
                continue
            other, other_log = drawn_other
        used[other] = other_log
        left = 1 - sum(np.exp(x) for x in used.values())
        where = path["before"][i] + (np.log(left) if left > 1e-13 else -np.inf)
        path["value"][i] = _below(np.float64(where), bound, _exponential(drawn.base[i : i + 1], k, len(used))[0])
        leaf(
            np.concatenate((path["ids"][:a], np.array(other, np.int32), new_ids[tail:])),
            np.concatenate((path["count"][:i], [len(other)], new_count[i + 1 :])),
            np.concatenate((path["log"][:i], [other_log], new_log[i + 1 :])),
            i + 1,
            bound,
        )
    threshold = max((float(p["value"].max()) for p in paths if n), default=-np.inf)
    total = np.array([p["total"] for p in paths])
    if np.isneginf(threshold):
        score = np.zeros(len(paths))
    else:
        with np.errstate(over="ignore", divide="ignore"):
            x = np.exp(np.minimum(total - threshold, 40.0))
            score = np.where(x > 1e-8, np.log(-np.expm1(-x)), total - threshold)
    return [p["ids"] for p in paths], total, score


def normalised(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, each with the leading space and the space mark (a mark of the text's own as MARK), and where each begins."""
    data = np.concatenate(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.cumsum([0] + [len(t) for t in texts[:-1]])
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    if heads[-1] != len(points):  # not UTF-8: first replace what cannot be decoded
        return normalised([np.frombuffer(t.tobytes().decode("utf-8", "replace").encode(), np.uint8) for t in texts])
    heads = heads[begins]
    start = heads + np.arange(len(texts))
    out = np.empty(len(points) + len(texts), np.uint32)
    body = np.ones(len(out), bool)
    body[start] = False
    out[start] = SPACE
    out[body] = np.where(points == 32, SPACE, np.where(points == SPACE, MARK, points))
    return out, start


def spelt(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Final ids: code points that are no piece become byte pieces."""
    if not len(ids) or ids.min() >= 0:
        return ids
    bare = ids < 0
    points = -ids[bare] - 1
    points[points == MARK] = SPACE
    size = np.ones(len(ids), np.int64)
    size[bare] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    out = np.repeat(ids, size)
    out[np.repeat(bare, size)] = vocabulary.bytes[np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
    return out


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The text of final ids, without the leading space."""
    _, offsets, data = vocabulary.plain.take(pa.array(ids)).buffers()
    return data.to_pybytes()[1 : np.frombuffer(offsets, np.int32)[len(ids)]] if len(ids) else b""


SAMPLE = "array<struct<ids:array<int>,log_p:double,log_inclusion:double>>"


def encode(docs: DataFrame, key: str = "doc_id", samples: int = SAMPLES, path: str = MODEL, smooth: float = 1.0) -> DataFrame:
    """Add to doc_id the ``samples`` of each text: distinct segmentations with their log-probability and log inclusion score.

    A null or empty text has one sample without pieces. A text with fewer
    segmentations has them all, each of inclusion 1 (but for those whose share of a
    word is below rounding, 1e-13). Rows of equal key and text get
    equal samples; a null key counts as 0. Every text is got back by ``decode``, also
    one that holds the space mark U+2581, which is spelt in bytes. Texts of any length
    are read whole. An empty table gives an empty result. Other columns are ignored.
    """
    vocabulary = Vocabulary(path, smooth)
    id_type = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_p", pa.float64()), ("log_inclusion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(vocabulary)
        for batch in batches:
            found = [[{"ids": ids, "log_p": p, "log_inclusion": s} for ids, p, s, _ in own] for own in _samples(batch, samples, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "samples"])

    return docs.select(key, "text", _key(key)).mapInArrow(lean(run), f"{key} {id_type}, samples {SAMPLE}")


def _key(key: str):
    return F.coalesce(F.xxhash64(key), F.lit(0)).alias("row_key")


def _samples(batch: pa.RecordBatch, samples: int, known: Known) -> Iterator[list[tuple[np.ndarray, float, float, np.ndarray]]]:
    """Of each row of (id, text, row_key): ids, log-probability, log inclusion score, bytes of the text."""
    data, at = raw(batch.column(1))
    keys = batch.column(2).to_pylist()
    i = 0
    while i < len(keys):
        to = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)  # rows whose words are drawn together
        own = [data[at[j] : at[j + 1]] for j in range(i, to)]
        full = [j for j, text in enumerate(own) if len(text)]
        stretch = Stretch([own[j] for j in full], [keys[i + j] for j in full], samples, known.vocabulary, known) if full else None
        place = dict(zip(full, range(len(full)), strict=True))
        for j, text in enumerate(own):
            if j not in place:
                yield [(np.zeros(0, np.int32), 0.0, 0.0, text)]
                continue
            ids, total, score = sample(stretch.text(place[j], keys[i + j]), samples)
            yield [(spelt(x, known.vocabulary), float(p), float(s), text) for x, p, s in zip(ids, total, score, strict=True)]
        i = to


def encoded(docs: DataFrame, samples: int = SAMPLES, path: str = MODEL, smooth: float = 1.0) -> DataFrame:
    """Each row's samples, decoded again: doc_id, n_samples, for each of them n_pieces, ids_sha256, log_p and log_inclusion, then distinct and round_trip, and the ids of each as little-endian 32-bit numbers."""
    vocabulary = Vocabulary(path, smooth)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(vocabulary)
        for batch in batches:
            rows = []
            for own in _samples(batch, samples, known):
                data = [ids.astype("<i4", copy=False).tobytes() for ids, _, _, _ in own]
                rows.append((len(own), [len(ids) for ids, _, _, _ in own], [hashlib.sha256(x).hexdigest() for x in data], [p for _, p, _, _ in own], [s for _, _, s, _ in own], len(set(data)) == len(own), all(decode(ids, vocabulary) == bytes(text) for ids, _, _, text in own), data))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_(), pa.bool_(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_samples", "n_pieces", "ids_sha256", "log_p", "log_inclusion", "distinct", "round_trip", "ids"])

    return docs.select("doc_id", "text", _key("doc_id")).mapInArrow(lean(run), f"doc_id {id_type}, n_samples int, n_pieces array<long>, ids_sha256 array<string>, log_p array<double>, log_inclusion array<double>, distinct boolean, round_trip boolean, ids array<binary>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))
