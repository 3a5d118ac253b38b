"""Grouping of spelling variants with Levenshtein automata over trie shards.

The words of a corpus are counted, and the dictionary is cut into shards of neighbouring
words, each a compact trie, which are broadcast in blocks of bounded size. A word's
automaton of distance one runs over a trie depth-first, for many words at once: a state is
a node with the places of the word that the automaton may stand at there, and a
branch is left as soon as there are none. A word's accepting neighbours are counted where
they are found, and only their number and the best of them is passed on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import documents, lean, materialize, sized, small_batches
from vellum.llm.textbytes import raw

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A letter of a word is dropped where the hash of its document and the word is a multiple of this.
ODDS = 97
#: Words, and their bytes, of a trie shard; bytes of the shards that are broadcast at a time.
SHARD, SHARD_BYTES, BLOCK_BYTES = 1 << 18, 1 << 24, 1 << 26
#: Words whose automata run together, and states that are followed together.
QUERIES, STATES = 4096, 1 << 18
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
#: Code points of a text that are read at a time, as far as a word ends there.
SLICE = 1 << 20
#: Longer words are compared one by one.
WIDE = 48

_WORD = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_GAP = re.compile("[^a-zÀ-ÿ]")


def _count(odds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id as text, text) -> words with their number of occurrences."""
        held: Counter = Counter()

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            data, at = raw(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                text = data[at[i] : at[i + 1]].tobytes().lower().decode()  # of bytes, so only A-Z change
                start = zlib.crc32(f"{name or ''}:".encode())
                begin = 0
                while begin < len(text):
                    gap = _GAP.search(text, begin + SLICE) if len(text) - begin > SLICE else None
                    end = gap.start() if gap else len(text)
                    for word, n in Counter(_WORD.findall(text, begin, end)).items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % odds:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < LEAST_LETTERS:
                                continue
                        held[word] += n
                    begin = end
                    if len(held) > HELD:
                        yield table()
                        held.clear()
        yield table()

    return run


def _labels() -> np.ndarray:
    """A number below 90 for each letter; 127, which no node has, for the end of a word."""
    code = np.full(256, 127, np.uint8)
    code[0x61:0x7B] = np.arange(26)
    code[0xC0:] = 26 + np.arange(64)
    return code


_LABEL = _labels()


class Trie:
    """A trie over sorted words of Latin-1 letters; a branch with one word left ends there.

    Nodes are numbered level by level, so the children of a node stand together; ``mask``
    has a bit for each label that a node has a child for, and the number of lower bits
    is a child's place among them.
    """

    FIELDS = ("letters", "at", "n", "first", "mask", "label", "ends", "only")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.children = np.bitwise_count(self.mask).sum(axis=1).astype(np.int64)

    @classmethod
    def of(cls, words: list[bytes], n: list[int]) -> Trie:
        order = sorted(range(len(words)), key=words.__getitem__)
        size = np.array([len(words[i]) for i in order], np.int64)
        letters = np.frombuffer(b"".join([words[i] for i in order]) + b"\0", np.uint8)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        first, masks, labels, ends, only = [], [], [np.zeros(1, np.uint8)], [], []
        # the words below the nodes of this level, and whose node each is
        word, node, nodes, made, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 1, 1, 0
        while nodes:
            own = np.bincount(node, minlength=nodes)
            lone = own == 1
            single, end, start, mask = np.full(nodes, -1, np.int32), np.full(nodes, -1, np.int32), np.zeros(nodes, np.int64), np.zeros((nodes, 2), np.uint64)
            alone = lone[node]
            single[node[alone]] = word[alone]
            word, node = word[~alone], node[~alone]
            stops = size[word] == depth
            end[node[stops]] = word[stops]
            word, node = word[~stops], node[~stops]
            label = _LABEL[letters[at[word] + depth]]
            new = np.ones(len(word), bool)
            new[1:] = (node[1:] != node[:-1]) | (label[1:] != label[:-1])
            parent, child = node[new], label[new]
            np.bitwise_or.at(mask, (parent, child >> 6), np.uint64(1) << (child & 63).astype(np.uint64))
            count = np.bincount(parent, minlength=nodes)
            start[:] = made + np.cumsum(count) - count
            first.append(start)
            masks.append(mask)
            ends.append(end)
            only.append(single)
            labels.append(child)
            node, nodes, depth = np.cumsum(new) - 1, len(parent), depth + 1
            made += nodes
        return cls(letters=letters, at=at, n=np.array([n[i] for i in order], np.int64), first=np.concatenate(first).astype(np.int32), mask=np.concatenate(masks), label=np.concatenate(labels), ends=np.concatenate(ends), only=np.concatenate(only))

    def child(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node for a label, or -1."""
        high = label >> 6
        bit = np.uint64(1) << (label & 63).astype(np.uint64)
        mask = self.mask[node, np.minimum(high, 1)]
        place = self.first[node] + np.bitwise_count(mask & (bit - np.uint64(1))) + np.where(high == 1, np.bitwise_count(self.mask[node, 0]), 0)
        return np.where(mask & bit, place, -1)

    def word(self, i: int) -> bytes:
        return self.letters[self.at[i] : self.at[i + 1]].tobytes()

    def pack(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Trie:
        import io

        with np.load(io.BytesIO(data)) as arrays:
            return cls(**{name: arrays[name] for name in cls.FIELDS})


class Words:
    """Query words, with labels that can be read some places beyond either end."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(self.size + 1, out=self.at[1:])
        self.at += 1
        self.letters = np.frombuffer(b"\0" + b"\0".join(words) + b"\0\0\0", np.uint8)
        self.labels = _LABEL[self.letters]

    def label(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The label at a place; the end's where there is no letter."""
        return self.labels[np.minimum(self.at[word] + np.minimum(place, self.size[word]), len(self.labels) - 1)]


# what a state may hold at depth d: no edit so far and d letters read, or one edit and d - 1, d, or d + 1 read
EXACT, LESS, EVEN, MORE = 1, 2, 4, 8


def _one_apart(words: Words, q: np.ndarray, trie: Trie, w: np.ndarray) -> np.ndarray:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    a, b = words.size[q], trie.at[w + 1] - trie.at[w]
    out = np.zeros(len(q), bool)
    wide = (a > WIDE) | (b > WIDE)
    for i in np.flatnonzero(wide & (np.abs(a - b) < 2)):
        x, y = sorted((words.words[q[i]], trie.word(w[i])), key=len)
        j = next((j for j in range(len(x)) if x[j] != y[j]), len(x))
        out[i] = x != y and x[j + (len(x) == len(y)) :] == y[j + 1 :]
    rows = np.flatnonzero(~wide & (np.abs(a - b) < 2))
    if not len(rows):
        return out
    q, w, a, b = q[rows], w[rows], a[rows], b[rows]
    place = np.arange(max(a.max(), b.max()) + 1)
    left = np.where(place < a[:, None], words.letters[np.minimum(words.at[q][:, None] + place, len(words.letters) - 1)], 0)
    right = np.where(place < b[:, None], trie.letters[np.minimum(trie.at[w][:, None] + place, len(trie.letters) - 1)], 0)
    swap = (a > b)[:, None]
    short, long = np.where(swap, right, left), np.where(swap, left, right)
    differ = short != long
    shifted = np.ones_like(differ)
    shifted[:, :-1] = short[:, :-1] == long[:, 1:]
    # the letters before the first difference are equal, those from it on if one of the longer is skipped
    bad = np.where(shifted, -1, place).max(axis=1)
    out[rows] = np.where(a == b, differ.sum(axis=1) == 1, bad < differ.argmax(axis=1))
    return out


def neighbours(words: Words, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query word, word of the trie) at distance one, each once.

    The automaton has one state for each pair of a word and a node, so no pair is found
    twice. Blocks of states of one depth are followed last in, first out.
    """
    found_q, found_w = [], []
    stack = [(0, np.arange(len(words.words)), np.zeros(len(words.words), np.int64), np.full(len(words.words), EXACT, np.uint8))]
    while stack:
        depth, q, node, state = stack.pop()
        if len(q) > STATES:
            half = len(q) // 2
            stack += [(depth, q[half:], node[half:], state[half:]), (depth, q[:half], node[:half], state[:half])]
            continue
        size = words.size[q]
        single = trie.only[node]
        leaf = single >= 0
        if leaf.any():
            rows = np.flatnonzero(leaf)
            rest, own, s = trie.at[single[rows] + 1] - trie.at[single[rows]] - depth, size[rows] - depth, state[rows]
            fits = ((s & EXACT) > 0) & (np.abs(rest - own) < 2) | ((s & LESS) > 0) & (own + 1 == rest) | ((s & EVEN) > 0) & (own == rest) | ((s & MORE) > 0) & (own - 1 == rest)
            rows = rows[fits]
            rows = rows[_one_apart(words, q[rows], trie, single[rows])]
            found_q.append(q[rows])
            found_w.append(single[rows])
        ends = trie.ends[node]
        stop = (ends >= 0) & (((state & (EXACT | MORE)) > 0) & (size == depth + 1) | ((state & EVEN) > 0) & (size == depth) | ((state & LESS) > 0) & (size == depth - 1))
        found_q.append(q[stop])
        found_w.append(ends[stop])

        inner = ~leaf
        q, node, state = q[inner], node[inner], state[inner]
        exact = (state & EXACT) > 0
        # with no edit so far every child may follow
        q0, node0, state0 = q[exact], node[exact], state[exact]
        many = trie.children[node0]
        parent = np.repeat(np.arange(len(q0)), many)
        child = trie.first[node0][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
        label, held = trie.label[child], state0[parent]
        here, after = (words.label(q0, np.full(len(q0), d))[parent] == label for d in (depth, depth + 1))
        size0 = words.size[q0][parent]
        bits = np.where(here, EXACT, 0) | LESS | np.where(~here & (depth < size0), EVEN, 0) | np.where(after & (depth + 1 < size0), MORE, 0)
        bits |= np.where((held & EVEN > 0) & here, EVEN, 0) | np.where((held & MORE > 0) & after, MORE, 0)
        new = [(q0[parent], child, bits.astype(np.uint8))]
        # with an edit only the child that the word goes on with at each place
        q1, node1, state1 = q[~exact], node[~exact], state[~exact]
        if len(q1):
            a, b, c = (np.where(state1 & bit, trie.child(node1, words.label(q1, np.full(len(q1), d))), -1) for bit, d in ((LESS, max(depth - 1, 0)), (EVEN, depth), (MORE, depth + 1)))
            bits_a = np.full(len(q1), LESS, np.uint8) | np.where(b == a, EVEN, 0) | np.where(c == a, MORE, 0)
            bits_b = np.full(len(q1), EVEN, np.uint8) | np.where(c == b, MORE, 0)
            for rows, to, bits in ((a >= 0, a, bits_a), ((b >= 0) & (b != a), b, bits_b), ((c >= 0) & (c != a) & (c != b), c, np.full(len(q1), MORE))):
                new.append((q1[rows], to[rows], bits[rows].astype(np.uint8)))
        q, node, state = (np.concatenate(x) for x in zip(*new, strict=True))
        if len(q):
            stack.append((depth + 1, q, node, state))
    return np.concatenate(found_q), np.concatenate(found_w)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> tries of bounded size."""
    words, n, size = [], [], 0

    def shard() -> pa.RecordBatch:
        data = Trie.of(words, n).pack()
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], names=["trie", "size"])

    for batch in batches:
        for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.append(word.encode("latin-1"))
            n.append(count)
            size += len(word)
            if len(words) >= SHARD or size >= SHARD_BYTES:
                yield shard()
                words, n, size = [], [], 0
    if words:
        yield shard()


def _look_up(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n) -> the number of its near words in a block of tries and the best of them."""

        def found(held: list[tuple[str, int]]) -> pa.RecordBatch:
            words = Words([word.encode("latin-1") for word, _ in held])
            near, best, form = np.zeros(len(held), np.int64), np.full(len(held), -1, np.int64), [None] * len(held)
            for trie in tries:
                q, w = neighbours(words, trie)
                near += np.bincount(q, minlength=len(held))
                order = np.lexsort((w, -trie.n[w], q))  # a trie's words are in code-point order
                q, w = q[order], w[order]
                for i in np.flatnonzero(np.diff(q, prepend=-1)):
                    n, spelt = int(trie.n[w[i]]), trie.word(w[i]).decode("latin-1")
                    if n > best[q[i]] or n == best[q[i]] and spelt < form[q[i]]:
                        best[q[i]], form[q[i]] = n, spelt
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.string()), pa.array([x[1] for x in held], pa.int64()), pa.array(near), pa.array(form, pa.string()), pa.array(best, pa.int64(), mask=best < 0)], names=["word", "n", "n_near", "form", "form_n"])

        tries, held = [Trie.unpack(data) for data in block.value], []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= QUERIES:
                yield found(held)
                held = []
        if held:
            yield found(held)

    return run


def word_counts(docs: DataFrame, odds: int = ODDS) -> DataFrame:
    """(word, n) of all words of ``docs`` with LEAST_LETTERS letters and LEAST_COUNT occurrences."""
    small_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(lean(_count(odds)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def nearest_forms(dictionary: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) for every row of ``dictionary`` (word, n), a written table of distinct words of Latin letters.

    The form is the near word of greatest n, of equal ones the first in code-point order.
    """
    spark = dictionary.sparkSession
    total, letters = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    shards = max(1, -(-total // SHARD), -(-letters // SHARD_BYTES))
    # a session may deal out to more partitions than asked for; neighbours are put together again
    ranges = dictionary.repartitionByRange(shards, "word").coalesce(shards)
    tries = materialize(ranges.mapInArrow(lean(_build), "trie binary, size long").withColumn("no", F.monotonically_increasing_id()), "trie-shards")
    blocks: list[list[int]] = [[]]
    size = 0
    for r in tries.select("no", "size").orderBy("no").toLocalIterator():
        if blocks[-1] and size + r["size"] > BLOCK_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append(r["no"])
        size += r["size"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (4 * QUERIES)))
    words = dictionary.repartition(tasks)
    parts = []
    for block in blocks:
        sent = spark.sparkContext.broadcast([bytes(r.trie) for r in tries.where(F.col("no").isin(block)).select("trie").collect()])
        parts.append(materialize(words.mapInArrow(lean(_look_up(sent)), "word string, n long, n_near long, form string, form_n long"), "near-words"))
        sent.unpersist()
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))).alias("best")
    return every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def group_variants(docs: DataFrame, odds: int = ODDS) -> DataFrame:
    """One row for every word of ``docs``: word, n, n_near, form, form_n, root.

    Words are maximal runs of letters of whole texts, A-Z as a-z, of LEAST_LETTERS letters
    and LEAST_COUNT occurrences or more; where ``odds`` divides the hash of a document's
    doc_id and a word, the word loses a letter there. A word's form is its near word of
    greatest n, of equal ones the first in code-point order, if that n is twice the
    word's or more; its root is where the forms end. A null text has no words; a null
    doc_id counts as an empty one. Repeated rows count each. Words of any length are
    compared whole. Other columns are ignored; no words give an empty result.

    Counts are summed in each task before they are shuffled. The dictionary is read
    once for each block of tries; following forms takes rounds that grow with the
    logarithm of the longest chain, which doubles n at every step.
    """
    near = nearest_forms(materialize(word_counts(docs, odds), "word-counts"))
    kept = F.col("form_n") >= 2 * F.col("n")
    found = materialize(near.select("word", "n", "n_near", F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")), "word-forms")
    ways = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = materialize(ways.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        if not ways.where("moved").limit(1).count():
            break
        ways = ways.drop("moved")
    return found.join(sized(ways.select("word", "root")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def sql(odds: int = ODDS) -> str:
    """The same in SQL: CRC-32 by a table, near words by the rest of either without one letter."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])))"
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({lower}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) GROUP BY doc_id, w),
b AS (SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, (ord(x) - 64)::BIGINT] END)) AS bytes FROM r WHERE length(w) >= {LEAST_LETTERS}),
h AS (SELECT w, c, {crc} AS h FROM b, tab),
v AS (SELECT CASE WHEN h % {odds} = 0 THEN concat(w[:h % length(w)], w[h % length(w) + 2:]) ELSE w END AS word, c FROM h),
g AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
d AS MATERIALIZED (SELECT word, n, i, concat(word[:i - 1], word[i + 1:]) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM g)),
p AS (SELECT x.word AS a, y.word AS b, y.n FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word UNION SELECT d.word, g.word, g.n FROM d JOIN g ON g.word = d.rest UNION SELECT g.word, d.word, d.n FROM d JOIN g ON g.word = d.rest),
s AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS m FROM p GROUP BY a),
f AS MATERIALIZED (SELECT g.word, g.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * g.n THEN b END AS form, CASE WHEN m >= 2 * g.n THEN m END AS form_n FROM g LEFT JOIN s ON s.a = g.word),
w(word, root, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, steps + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, form, e.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM w GROUP BY word) e ON e.word = f.word"""
