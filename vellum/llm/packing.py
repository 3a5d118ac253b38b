"""Packing of tokenised documents into sequences by first-fit decreasing.

Documents fall into groups at random, each packed on its own. A document's tokens are
cut into full sequences and a rest; the rests of a group, longest first, go to the first
sequence with room for them, which a tournament tree over the free room of all finds in
logarithmic time. Room that is left is then filled with cuts from the emptiest sequences, and
the one that stays partly filled is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import documents, lean, small_batches

#: The tokenizer's file; a parameter of every function that reads it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Tokens of a full sequence.
CAPACITY = 2048
#: The token that ends every document.
END = 1
#: Documents, and bytes of text, that a group has on average.
GROUP, GROUP_BYTES = 2048, 1 << 24
#: The least room that is filled with a cut of another document; less is padded.
LEAST_CUT = 32
#: Code points of a text that are tokenised at a time, as far as there is a place to cut.
SLICE = 1 << 18
#: Words whose ids a worker remembers.
WORDS = 1_200_000
#: Stands for the ids of what is no single word.
OTHER = b"?"

#: Before a space between two characters that are not spaces, a new word begins whatever stands around it.
_BREAK = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    Words are tokenised apart from each other by the tokenizer, so ids of a word after a
    space are looked up, and only those of new words are made. Text with other runs of
    spaces goes to the tokenizer as it is. A special token's name in a text gives that token.
    """

    def __init__(self, path: str = TOKENIZER):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        top = max(vocabulary.values(), default=0)
        self.kind = np.dtype("<u2") if max(top, END) < 1 << 16 else np.dtype("<u4")
        added = self.tokenizer.get_added_tokens_decoder()
        self.size = np.zeros(top + 1, np.int64)
        for token, i in vocabulary.items():
            # a byte-level token has a character for each byte
            self.size[i] = len(token.encode()) if i in added else len(token)
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, self.kind) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Ids of words that follow a space, many in one text; those that begin or end with another space are refused with OTHER."""
        plain = []
        for word in words:
            if not word or word[0].isspace() or word[-1].isspace():
                self.known[word] = OTHER
            else:
                plain.append(word)
        for i in range(0, len(plain), 256):
            part = plain[i : i + 256]
            ids = self.whole(["".join([f" {word}" for word in part])])[0]
            ends = np.cumsum([len(word.encode()) + 1 for word in part])
            cut = np.searchsorted(np.cumsum(self.size[ids]), ends, side="right")
            data, at = ids.tobytes(), 0
            for word, stop in zip(part, (cut * self.kind.itemsize).tolist(), strict=True):
                self.known[word] = data[at:stop]
                at = stop

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` and the end token."""
        out, at = [], 0
        while at < len(text):
            stop = _BREAK.search(text, at + SLICE) if len(text) - at > SLICE else None
            piece = text[at : stop.start()] if stop else text[at:]
            at += len(piece)
            first, *words = piece.split(" ")
            found = list(map(self.known.get, words))
            if None in found:
                new = {word for word, ids in zip(words, found, strict=True) if ids is None}
                if len(self.known) + len(new) > WORDS:  # the older half goes
                    self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
                self.learn(new)
                found = [ids if ids is not None else self.known[word] for word, ids in zip(words, found, strict=True)]
            if (first and (first[0].isspace() or first[-1].isspace())) or OTHER in found:
                out.append(self.whole([piece])[0].tobytes())
            else:
                if first:
                    out.append(self.whole([first])[0].tobytes())
                out += found
        out.append(np.array([END], self.kind).tobytes())
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) -> full sequences and the rest of each text."""
        made = encoder(path)
        step = capacity * made.kind.itemsize
        for batch in batches:
            rows, starts, totals, ids, size = [], [], [], [], 0

            def table(rows, starts, totals, ids, batch=batch):
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "doc_tokens", "ids"])

            for i, text in enumerate(batch.column(1)):
                data = made.encode(text.as_py() or "")
                for at in range(0, len(data), step):
                    rows.append(i)
                    starts.append(at // made.kind.itemsize)
                    totals.append(len(data) // made.kind.itemsize)
                    ids.append(data[at : at + step])
                    size += len(ids[-1])
                    if size > 1 << 22:
                        yield table(rows, starts, totals, ids)
                        rows, starts, totals, ids, size = [], [], [], [], 0
            yield table(rows, starts, totals, ids)

    return run


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The items of each bin, longest first: each in the first bin with room for it.

    A node of the tournament tree has the most room of any bin below it, so the first bin
    with enough is found on the way down from the root, at every node to the left where
    the left has enough.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins


def pack_group(sizes: list[int], capacity: int = CAPACITY, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, first token, tokens) that hold each token of each item once.

    After first-fit decreasing, the fullest sequences with room for ``least_cut`` tokens
    are filled from the emptiest. What the last one holds is cut into powers of two.
    """
    bins = [[(i, 0, sizes[i]) for i in items] for items in first_fit_decreasing(sizes, capacity)]
    fill = [sum(n for _, _, n in pieces) for pieces in bins]
    order = sorted(range(len(bins)), key=lambda b: (fill[b], -b))
    low, high = 0, len(order) - 1
    while low < high:
        giver, taker = order[low], order[high]
        room = capacity - fill[taker]
        if room < least_cut:
            high -= 1
            continue
        item, at, n = bins[giver].pop()
        moved = min(n, room)
        if moved < n:
            bins[giver].append((item, at, n - moved))
        bins[taker].append((item, at + n - moved, moved))
        fill[giver] -= moved
        fill[taker] += moved
        low += fill[giver] == 0
    packed = [bins[b] for b in sorted(order[low:]) if b != order[low]] if order else []
    rest = list(reversed(bins[order[low]])) if order else []
    if order and fill[order[low]] > capacity - least_cut:
        packed.append(rest)
        rest = []
    left = sum(n for _, _, n in rest)
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        packed.append([])
        while size:
            item, at, n = rest.pop()
            if n > size:
                rest.append((item, at + size, n - size))
            packed[-1].append((item, at, min(n, size)))
            size -= min(n, size)
    return packed


def _packer(capacity: int, kind: str, schema: pa.Schema):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        width, first = np.dtype(kind).itemsize, key[0].as_py() << 32
        ids = group.column("ids").combine_chunks()
        sizes = (np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]) // width).tolist() if len(ids) else []
        full = [i for i, n in enumerate(sizes) if n == capacity]
        rest = [i for i, n in enumerate(sizes) if n < capacity]
        sequences = [[(i, 0, capacity)] for i in full] + [[(rest[i], at, n) for i, at, n in pieces] for pieces in pack_group([sizes[i] for i in rest], capacity)]
        row, start, length, sequence, offset, out = [], [], [], [], [], []
        for number, pieces in enumerate(sequences):
            place = 0
            for i, at, n in pieces:
                row.append(i)
                start.append(at)
                length.append(n)
                sequence.append(first + number)
                offset.append(place)
                out.append(np.frombuffer(ids[i].as_buffer(), kind, n, at * width).astype("<u4").tobytes())
                place += n
        held = group.take(pa.array(row, pa.int64()))
        starts = np.array(start, np.int64) + held.column("start").to_numpy()
        return pa.table([held.column("doc_id"), pa.array(starts), pa.array(length, pa.int64()), held.column("doc_tokens"), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for every piece of every row of ``docs``: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers. A text's
    ids are cut into pieces that hold each id once; a null text is an empty one, which
    has the end token alone. Rows that share a doc_id, equal ones too, are documents of
    their own. Texts of any length are read whole. Other columns are ignored; an empty
    table gives an empty result. Which documents share a sequence depends on chance and
    on how the table is split, the ids of a piece do not.

    One shuffle: pieces go to groups by a hash of their row and place, whatever their
    doc_id or text, so no group is hot; a group has some thousand documents and its pieces
    stay within a few tens of MB. The number of groups grows with the table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-n // GROUP), -(-size // GROUP_BYTES))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.mapInArrow(lean(_pieces(tokenizer, capacity)), f"doc_id {id_type}, start long, doc_tokens long, ids binary")
    cut = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "start"), F.lit(groups)))
    kind = encoder(tokenizer).kind.str
    out = StructType.fromDDL(f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return cut.groupBy("group").applyInArrow(_packer(capacity, kind, to_arrow_schema(out)), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(documents(spark, sf_dir))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
