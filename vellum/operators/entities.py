"""Links to a catalogue's entities: an Aho-Corasick automaton over whole texts.

The catalogue's surfaces become one automaton whose tables are NumPy arrays: the next
state for each state and byte, the surface that ends at a state, and the next shorter
one. Texts are cut into stretches that overlap by the longest surface, and all
stretches of a batch go through the automaton side by side, a byte a step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.scratch import lean, materialize, small_batches

#: Bytes of surfaces whose automaton is broadcast at a time.
BLOCK_BYTES = 1 << 17
#: Least bytes of a stretch of text.
STRETCH = 2048
#: Candidates that a note keeps.
CAP = 50

_WORD = re.compile(r"\w")


class Automaton:
    """Finds every occurrence of every surface, those within others too."""

    def __init__(self, surfaces: list[bytes]):
        self.size = np.array([len(s) for s in surfaces], np.int64)
        self.longest = int(self.size.max(initial=1))
        used = np.unique(np.frombuffer(b"".join(surfaces) or b"\0", np.uint8))
        self.letter = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        self.letter[used] = 1 + np.arange(len(used))
        order = sorted(range(len(surfaces)), key=surfaces.__getitem__)
        flat = np.frombuffer(b"".join([surfaces[i] for i in order]) + b"\0", np.uint8)
        length = self.size[order]
        at = np.cumsum(length) - length
        # the trie level by level: a state is a run of sorted surfaces with one beginning
        states = 1
        row, owner, depth = np.arange(len(order)), np.zeros(len(order), np.int64), 0
        levels = []
        while True:
            row, owner = row[length[row] > depth], owner[length[row] > depth]
            if not len(row):
                break
            byte = self.letter[flat[at[row] + depth]]
            new = np.ones(len(row), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])
            parent, label = owner[new], byte[new]
            owner = states + np.cumsum(new) - 1
            ends = np.full(len(parent), -1, np.int32)
            done = length[row] == depth + 1
            ends[owner[done] - states] = np.array(order, np.int32)[row[done]]
            levels.append((parent, label, np.arange(states, states + len(parent)), ends))
            states += len(parent)
            depth += 1
        self.step = np.zeros((states, len(used) + 1), np.int32)
        self.out, self.up = np.full(states, -1, np.int32), np.zeros(states, np.int32)
        fail = np.zeros(states, np.int32)
        for parent, label, state, ends in levels:
            # where the parent would have gone without this child
            fail[state] = np.where(parent > 0, self.step[parent, label], 0)
            self.step[parent, label] = state
            self.out[state] = ends
            back = fail[state]
            self.up[state] = np.where(self.out[back] >= 0, back, self.up[back])
            self.step[state] = self.step[back]
        self.hot = (self.out >= 0) | (self.up > 0)

    def find(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, byte after the end, surface) of all occurrences in texts that lie side by side in ``data``, cut at ``at``."""
        length = max(STRETCH, 4 * self.longest)
        size = np.diff(at)
        pieces = np.maximum(-(-size // length), 0)
        text = np.repeat(np.arange(len(size)), pieces)
        own = at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        first = np.maximum(own - self.longest + 1, at[text])
        last = np.minimum(own + length, at[text + 1])
        order = np.argsort(first - last, kind="stable")  # longest first, so that those still running stand in front
        text, own, first, steps = text[order], own[order], first[order], (last - first)[order]
        running = np.searchsorted(-steps, -np.arange(steps.max(initial=0)), side="left")
        coded, state, found = self.letter[data], np.zeros(len(text), np.int32), []
        for i, n in enumerate(running.tolist()):
            now = self.step[state[:n], coded[first[:n] + i]]
            state[:n] = now
            hit = np.flatnonzero(self.hot[now])
            if len(hit):
                hit = hit[first[hit] + i >= own[hit]]  # others end in the stretch before
                found.append((text[hit], first[hit] + i + 1, now[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        text, end, now = (np.concatenate(x) for x in zip(*found, strict=True))
        parts = []
        while len(now):
            said = self.out[now] >= 0
            parts.append((text[said], end[said], self.out[now[said]]))
            now = self.up[now]
            more = now > 0
            text, end, now = text[more], end[more], now[more]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _beside(data: np.ndarray, at: int, low: int, high: int) -> bool:
    """Whether the character that byte ``at`` belongs to is a letter, digit or underscore; there is none outside ``low`` and ``high``."""
    if at < low or at >= high:
        return False
    begin = at
    while begin > low and data[begin] & 0xC0 == 0x80:
        begin -= 1
    end = at + 1
    while end < high and data[end] & 0xC0 == 0x80:
        end += 1
    return _WORD.match(data[begin:end].tobytes().decode()) is not None


def _matcher(block, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, text) -> the first place of each surface that stands on its own in the text."""
        automaton: Automaton = block.value[0]
        for batch in batches:
            texts = batch.column(1).fill_null("")
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
            at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            text, end, surface = automaton.find(data, at)
            start = end - automaton.size[surface]
            order = np.lexsort((surface, start, text))
            rows, starts, ends, names, seen = [], [], [], [], set()
            for i in order.tolist():
                t, a, b, s = int(text[i]), int(start[i]), int(end[i]), int(surface[i])
                if (t, s) in seen or whole and (_beside(data, a - 1, at[t], at[t + 1]) or _beside(data, b, at[t], at[t + 1])):
                    continue
                seen.add((t, s))
                rows.append(t)
                starts.append(a)
                ends.append(b)
                names.append(s)
            # places in code points
            if rows:
                chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
                base = chars[at[rows]]
                starts, ends = chars[starts] - base, chars[ends] - base
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["key", "surface_no", "start", "end"])

    return run


def exact_matches(docs: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """(key, entity_id, matched, start, end): for each text and surface of ``entities`` (entity_id, surface) the first place where it stands as whole words, or anywhere without ``whole``, in code points.

    Matches count in the case they are written in, and overlapping ones all count.
    A surface that several entities share gives a row for each; an empty or null one
    none. The catalogue goes through the texts in blocks of BLOCK_BYTES bytes, each an
    automaton that is broadcast; where there are several, a block's result is written
    before the next comes to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    known = entities.where("surface <> ''").select("entity_id", "surface").distinct()
    surfaces = known.select("surface").distinct()
    size = surfaces.agg(F.sum(F.octet_length("surface"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = []
    for i in range(blocks):
        names = sorted(r.surface for r in surfaces.where(F.pmod(F.xxhash64("surface"), F.lit(blocks)) == i).collect())
        sent = spark.sparkContext.broadcast((Automaton([name.encode() for name in names]),))
        spelt = spark.createDataFrame(list(enumerate(names)), "surface_no int, matched string")
        found = docs.mapInArrow(lean(_matcher(sent, whole)), f"key {kind}, surface_no int, start long, end long")
        found = found.join(F.broadcast(spelt), "surface_no").select("key", "matched", "start", "end")
        parts.append(found if blocks == 1 else materialize(found, "entity-matches"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    shared = known.groupBy("surface").agg(F.collect_set("entity_id").alias("ids")).select(F.col("surface").alias("matched"), "ids")
    return every.join(shared, "matched").select("key", F.explode("ids").alias("entity_id"), "matched", "start", "end")


def link_candidates(docs: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text", cap: int = CAP, others: DataFrame | None = None) -> DataFrame:
    """(key, entity_id, matched, confidence, start, end, wikilink, truncated): candidates of each text, exact ones before others, then by place; ``cap`` of them, and how many are cut.

    ``others`` (key, entity_id, matched, confidence, start, end) come from a recogniser of
    names; those whose words a catalogue's surface already gave are left out. An
    entity counts once under each spelling, at its first place.
    """
    exact = exact_matches(docs, entities, key, text).withColumn("confidence", F.lit("exact"))
    rows = exact
    if others is not None:
        more = others.select(F.col(key).alias("key"), "entity_id", "matched", "start", "end", "confidence")
        told = materialize(exact, "exact-links")
        rows = told.unionByName(more.join(told.select("key", "matched").distinct(), ["key", "matched"], "left_anti"))
    first = rows.groupBy("key", "entity_id", "matched", "confidence").agg(F.min(F.struct("start", "end")).alias("place"))
    # the candidates of one text, at most one for each entity and spelling
    order = Window.partitionBy("key").orderBy(F.when(F.col("confidence") == "exact", 0).otherwise(1), "place.start", "place.end", "entity_id", "matched")
    n = F.count("*").over(Window.partitionBy("key"))
    ranked = first.withColumn("rank", F.row_number().over(order)).withColumn("truncated", F.greatest(n - cap, F.lit(0))).where(F.col("rank") <= cap)
    link = F.concat(F.lit("[["), F.regexp_replace("entity_id", r"^[^/]*/", ""), F.lit("]]"))
    return ranked.select(F.col("key").alias(key), "entity_id", "matched", "confidence", F.col("place.start").alias("start"), F.col("place.end").alias("end"), link.alias("wikilink"), "truncated")
