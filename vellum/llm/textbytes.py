"""Whole texts as byte arrays: words, word hashes and shingles in NumPy.

Words are found and hashed on UTF-8 bytes. All delimiters that the operators use
are ASCII, and every byte of a multi-byte character is 0x80 or above, so this
equals splitting the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; it bounds a worker's memory whatever the length of a text.
BLOCK = 1 << 17

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(fold: bool) -> np.ndarray:
    code = np.arange(256)
    if fold:
        code = np.where((code >= 65) & (code <= 90), code + 32, code)
    return mix((code.astype(U) + U(1)) * U(_BASE)) | U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


FOLDED, EXACT = _table(True), _table(False)
#: Which bytes belong to a line.
LINE = np.arange(256) != 10
_POW: dict[str, np.ndarray] = {}


def _pow(kind: str) -> np.ndarray:
    if kind not in _POW:
        _POW[kind] = _powers(_BASE if kind == "up" else pow(_BASE, -1, 1 << 64), BLOCK + 1)
    return _POW[kind]


def classes(spaces: bool) -> np.ndarray:
    """Which bytes belong to a word: all but white space, or letters, digits and all beyond ASCII."""
    code = np.arange(256)
    if spaces:
        return ~((code == 0x20) | ((code >= 0x09) & (code <= 0x0D)))
    return ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x41) & (code <= 0x5A)) | ((code >= 0x61) & (code <= 0x7A)) | (code >= 0x80)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _words_of(block: np.ndarray, table: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of at most BLOCK bytes."""
    inside = np.zeros(len(block) + 2, np.int8)
    inside[1:-1] = member[block]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(block) + 1, U)
    np.cumsum(table[block] * _pow("up")[: len(block)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * _pow("down")[starts])


def words(data: np.ndarray, member: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of one text, A-Z hashed as a-z.

    Texts over BLOCK bytes are cut between words; a single word over BLOCK bytes is
    hashed from the hashes of its pieces.
    """
    if len(data) <= BLOCK:
        return _words_of(data, table, member)
    found, at = [], 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        if stop < len(data):
            gaps = np.flatnonzero(~member[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                inner = member[data[at:]]
                size = len(inner) if inner.all() else int(np.argmin(inner))
                pieces = [int(_words_of(data[i : min(i + BLOCK, at + size)], table, member)[2][0]) for i in range(at, at + size, BLOCK)]
                value = np.zeros(1, U)
                for piece in pieces:
                    value = mix(value * U(_BASE) + U(piece))
                found.append((np.array([at]), np.array([at + size]), value))
                at += size
                continue
        s, e, h = _words_of(data[at:stop], table, member)
        found.append((s + at, e + at, h))
        at = stop
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    data, at = raw(batch.column(batch.schema.get_field_index(name)))
    for i in range(len(at) - 1):
        yield data[at[i] : at[i + 1]]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence is one."""
    n = len(hashes)
    if not n:
        return hashes
    m, width = max(1, n - k + 1), min(k, n)
    value = np.full(m, width, U)
    for j in range(width):
        value = mix(value * U(_BASE) + hashes[j : j + m])
    return np.unique(value)
