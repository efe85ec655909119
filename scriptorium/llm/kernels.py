"""Vectorised text kernels over Arrow string columns (numpy only, no per-word Python).

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a
longer character, so splitting bytes splits code points. Nulls count as empty texts everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MULT = U64(0x9E3779B97F4A7C15)
_POW = np.ones(1, dtype=np.uint64)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(64, 1 << int(n - 1).bit_length())
        steps = np.full(size, 0xD1342543DE82EF95, dtype=np.uint64)
        steps[0] = 1
        _POW = np.cumprod(steps, dtype=np.uint64)
    return _POW


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two 64-bit hashes."""
    return mix64(a * U64(0x9FB21C651E98DF25) + (b ^ (b >> U64(29))) * _MULT + U64(0x165667B19E3779F9))


@dataclass
class Words:
    """Words of a batch: byte spans, document index, hash; first[i]:first[i+1] are document i's."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and n+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    n = len(offsets) - 1
    if lower:
        buf = _LOWER[buf]
    word = ~_SEP[buf]
    new = word.copy()
    new[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < len(buf)]
    new[at] = word[at]
    start = np.flatnonzero(new)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(buf, offsets, z, z, z, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64))
    idx = np.flatnonzero(word)
    begin = np.searchsorted(idx, start)
    count = np.diff(np.append(begin, len(idx)))
    pos = np.arange(len(idx)) - np.repeat(begin, count)
    vals = _BYTE[buf[idx]] * _powers(int(count.max()))[pos]
    h = mix64(np.add.reduceat(vals, begin) + count.astype(np.uint64) * _MULT)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(buf, offsets, start, start + count, doc, h, first)


def word_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each document, without hashing them."""
    word = ~_SEP[buf]
    new = word.copy()
    new[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < len(buf)]
    new[at] = word[at]
    return per_doc(new, offsets)


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each document's bytes (empty documents: 0)."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end); the spans are disjoint and ascending. Empty spans hash alike."""
    if not len(start):
        return np.zeros(0, np.uint64)
    count = end - start
    full = count > 0
    out = np.zeros(len(start), np.uint64)
    if full.any():
        s, c = start[full], count[full]
        begin = np.concatenate(([0], np.cumsum(c)[:-1]))
        pos = np.arange(int(c.sum())) - np.repeat(begin, c)
        vals = _BYTE[buf[np.repeat(s, c) + pos]] * _powers(int(c.max()))[pos]
        out[full] = np.add.reduceat(vals, begin)
    return mix64(out + count.astype(np.uint64) * _MULT)


def docs_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of n documents begins in the ascending array of document indexes; n+1 entries."""
    return np.searchsorted(doc, np.arange(n + 1))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20, max_rows: int = 1 << 16):
    """Row slices of a batch whose texts take up to max_bytes together; a longer text comes alone."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(n, max(i + 1, j), i + max_rows)
        yield batch.slice(i, j - i)
        i = j
