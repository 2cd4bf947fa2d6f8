"""Vectorised word splitting and hashing over Arrow text columns.

Texts are handled as UTF-8 bytes, whole: bytes are classed by a 256-entry
table, so a word is a run of word bytes and its hash is a polynomial over the
bytes with A-Z folded to a-z.  Work goes in slices of about a megabyte, so
memory stays a small multiple of one batch of rows (or of one very long text).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
GROUP_BYTES = 4 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true inside any of the closed ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: words are runs of anything but ASCII white space
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: words are runs of ASCII letters and digits and of everything beyond ASCII
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


class WordHasher:
    """Finds and hashes the words of a group of texts."""

    def __init__(self, word_bytes: np.ndarray, seed: int = 7) -> None:
        self.word_bytes = word_bytes
        codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        codes[0x41:0x5B] = codes[0x61:0x7B]
        codes[~word_bytes] = 0
        self.codes = codes
        self._powers(SLICE)

    def _powers(self, n: int) -> None:
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        up, down = np.full(n, base), np.full(n, inverse)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, word start bytes, and the first word of each text (one more at the end)."""
        inside = self.word_bytes[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        del begins, inside
        hashes = np.zeros(len(starts), dtype=np.uint64)
        for lo in range(0, len(data), SLICE):
            hi = min(len(data), lo + SLICE)
            w0, w1 = np.searchsorted(starts, (lo, hi))
            terms = self.codes[data[lo:hi]] * self.up[:hi - lo]
            here = starts[w0:w1] - lo
            head = here[0] if w1 > w0 else hi - lo
            if w0 and head:  # the end of a word that began in an earlier slice
                carried = int(terms[:head].sum()) * pow(_BASE, int(lo - starts[w0 - 1]), 1 << 64) & _MASK
                hashes[w0 - 1] = np.uint64((int(hashes[w0 - 1]) + carried) & _MASK)
            if w1 > w0:
                hashes[w0:w1] += np.add.reduceat(terms, here) * self.down[here]
        return mix(hashes), starts, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word (fewer words: empty)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mix(out * _MIX1 + hashes[j:j + n])
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups(batches, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut into groups of rows with about GROUP_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, side="right")) - 1
            end = min(batch.num_rows, max(row + 1, end))
            part = batch.slice(row, end - row)
            data, at = text_buffers(part.column(column))
            yield part, data, at
            row = end


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return hashes.view(np.int64)
