"""Words and hashes of a column of texts, as numpy arrays.

``chunks`` cuts an Arrow string column into pieces of whole texts (about half a MB
each, so that the working arrays stay small) and gives each piece as ``Words``.
A null text is a text without words.  Words never cross two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes.
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 19

#: Bytes that separate words: all but these belong to words.  Texts are UTF-8, so
#: bytes from 0x80 up are parts of characters outside ASCII.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: The same before A-Z have been lower-cased.
NOT_ALPHANUMERIC_RAW = bytes(c for c in NOT_ALPHANUMERIC if not 0x41 <= c <= 0x5A)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * CHUNK_BYTES)
            for name, factor in (("up", BASE), ("down", INVERSE)):
                x = np.full(size, factor, U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))
        return self.up, self.down


POWERS = Powers()


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the hash of any span of values."""
    up, _ = POWERS.get(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = POWERS.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


@dataclass
class Words:
    first: int  #: row of the column at which this piece begins
    data: np.ndarray  #: the bytes of the piece
    bounds: np.ndarray  #: offset in ``data`` of each text, and the end
    starts: np.ndarray  #: offsets of words in ``data``
    ends: np.ndarray
    offsets: np.ndarray  #: index of each text's first word, and the number of words

    def letters(self, lower: bool) -> np.ndarray:
        """Sums for ``spans`` over the bytes; ``lower`` takes A-Z as a-z."""
        values = mix(np.arange(1, 257, dtype=U64))
        if lower:
            values[65:91] = values[97:123]
        return rolling(values[self.data])

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word."""
        return spans(self.letters(lower), self.starts, self.ends)

    def grams(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and which of these spans end in the same text."""
        n = len(hashes)
        ends = np.minimum(np.arange(n) + size, n)
        last = np.repeat(self.offsets[1:], np.diff(self.offsets))
        return spans(rolling(hashes), np.arange(n), ends), np.arange(n) + size <= last


def chunks(column: pa.Array | pa.ChunkedArray, separators: bytes = SPACES) -> Iterator[Words]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        upto = min(upto, len(column))
        bounds = offsets[at : upto + 1] - offsets[at]
        piece = data[offsets[at] : offsets[upto]]
        word = np.zeros(len(piece) + 2, bool)
        word[1:-1] = inside[piece]
        before, after = word[:-2].copy(), word[2:].copy()
        before[bounds[:-1][bounds[:-1] < len(piece)]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts = np.flatnonzero(word[1:-1] & ~before)
        ends = np.flatnonzero(word[1:-1] & ~after) + 1
        yield Words(at, piece, bounds, starts, ends, np.searchsorted(starts, bounds))
        at = upto
