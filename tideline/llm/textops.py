"""Vectorised text work on Arrow batches: words, their hashes and n-gram hashes, without a Python loop over words.

Texts of a batch lie in one byte buffer. Blocks of about ``BLOCK`` bytes bound the temporary arrays; a text longer than
that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
ODD = 0x9E3779B97F4A7C15 | 1
#: A-Z lower-cased, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words in the looser sense: letters, digits and everything beyond ASCII.
WORDISH = np.zeros(256, bool)
WORDISH[48:58] = WORDISH[97:123] = WORDISH[128:] = True


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of blocks of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()[-3:]
    offsets = np.frombuffer(offset_buffer, kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(valid, np.diff(offsets), 0)
        if (np.diff(offsets)[~valid] != 0).any():
            data = np.concatenate([data[offsets[i] : offsets[i] + lengths[i]] for i in range(n)])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2 ** 64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (ODD, inverse))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


class Spans:
    """64-bit hashes of any spans of one buffer, from one running sum over it."""

    def __init__(self, data: np.ndarray) -> None:
        forward, self.backward = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.backward[starts] + (ends - starts).astype(np.uint64))


def word_ngrams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners) of the n-grams of word hashes that stay within one owner (non-decreasing)."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = h * np.uint64(ODD) + words[k : len(words) - n + 1 + k]
    keep = owner[: len(words) - n + 1] == owner[n - 1 :]
    return mix(h[keep]), owner[: len(words) - n + 1][keep]


def byte_ngrams(data: np.ndarray, n: int) -> np.ndarray:
    """The n (up to 8) bytes from every position on as one number, first byte highest; len(data) - n + 1 values."""
    m = max(0, len(data) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[k : k + m]
    return out
