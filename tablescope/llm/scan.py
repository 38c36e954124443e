"""Words of a batch of texts and their hashes, found with array operations on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BYTES_PER_CHUNK = 1_500_000
# The bytes that part words.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(size: int, inverse: bool) -> np.ndarray:
    odd = 0xD6E8FEB86659FD93
    return np.cumprod(np.full(size, pow(odd, -1, 1 << 64) if inverse else odd, dtype=np.uint64))


@cache
def letters() -> np.ndarray:
    """A 64-bit number for every byte, the same for A-Z and a-z."""
    of = np.arange(256)
    of[65:91] += 32
    return mixed(of.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@cache
def _inside() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(BLANKS)] = False
    return table


def chunks(column: pa.Array, limit: int = BYTES_PER_CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, start of every text in them and the end); nulls are empty, texts whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    begin = 0
    while begin < len(column):
        stop = int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1
        stop = min(max(stop, begin + 1), len(column), begin + 20_000)
        yield begin, stop, raw[ends[begin] : ends[stop]], ends[begin : stop + 1] - ends[begin]
        begin = stop


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every run of marked bytes; runs do not cross texts."""
    size = len(inside)
    if size == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    border = np.zeros(size + 1, dtype=bool)
    border[starts] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | border[1:size]
    shuts = inside.copy()
    shuts[:-1] &= ~inside[1:] | border[1:size]
    begin, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(_inside()[raw], starts)


class Hasher:
    """64-bit hashes of byte ranges of one chunk, ignoring the case of A-Z."""

    def __init__(self, raw: np.ndarray, table: np.ndarray | None = None):
        room = 1 << max(16, int(len(raw)).bit_length())
        self.inverse = _powers(room, True)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((letters() if table is None else table)[raw] * _powers(room, False)[: len(raw)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


_PRIME, _BASE = (1 << 31) - 1, 1_566_083_941


@cache
def _prime_powers(size: int, inverse: bool) -> np.ndarray:
    out = np.empty(size, dtype=np.int64)
    out[0], done = pow(_BASE, -1, _PRIME) if inverse else _BASE, 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more] * out[done - 1] % _PRIME
        done += more
    return out


@cache
def _prime_letters() -> np.ndarray:
    return (letters() % np.uint64(_PRIME)).astype(np.int64)


class StrongHasher(Hasher):
    """As ``Hasher``, with a second polynomial modulo a prime: words exist that agree modulo every power of two."""

    def __init__(self, raw: np.ndarray):
        super().__init__(raw)
        room = 1 << max(16, int(len(raw)).bit_length())
        self.prime_inverse = _prime_powers(room, True)
        self.prime_sums = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(_prime_letters()[raw] * _prime_powers(room, False)[: len(raw)] % _PRIME, out=self.prime_sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        rest = (self.prime_sums[end] - self.prime_sums[begin]) % _PRIME * self.prime_inverse[begin] % _PRIME
        return mixed(super().of(begin, end) + mixed(rest.astype(np.uint64)))


def shingles(raw: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and where each text's begin; a shorter text with words gives all of them as one."""
    begin, end, text = words(raw, starts)
    texts = len(starts) - 1
    h = StrongHasher(raw).of(begin, end)
    n = np.bincount(text, minlength=texts)
    first = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offset = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(texts), count)
    at = first[owner] + np.arange(offset[-1]) - offset[owner]
    out = np.zeros(len(at), dtype=np.uint64)
    have = n[owner]
    for i in range(k):
        ok = (i < have) if i else np.ones(len(at), dtype=bool)
        word = h[np.minimum(at + i, max(len(h) - 1, 0))] if len(h) else np.zeros(0, dtype=np.uint64)
        out = np.where(ok, mixed(out * np.uint64(0xFF51AFD7ED558CCD) + word), out)
    return out, offset


def distinct(values: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of every text, and where each text's begin."""
    parts = [np.unique(values[a:b]) for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
