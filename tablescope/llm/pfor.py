"""A file format for token ids: patched frame-of-reference blocks.

A file holds the ids of whole documents, one after the other, in blocks of ``BLOCK`` ids::

    magic   8 bytes
    blocks  one after the other
    index   u64 start of every block, counted from the beginning of the file
    docs    i64 id, u8 whether the id is null, u32 number of tokens of every document
    footer  u64 number of blocks, u64 documents, u64 ids, u64 start of the index

A block is ``u32 base, u8 width, u16 exceptions``, then ``BLOCK`` values minus the base, packed at ``width``
bits in 32-bit words, then ``u8 place`` and ``u32 value minus base`` of every exception. The width is that of
the block's 90th percentile, so a few large ids do not widen all others. All numbers are little-endian. The last
block is filled up with its smallest value.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENTILE = 0.9
_HEAD = 7


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) small values as (rows, 8 * width) words; value i starts at bit i * width."""
    words = np.zeros((BLOCK * width // 32 + 1, len(values)), dtype=np.uint64)
    lanes = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 32)
        both = lanes[i] << np.uint64(bit)
        words[word] |= both & np.uint64(0xFFFFFFFF)
        if bit + width > 32:
            words[word + 1] |= both >> np.uint64(32)
    return np.ascontiguousarray(words[:-1].T.astype("<u4"))


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.zeros((len(words[0]) + 1 if len(words) else 1, len(words)), dtype=np.uint64)
    lanes[:-1] = words.T
    out = np.empty((BLOCK, len(words)), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 32)
        both = lanes[word] >> np.uint64(bit)
        if bit + width > 32:
            both = both | (lanes[word + 1] << np.uint64(32 - bit))
        out[i] = both & mask
    return np.ascontiguousarray(out.T)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """A whole file; ``counts`` ids belong to each of ``doc_ids``, in this order."""
    blocks = -(-len(ids) // BLOCK)
    table = np.empty((blocks, BLOCK), dtype=np.uint32)
    flat = table.reshape(-1)
    flat[: len(ids)] = ids
    if len(ids) < len(flat):
        flat[len(ids) :] = ids[(blocks - 1) * BLOCK :].min()
    base = table.min(axis=1) if blocks else np.zeros(0, dtype=np.uint32)
    delta = table - base[:, None]
    rank = int(PERCENTILE * (BLOCK - 1))
    width = _bits(np.partition(delta, rank, axis=1)[:, rank]) if blocks else np.zeros(0, dtype=np.int64)
    over = delta >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    patches = over.sum(axis=1)
    size = _HEAD + width * (BLOCK // 8) + 5 * patches
    start = len(MAGIC) + np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    at = start - len(MAGIC)

    def put(rows: np.ndarray, offset: np.ndarray, values: np.ndarray) -> None:
        if values.shape[1]:
            out[(at[rows] + offset)[:, None] + np.arange(values.shape[1])] = values

    every, none = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    put(every, none, base.astype("<u4").view(np.uint8).reshape(-1, 4))
    put(every, none + 4, width.astype(np.uint8).reshape(-1, 1))
    put(every, none + 5, patches.astype("<u2").view(np.uint8).reshape(-1, 2))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            low = np.where(over[rows], 0, delta[rows])
            put(rows, np.full(len(rows), _HEAD), _packed(low, int(w)).view(np.uint8).reshape(len(rows), -1))
    row, place = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
    tail = _HEAD + width * (BLOCK // 8)
    put(row, tail[row] + nth, place.astype(np.uint8).reshape(-1, 1))
    put(row, tail[row] + patches[row] + 4 * nth, delta[row, place].astype("<u4").view(np.uint8).reshape(-1, 4))
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    footer = np.array([blocks, len(doc_ids), len(ids), len(MAGIC) + len(out)], dtype="<u8")
    return b"".join([
        MAGIC, out.tobytes(), start.astype("<u8").tobytes(), known.tobytes(), null.tobytes(),
        np.asarray(counts).astype("<u4").tobytes(), footer.tobytes(),
    ])


def unpack(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """The three arguments of ``pack``."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of packed ids")
    raw = np.frombuffer(data, dtype=np.uint8)
    blocks, docs, total, index = (int(x) for x in np.frombuffer(data[-32:], dtype="<u8"))
    start = np.frombuffer(data, dtype="<u8", count=blocks, offset=index).astype(np.int64)
    at = index + 8 * blocks
    known = np.frombuffer(data, dtype="<i8", count=docs, offset=at)
    null = np.frombuffer(data, dtype=np.uint8, count=docs, offset=at + 8 * docs)
    counts = np.frombuffer(data, dtype="<u4", count=docs, offset=at + 9 * docs).astype(np.int64)

    def get(offset: np.ndarray, n: int, kind: str) -> np.ndarray:
        return np.ascontiguousarray(raw[offset[:, None] + np.arange(n)]).view(kind)

    base, width = get(start, 4, "<u4")[:, 0], raw[start + 4].astype(np.int64)
    patches = get(start + 5, 2, "<u2")[:, 0].astype(np.int64)
    table = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            table[rows] = _unpacked(get(start[rows] + _HEAD, int(w) * (BLOCK // 8), "<u4"), int(w))
    row = np.repeat(np.arange(blocks), patches)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
    tail = start + _HEAD + width * (BLOCK // 8)
    if len(row):
        place = raw[tail[row] + nth]
        table[row, place] = get(tail[row] + patches[row] + 4 * nth, 4, "<u4")[:, 0]
    table += base[:, None]
    return table.reshape(-1)[:total], [None if n else int(k) for k, n in zip(known, null, strict=True)], counts
