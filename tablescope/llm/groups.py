"""Rows sorted by a key, handed on group by group inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS_AT_ONCE = 20_000


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches in which every group of equal ``key`` is whole; many small groups come together."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                yield joined()
                held = []
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(change):
            cut = int(change[-1])
            held.append(batch.slice(0, cut))
            yield joined()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield joined()


def borders(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys)) if len(keys) else np.zeros(1, dtype=np.int64)


class Forest:
    """Which of ``size`` things are connected so far."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Connects them under the smaller root; false if they were connected."""
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], dtype=np.int64)
