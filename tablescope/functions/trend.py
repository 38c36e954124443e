"""Sums of a line over places in time order, over the batches of a sorted block."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(keys: Sequence[pa.Array]) -> np.ndarray:
    """Which rows differ from the one before in any of the key columns; nulls are equal, and so is what is no number."""
    n = len(keys[0])
    out = np.ones(n, dtype=bool)
    out[1:] = False
    for key in keys:
        a, b = key.slice(0, n - 1), key.slice(1)
        try:
            other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        except pa.ArrowNotImplementedError:
            cells = key.to_pylist()
            other = np.array([x != y for x, y in zip(cells, cells[1:])], dtype=bool)
        if pa.types.is_floating(key.type):
            other &= ~(pc.fill_null(pc.is_nan(a), False).to_numpy(zero_copy_only=False) & pc.fill_null(pc.is_nan(b), False).to_numpy(zero_copy_only=False))
        gone = key.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= other | (gone[1:] != gone[:-1])
    return out


class _Sums:
    """A column's values of a block in their order, added up: centred, so that nothing is lost where there are many."""

    def __init__(self) -> None:
        self.n, self.mean_x, self.mean_y, self.sxx, self.sxy, self.syy = 0, 0.0, 0.0, 0.0, 0.0, 0.0
        self.low = self.high = self.first_value = self.last_value = None

    def add(self, y: np.ndarray) -> None:
        if not len(y):
            return
        m, n = len(y), self.n
        x = np.arange(m, dtype=np.float64) - (m - 1) / 2.0
        mean = float(y.mean())
        d = y - mean
        dx, dy, w = n + (m - 1) / 2.0 - self.mean_x, mean - self.mean_y, n * m / (n + m)
        self.sxx += m * (m * m - 1.0) / 12.0 + w * dx * dx
        self.sxy += float(x @ d) + w * dx * dy
        self.syy += float(d @ d) + w * dy * dy
        self.mean_x += dx * m / (n + m)
        self.mean_y += dy * m / (n + m)
        low, high = float(y.min()), float(y.max())
        self.low, self.high = (low, high) if not n else (min(low, self.low), max(high, self.high))
        self.first_value = float(y[0]) if not n else self.first_value
        self.last_value, self.n = float(y[-1]), n + m


def block_fits(block: str, keys: Sequence[str], values: Sequence[str], sums: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``, rows sorted by ``block``, ``keys`` and ``values``: one row of sums per block and column, and the first and last rows of equal keys."""
    kept = [*keys, *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: pa.Schema | None = None

        def loose(home: int, side: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in rows.combine_chunks().to_batches():
                n = part.num_rows
                columns = [pa.array(np.full(n, home), pa.int64()), pa.array(np.full(n, side), pa.int32()), pa.nulls(n, pa.int32()), *[part.column(k) for k in kept]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, pa.int64() if s == "n" else pa.float64()) for s in sums]], names=names)

        def told(home: int, found: Sequence[_Sums]) -> pa.RecordBatch:
            n = len(found)
            columns = [pa.array(np.full(n, home), pa.int64()), pa.array(np.full(n, 1), pa.int32()), pa.array(np.arange(n), pa.int32()), *[pa.nulls(n, schema.field(k).type) for k in kept]]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([getattr(f, s) for f in found], pa.int64() if s == "n" else pa.float64()) for s in sums]], names=names)

        def added(found: Sequence[_Sums], rows: pa.Table, new: np.ndarray) -> None:
            # Only rows that share their keys with a neighbour can change places.
            run_of = np.cumsum(new)
            shared = np.flatnonzero(~new | np.append(~new[1:], False))
            for name, column in zip(values, found, strict=True):
                v = rows.column(name).to_numpy().astype(float)
                if len(shared):
                    v = v.copy()
                    v[shared] = v[shared][np.lexsort((v[shared], run_of[shared]))]
                column.add(v[np.isfinite(v)])

        names = [block, "side", "c", *kept, *sums]
        # ``held`` are the rows of the last keys so far: they may go on.
        home, found, held, opening = None, [], [], True
        for batch in batches:
            homes = batch.column(block).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(homes[1:] != homes[:-1]) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                schema = part.schema
                if homes[begin] != home:
                    if home is not None:
                        yield from loose(home, 0 if opening else 2, pa.concat_tables(held))
                        yield told(home, found)
                    home, found, held, opening = int(homes[begin]), [_Sums() for _ in values], [], True
                rows = pa.Table.from_batches([part]).select(kept)
                seen = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows]) if held else rows
                new = changes([seen.column(k).combine_chunks() for k in keys])[1 if held else 0 :]
                starts = np.flatnonzero(new)
                if held and len(starts):
                    ended = pa.concat_tables([*held, rows.slice(0, int(starts[0]))])
                    if opening:
                        yield from loose(home, 0, ended)
                        opening = False
                    else:
                        added(found, ended, np.arange(ended.num_rows) == 0)
                    held = []
                elif not held and len(starts) > 1:
                    yield from loose(home, 0, rows.slice(0, int(starts[1])))
                    starts, opening = starts[1:], False
                if len(starts):
                    first, last = int(starts[0]), int(starts[-1])
                    if last > first:
                        added(found, rows.slice(first, last - first), new[first:last])
                    rows = rows.slice(last)
                held.append(rows)
                if opening:
                    # All rows so far are the first ones; the last of them is enough to see where they end.
                    rows = pa.concat_tables(held)
                    yield from loose(home, 0, rows.slice(0, rows.num_rows - 1))
                    held = [rows.slice(rows.num_rows - 1)]
        if home is not None:
            yield from loose(home, 0 if opening else 2, pa.concat_tables(held))
            yield told(home, found)

    return run
