"""Rolling medians over the batches of a sorted block; rows of the neighbouring blocks come with its first row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

CELLS = 2_000_000  # values of windows that are held at once


def rolling_median(values: np.ndarray, window: int) -> np.ndarray:
    """Centred medians of the values that are no NaN; NaN where fewer than half a window, or three, are there."""
    back, ahead = window // 2, (window - 1) // 2
    padded = np.concatenate([np.full(back, np.nan), values, np.full(ahead, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, window)
    out = np.full(len(values), np.nan)
    step = max(1, CELLS // window)
    for begin in range(0, len(values), step):
        part = np.sort(windows[begin : begin + step], axis=1)  # NaN last
        n = np.count_nonzero(~np.isnan(part), axis=1)
        enough = np.flatnonzero(n >= max(3, window // 2))
        low, high = part[enough, (n[enough] - 1) // 2], part[enough, n[enough] // 2]
        with np.errstate(invalid="ignore"):
            out[begin + enough] = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return out


def block_scores(block: str, kept: Sequence[str], values: Sequence[str], window: int, halo: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``, rows sorted by ``block`` and place: place, the ``kept`` columns, and of each value itself, its rolling median and that of the distances to it."""

    def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False).astype(float)

    def border(rows: list | None) -> np.ndarray:
        cells = [[np.nan if x is None else x for x in r] for r in rows or []]
        return np.array(cells, dtype=float).reshape(len(cells), len(values))

    def scored(place: int, rows: pa.Table, left: np.ndarray, own: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        begin, end = len(left), len(left) + len(own)
        around = np.concatenate([left, own, right])
        columns = [pa.array(np.arange(place, place + len(own)), pa.int64()), *[rows.column(k).combine_chunks() for k in kept]]
        for i in range(len(values)):
            v = around[:, i]
            middle = rolling_median(v, window)
            with np.errstate(invalid="ignore"):
                spread = rolling_median(np.abs(v - middle), window)
            columns += [pa.array(x[begin:end], pa.float64(), from_pandas=True) for x in (v, middle, spread)]
        return pa.RecordBatch.from_arrays(columns, names=["position", *kept, *[f"{p}{v}" for v in values for p in ("", "_m", "_s")]])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches cut where a block ends."""
        for batch in batches:
            homes = batch.column(block).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(homes[1:] != homes[:-1]) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, place, left, after, waiting, own = None, 0, border(None), border(None), None, border(None)
        for batch in pieces(batches):
            fresh = np.column_stack([column(batch, v) for v in values])
            table = pa.Table.from_batches([batch]).select(list(kept))
            if waiting is not None and batch.column(block)[0].as_py() != home:
                yield scored(place, waiting, left, own, after)
                waiting = None
            if waiting is None:
                home, place = batch.column(block)[0].as_py(), batch.column("_first")[0].as_py()
                left, after = border(batch.column("_before")[0].as_py()), border(batch.column("_after")[0].as_py())
            elif len(fresh) < halo:
                # Too few rows for what lies before them: they join it.
                fresh, table = np.concatenate([own, fresh]), pa.concat_tables([waiting, table])
            else:
                yield scored(place, waiting, left, own, fresh[:halo])
                place, left = place + len(own), np.concatenate([left, own])[-halo:]
            waiting, own = table, fresh
        if waiting is not None:
            yield scored(place, waiting, left, own, after)

    return run
