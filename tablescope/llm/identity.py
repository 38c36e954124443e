"""Which ranges of one array hold equal values: grouped by hash, then held against each other."""

from __future__ import annotations

import numpy as np

_STEPS = 12
_AT_ONCE = 4_000_000


def _equal(values: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``values[a : a + size]`` and ``values[b : b + size]`` agree, one answer a pair."""
    by_size = np.argsort(-np.minimum(size, _STEPS + 1).astype(np.int8), kind="stable")
    a, b, n = a[by_size], b[by_size], size[by_size]
    same = np.ones(len(a), dtype=bool)
    longer = len(a) - np.cumsum(np.bincount(np.minimum(n, _STEPS + 1), minlength=_STEPS + 2))
    for step in range(_STEPS):
        have = int(longer[step])
        if not have:
            break
        same[:have] &= values[a[:have] + step] == values[b[:have] + step]
    # What is longer than the steps: the rest of some ranges at a time, or a part of one very long range.
    rest, at = n[: longer[_STEPS]] - _STEPS, 0
    ends = np.cumsum(rest)
    while at < len(rest):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, side="right")))
        if stop == at + 1:
            left, right = (values[x[at] + _STEPS : x[at] + n[at]] for x in (a, b))
            same[at] &= bool((left == right).all())
        else:
            some = rest[at:stop]
            inner = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some) + _STEPS
            differs = values[np.repeat(a[at:stop], some) + inner] != values[np.repeat(b[at:stop], some) + inner]
            same[at:stop] &= ~np.logical_or.reduceat(differs, np.cumsum(some) - some)
        at = stop
    out = np.empty(len(a), dtype=bool)
    out[by_size] = same
    return out


def equal_groups(values: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A member of every group of equal ranges, and the group of every range.

    Ranges of equal hash are compared value by value with their group's member; one that differs becomes a group of its
    own. So the members of a group are always equal; equal ranges may sit in several groups where hashes collide.
    """
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    size = end - begin
    kept = first[which]
    same = size == size[kept]
    others = np.flatnonzero(same & (kept != np.arange(len(h))))
    same[others] = _equal(values, begin[others], begin[kept[others]], size[others])
    odd = np.flatnonzero(~same)
    if len(odd):
        which = which.copy()
        which[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return first, which
