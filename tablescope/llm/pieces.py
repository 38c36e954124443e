"""Cutting texts into the pieces that byte-level BPE merges within, a batch of texts at a time.

The cuts are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
found with array operations on code points instead of a pattern engine. A batch repeats few different
pieces many times, so the encoders below look at each different piece once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache

import numpy as np

from tablescope.llm.identity import equal_groups

CHARS_PER_CHUNK = 500_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
# The code points with the property White_Space.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def _classes() -> np.ndarray:
    first = {"L": _LETTER, "N": _NUMBER}
    table = np.array([first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], dtype=np.uint8)
    table[list(_WHITE)] = _SPACE
    return table


@cache
def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.full(size, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


@cache
def _inverse_powers(size: int) -> np.ndarray:
    return np.cumprod(np.full(size, pow(0x9E3779B97F4A7C15, -1, 1 << 64), dtype=np.uint64))


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` in a row, and the place where each text starts (one more entry for the end)."""
    # Lone surrogates do not occur in UTF-8 columns.
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    return joined, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Ascending places where pieces start; every text starts a piece."""
    size = len(points)
    if size == 0:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[points]
    new_text = np.zeros(size + 1, dtype=bool)
    new_text[text_starts] = True
    edge = new_text.copy()
    edge[1:size] |= kind[1:] != kind[:-1]
    edge[size] = True
    run = np.flatnonzero(edge[:size])
    end = np.append(run[1:], size)
    of = kind[run]
    start = edge[:size].copy()
    # White space before something else in the same text: its last character stands alone or, if a blank, leads.
    lead = (of == _SPACE) & ~new_text[end]
    last = end[lead] - 1
    start[last] = True
    blank = last[points[last] == 0x20]
    start[blank + 1] = False
    # An apostrophe alone, not led by a blank, takes the ending after it.
    mark = (of == _OTHER) & (end - run == 1) & (points[run] == 0x27) & start[run] & ~new_text[end]
    mark[:-1] &= of[1:] == _LETTER
    mark[-1:] = False
    which = np.flatnonzero(mark)
    if len(which):
        at, stop = end[which], end[which + 1]
        a = points[at]
        b = np.where(at + 1 < stop, points[np.minimum(at + 1, size - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        took = np.where(one, 1, np.where(two, 2, 0))
        hit = took > 0
        start[at[hit]] = False
        rest = (at + took)[hit & (at + took < stop)]
        start[rest] = True
    return np.flatnonzero(start)


def chunks(texts: Sequence[str], chars: int = CHARS_PER_CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters each; a text is never cut."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class PieceCache:
    """Ids (as bytes) of pieces this worker has seen lately: at most ``2 * limit`` of them, the longest unused go first."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for p in pieces:
            if p not in young:
                known = old.get(p)
                if known is None:
                    new.append(p)
                else:
                    young[p] = known
        if new:
            young.update(zip(new, self.encode(new), strict=True))
        return [young[p] for p in pieces]


def encode_texts(texts: Sequence[str], cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each text has.

    Equal pieces of a chunk are found by a hash of their code points and then compared point by point.
    """
    ids, counts = [], []
    for begin, stop in chunks(texts):
        part = texts[begin:stop]
        points, text_starts = code_points(part)
        starts = piece_starts(points, text_starts)
        if len(starts) == 0:
            counts.append(np.zeros(len(part), dtype=np.int64))
            continue
        ends = np.append(starts[1:], len(points))
        room = 1 << max(19, int(len(points)).bit_length())
        keyed = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * _powers(room)[: len(points)], out=keyed[1:])
        h = _mixed((keyed[ends] - keyed[starts]) * _inverse_powers(room)[starts])
        first, which = equal_groups(points, starts, ends, h)
        whole = "".join(part)
        found = cache.of([whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        sizes = np.array([len(f) for f in found], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(found), dtype=np.uint32)
        begins = np.cumsum(sizes) - sizes
        each = sizes[which]
        done = np.cumsum(each)
        place = np.arange(done[-1]) + np.repeat(begins[which] - (done - each), each)
        ids.append(flat[place])
        per_text = np.concatenate([[0], done])[np.searchsorted(starts, text_starts)]
        counts.append(np.diff(per_text))
    return (
        np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32),
        np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64),
    )


class AddedTokens:
    """Plain tokens that stand in a text by name and give their own ids, whatever is around them."""

    def __init__(self, ids: Mapping[str, int]):
        self.ids = {content: np.array([i], dtype=np.uint32) for content, i in ids.items()}
        # Where two begin at one place, the longer is taken.
        self.cut = re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None

    def encode(self, texts: Sequence[str], cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has: text between added tokens is ordinary."""
        if self.cut is None or not any(self.cut.search(t) for t in texts):
            return encode_texts(texts, cache)
        parts: list[str] = []
        order: list[list[str | int]] = []  # of every text: added tokens, and numbers of parts
        for t in texts:
            at, own = 0, []
            for m in self.cut.finditer(t):
                own += [len(parts), m[0]]
                parts.append(t[at : m.start()])
                at = m.end()
            order.append([*own, len(parts)])
            parts.append(t[at:])
        ids, counts = encode_texts(parts, cache)
        stops = np.cumsum(counts)
        rows = [np.concatenate([self.ids[x] if isinstance(x, str) else ids[stops[x] - counts[x] : stops[x]] for x in own]) for own in order]
        return np.concatenate(rows), np.array([len(r) for r in rows], dtype=np.int64)
