"""Operator 6: byte-level BPE, encoded in linear time by backtracking, and decoded.

Bytes become Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds every token that
occurs in a piece. The encoder takes the longest token at each place and keeps a sequence only while all its
neighbours are *compatible*: merging the two tokens' bytes in rank order would leave exactly these two. Any
prefix of a BPE result is itself the BPE result of its bytes, so a sequence of compatible neighbours is the
answer; a dead end steps back to the next shorter token. Each place is given up at most once.

Nulls encode as empty texts (no ids). Texts of any length are kept whole. Repeated rows and ties cannot
differ: a text alone decides its ids. Other columns are passed through untouched when named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.pieces import PieceCache, encode_texts

PAIRS_REMEMBERED = 500_000


class Encoder:
    def __init__(self, ranks_file: str):
        with open(ranks_file, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in pairs}
        self.text = {r: t for t, r in self.rank.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._compatible: dict[tuple[int, int], bool] = {}
        self._learn_halves()
        self.shorter = {r: self._shorter(t) for t, r in self.rank.items() if r in self.halves}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            if r in self.halves:
                self.automaton.add_word(t, (r, len(t)))
        self.automaton.make_automaton()
        width = max(self.rank.values()) + 1
        sizes = np.zeros(width, dtype=np.int64)
        for r, t in self.text.items():
            sizes[r] = len(t)
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer("".join(self.text.get(r, "") for r in range(width)).encode("latin-1"), dtype=np.uint8)
        self.cache = PieceCache(self._encode_new)

    def _learn_halves(self) -> None:
        """The last merge that makes each token; a token that merging never makes gets none and is never used."""
        for r in sorted(self.text):
            t = self.text[r]
            if len(t) == 1:
                self.halves[r] = (r, r)
                continue
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                # Both parts must be made earlier and stay apart until this merge.
                if a in self.halves and b in self.halves and self._stay_apart(a, b):
                    self.halves[r] = (a, b)
                    self.merged[a, b] = r
                    break
        self._compatible.clear()

    def _shorter(self, t: str) -> int | None:
        for n in range(len(t) - 1, 0, -1):
            r = self.rank.get(t[:n])
            if r in self.halves:
                return r
        return None

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and then ``b`` in rank order never merges across their border."""
        left, right, before = a, b, len(self.text) + len(self.rank)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            # Undo the later of the two merges at the border; a tie undoes the right side first.
            whole_left, whole_right = self.halves[left][0] == left, self.halves[right][0] == right
            if whole_left and whole_right:
                return True
            if not whole_left and (whole_right or left > right):
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]

    def compatible(self, a: int, b: int) -> bool:
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) >= PAIRS_REMEMBERED:
                self._compatible.clear()
            known = self._compatible[a, b] = self._stay_apart(a, b)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        longest = {}
        for end, (r, n) in self.automaton.iter(piece):
            start = end - n + 1
            if start not in longest or n > longest[start][1]:
                longest[start] = (r, n)
        size, out, place, dead = len(piece), [], 0, set()
        token = longest[0][0]
        while place < size:
            last = out[-1] if out else None
            while token is not None:
                end = place + len(self.text[token])
                if end not in dead and (last is None or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token is None:
                dead.add(place)
                last = out.pop()
                place -= len(self.text[last])
                token = self.shorter[last]
                while token is None:  # the token before has no shorter form either
                    dead.add(place)
                    last = out.pop()
                    place -= len(self.text[last])
                    token = self.shorter[last]
                continue
            out.append(token)
            place = end
            token = longest[place][0] if place < size else None
        return out

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        return [array("I", self.encode_piece(p.encode("utf-8").decode("latin-1"))).tobytes() for p in pieces]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return encode_texts(texts, self.cache)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, one after the other."""
        each = self.sizes[ids]
        done = np.cumsum(each)
        total = int(done[-1]) if len(done) else 0
        return self.bytes[np.arange(total) + np.repeat(self.begins[ids] - (done - each), each)]


@cache
def encoder(ranks_file: str) -> Encoder:
    """One per Python worker."""
    return Encoder(ranks_file)


def bpe_round_trip(docs: DataFrame, ranks_file: str, keep: Sequence[str] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep`` plus ``n_tokens, ids_sha256, decoded_sha256`` of every whole text, and ``ids`` when asked for.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` over the bytes
    that the ids decode to. No shuffle: every row is encoded where it is read.
    """
    kept = [docs.schema[c] for c in keep]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    schema = T.StructType([*(T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_file)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for begin in range(0, len(texts), 500):
                part = texts[begin : begin + 500]
                ids, counts = own.encode(part)
                stops = np.cumsum(counts)
                rows = [ids[e - n : e] for e, n in zip(stops.tolist(), counts.tolist(), strict=True)]
                shas = [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]
                back = [hashlib.sha256(own.decode(r).tobytes()).hexdigest() for r in rows]
                columns = [batch.column(i).slice(begin, len(part)) for i in range(len(kept))]
                columns += [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    columns.append(pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    narrow = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    done = narrow.mapInArrow(run, schema)
    return done.toDF(*keep, *[f.name for f in fields])
