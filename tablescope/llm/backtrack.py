"""Operator 11: BPE by a list of merges, encoded by backtracking over longest matches, and decoded by an offset table.

A tokenizer file names the tokens and the merges that make them. An Aho-Corasick automaton over the tokens gives the
longest token at every place of a piece. Tokens are laid one after the other, longest first, as long as each pair of
neighbours is *compatible*: merging the letters of both together leaves exactly these two. Sequences of compatible
neighbours are what merging gives, so the first one that reaches the end is the answer. Where no token fits, the last one
is taken back and its next shorter prefix is tried; a place that was given up is never tried again, so a piece costs
time in proportion to its length.

Compatibility is looked up in a table that is filled as pairs turn up. A pair is settled from the two tokens' edges: what
stands left and right of their border while they are being merged, and between which merges. If ever a merge of the two
edges would come before either of them goes on, the border would have been lost.

Decoding gathers bytes: all tokens' bytes stand in one row, with the place where each begins.

Null texts count as empty and have no ids. Texts of any length are read whole. A text alone decides its ids, so repeated
rows and ties agree. Names of added tokens in a text give the added token, as the library does by itself; truncation and
padding of the file are not used. An empty table gives an empty result. Columns other than the text and those in ``keep``
are not read, whatever they are called. Files with rules this encoder does not know (a normaliser, dropout, unknown or
continuing tokens, added tokens that need white space or whole words) are refused.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.pieces import AddedTokens, PieceCache

TABLE_ENTRIES = 500_000
_TEXTS_AT_ONCE = 500
_NEVER = 1 << 60


@cache
def _letters() -> str:
    """The letter that stands for each byte in such files: printable bytes for themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


def _refused(spec: dict) -> str | None:
    """Why a tokenizer file is not one this encoder reproduces."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return "model"
    if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        return "pre_tokenizer"
    if spec.get("normalizer"):
        return "normalizer"
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return "added_tokens"
    return None


class Merger:
    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as lines:
            spec = json.load(lines)
        why = _refused(spec)
        if why:
            raise ValueError(f"{tokenizer_file}: {why} not supported")
        self.id: dict[str, int] = spec["model"]["vocab"]
        self.name = {i: t for t, i in self.id.items()}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: Of two neighbours: when they are merged.
        self.when = {}
        for turn, (a, b) in enumerate(merges):
            self.when.setdefault((self.id[a], self.id[b]), turn)
        # What stands at the left and right end of a token while it is made, latest first, and the turn it appears at.
        self.left = {i: [(i, -1)] for t, i in self.id.items() if len(t) == 1}
        self.right = dict(self.left)
        self.table: dict[int, bool] = {}
        for turn, (a, b) in enumerate(merges):
            x, y, made = self.id[a], self.id[b], self.id[a + b]
            # A token whose parts would not come to stand beside each other is never made this way.
            if made not in self.left and x in self.left and y in self.left and self._apart(x, y, turn):
                self.left[made] = [(made, turn), *self.left[x]]
                self.right[made] = [(made, turn), *self.right[y]]
        usable = {t: i for t, i in self.id.items() if i in self.left}
        self.size = {i: len(t) for t, i in usable.items()}
        self.shorter = {i: next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), -1) for t, i in usable.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.usable = usable
        self.of_bytes = str.maketrans({b: c for b, c in enumerate(_letters())})
        self.added = AddedTokens({t["content"]: t["id"] for t in spec["added_tokens"]})
        self._lay_out_bytes({t["id"]: t["content"] for t in spec["added_tokens"]})
        self.pieces = PieceCache(lambda new: [array("I", self.piece(p)).tobytes() for p in new])

    def _lay_out_bytes(self, added: dict[int, str]) -> None:
        back = {c: b for b, c in enumerate(_letters())}
        known = {i: bytes(back[c] for c in t) for i, t in self.name.items()} | {i: c.encode() for i, c in added.items()}
        row = [known.get(i, b"") for i in range(max(known) + 1)]
        self.offset = np.concatenate([[0], np.cumsum([len(r) for r in row])]).astype(np.int64)
        self.row = np.frombuffer(b"".join(row), dtype=np.uint8)

    def _apart(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether ``a`` and ``b`` come to stand beside each other and stay so until turn ``before``."""
        left, right = self.right[a], self.left[b]
        i = j = 0
        until_left = until_right = before
        # From the last state of the border back to the first.
        while True:
            turn = self.when.get((left[i][0], right[j][0]), _NEVER)
            # Of equal merges the leftmost comes first: one at the left end goes before the border, one at the right end after it.
            if turn < until_left and (turn < until_right or (turn == until_right and j > 0)):
                return False
            if left[i][1] > right[j][1]:
                until_left = left[i][1]
                i += 1
            elif right[j][1] >= 0:
                until_right = right[j][1]
                j += 1
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            known = self.table[key] = self._apart(a, b)
        return known

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece of text."""
        letters = piece.encode("utf-8").decode("latin-1").translate(self.of_bytes)
        whole = self.usable.get(letters)
        if whole is not None:
            return [whole]
        total = len(letters)
        longest, reach = [-1] * total, [0] * total
        for end, (i, n) in self.automaton.iter(letters):
            if n > reach[end - n + 1]:
                longest[end - n + 1], reach[end - n + 1] = i, n
        open_ends = bytearray(b"\1") * (total + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < total:
            while token >= 0 and not (open_ends[at + self.size[token]] and (not out or self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.size[token]
                token = longest[at] if at < total else -1
            else:
                open_ends[at] = 0
                last = out.pop()
                at -= self.size[last]
                token = self.shorter[last]
        return out

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        return self.added.encode(texts, self.pieces)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids one after the other; as text they are read with replacement of what is not UTF-8."""
        begin = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - begin
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        return self.row[np.arange(total) + np.repeat(begin - (done - size), size)].tobytes()


@cache
def merger(tokenizer_file: str) -> Merger:
    """One per Python worker."""
    return Merger(tokenizer_file)


def encode_decode(
    docs: DataFrame, tokenizer_file: str, keep: Sequence[str] = ("doc_id",), text: str = "text", with_ids: bool = False, with_text: bool = False
) -> DataFrame:
    """``keep`` plus ``n_tokens, ids_sha256, decoded_sha256`` of every whole text; ``ids`` and ``decoded`` when asked for.

    Digests are over the ids as little-endian unsigned 32-bit integers and over the decoded text in UTF-8. Every row is
    worked on where it is read: no shuffle.
    """
    kept = [docs.schema[c] for c in keep]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []
    fields += [T.StructField("decoded", T.StringType())] if with_text else []
    schema = T.StructType([*(T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(tokenizer_file)
        for batch in batches:
            for begin in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(begin, _TEXTS_AT_ONCE)
                ids, counts = own.encode(part.column(len(kept)).to_pylist())
                rows = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
                back = [own.decode(r).decode("utf-8", "replace").encode("utf-8") for r in rows]
                columns = [part.column(i) for i in range(len(kept))]
                columns += [pa.array(counts, pa.int64()), pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows], pa.string())]
                columns.append(pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()))
                if with_ids:
                    columns.append(pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())))
                if with_text:
                    columns.append(pa.array([b.decode("utf-8") for b in back], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    narrow = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    return narrow.mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])
