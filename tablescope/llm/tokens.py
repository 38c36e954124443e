"""Operator 2: token ids of a corpus in binary files, in document order.

Texts are dealt into ranges of ``doc_id`` once; each task encodes its ranges in order and rolls files of packed
ids (``pfor``), which reach their names only when whole. A manifest, one row per file, is what readers go by.

Null texts count as empty: they give the end id alone. Null ids come first; rows with equal ids follow each other
in the order of their texts, and repeated rows are all kept. No rows give an empty manifest. Columns beside the
two named ones are never read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.files import commit_file, read_file
from tablescope.llm.pfor import pack, unpack
from tablescope.llm.pieces import AddedTokens, PieceCache
from tablescope.llm.ranges import borders, dealt, with_shard
from tablescope.llm.scratch import Scratch

IDS_PER_FILE = 4_000_000
ROWS_PER_SHARD = 4096
_MANIFEST = "shard int, seq int, name string, docs long, ids long, bytes long"


class _Encoder:
    """The tokenizer of a file: ordinary text piece by piece, and its added tokens by their own ids if ``added``."""

    def __init__(self, tokenizer_file: str, added: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as lines:
            tokens = json.load(lines)["added_tokens"] if added else []
        self.whole = None
        # The cuts below are plain searches; with tokens of other rules, texts go to the library as they are.
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
            self.whole = Tokenizer.from_file(tokenizer_file)
        self.added = AddedTokens({t["content"]: t["id"] for t in tokens})
        own.encode_special_tokens = True  # what is left between the cuts is ordinary text

        def encode(pieces: list[str]) -> list[bytes]:
            # The library splits texts into the same pieces and merges within each alone: one call, split by piece afterwards.
            done = own.encode(pieces, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(done.ids, dtype=np.uint32)
            ends = np.cumsum(np.bincount(np.array(done.word_ids, dtype=np.int64), minlength=len(pieces))) * 4
            flat = ids.tobytes()
            return [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]

        self.pieces = PieceCache(encode)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if self.whole is not None:
            rows = [np.array(e.ids, dtype=np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(rows), np.array([len(r) for r in rows], dtype=np.int64)
        return self.added.encode(texts, self.pieces)


@cache
def _encoder(tokenizer_file: str, added: bool) -> _Encoder:
    return _Encoder(tokenizer_file, added)


def write_token_files(
    docs: DataFrame, scratch: Scratch, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    ids_per_file: int = IDS_PER_FILE, added_tokens: bool = False,
) -> tuple[str, DataFrame]:
    """The folder of the files, and the manifest with ``first``: the ids of all files before each.

    With ``added_tokens`` the names of the tokenizer's added tokens in a text give their ids, as the library does unless
    told otherwise; without, they are ordinary text.
    """
    folder = scratch.files("ids")
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    ordered = dealt(with_shard(narrow, "d", borders(narrow, "d", ROWS_PER_SHARD)), ["d", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, seq, held, size = _encoder(tokenizer_file, added_tokens), None, 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            counts = np.concatenate([h[2] for h in held])
            keys = [d for h in held for d in h[0]]
            name = f"ids-{shard:05d}-{seq:05d}.pfor"
            written = commit_file(folder, name, [pack(ids, keys, counts)])
            row = {"shard": [shard], "seq": [seq], "name": [name], "docs": [len(keys)], "ids": [len(ids)], "bytes": [written]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            keys, texts, shards = (batch.column(i).to_pylist() for i in (0, 1, 2))
            begin = 0
            while begin < len(keys):
                stop, chars = begin + 1, len(texts[begin])
                while stop < len(keys) and stop - begin < 200 and shards[stop] == shards[begin] and chars + len(texts[stop]) <= ids_per_file:
                    chars += len(texts[stop])
                    stop += 1
                if held and (shards[begin] != shard or size >= ids_per_file):
                    yield close()
                    seq, held, size = (seq + 1 if shards[begin] == shard else 0), [], 0
                shard = shards[begin]
                ids, counts = own.encode(texts[begin:stop])
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                held.append((keys[begin:stop], ids, counts + 1))
                size += len(ids)
                begin = stop
        if held:
            yield close()

    manifest = scratch.write(ordered.mapInArrow(run, _MANIFEST), "manifest")
    # One row per shard, then per file of a shard: no window over the files of the whole corpus.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = manifest.join(shards, "shard").withColumn("first", F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).drop("before")
    return folder, placed


def read_token_files(folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, when asked for, ``ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, keys, counts = unpack(read_file(folder, name))
                stops = np.cumsum(counts)
                rows = [ids[e - n : e].astype("<u4") for e, n in zip(stops.tolist(), counts.tolist(), strict=True)]
                columns = [
                    pa.array(keys, pa.int64()), pa.array(first + stops - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # A given number of tasks: adaptive execution would see a tiny table and read all files in one.
    files = max(1, min(manifest.count(), 20_000))
    return manifest.select("name", "first").repartition(files, "name").mapInArrow(run, schema)
