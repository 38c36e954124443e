"""Records of CSV files whose quoted fields hold line breaks, read split by split.

Spark hands out the lines of a split; whether its first line stands inside a quoted field is known only from what lies before.

1. Every split says in one scan where it ends up, inside or outside quotes, for both ways in which it may begin.
2. One row per split and file: a running composition over the splits of a file gives the state in which each truly begins.
3. A second scan joins lines to records. The parts of a record that lies across borders, at most two a split, are put together
   by a shuffle of those parts alone.

No file is one task, and no task holds more than a record. A quoted field ends at a quote that is not doubled; a quote inside a
field that does not begin with one is a letter like others. A field that is never closed lasts to the end of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.plans.materialize import materialize, settled

BOM = b"\xef\xbb\xbf"
BATCH_BYTES = 4_000_000

_INSIDE = rb'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rb'(?:(?:"' + _INSIDE + rb'"[^,]*+|[^",][^,]*+)?+,)*+'
# A line that leaves a quoted field open, begun outside one and inside one; a line that closes the one it began in.
_OPENS = re.compile(_FIELDS + rb'"' + _INSIDE + rb"\Z")
_STAYS = re.compile(_INSIDE + rb"\Z")
_REOPENS = re.compile(_INSIDE + rb'"[^,]*+,' + _FIELDS + rb'"' + _INSIDE + rb"\Z")

_WHOLE, _TAIL, _HEAD = 0, 2, 1  # a record; the beginning of one at the end of a split; what a split begins with of an earlier one


def after(line: bytes, inside: bool) -> bool:
    """Whether the end of the line stands inside a quoted field."""
    if b'"' not in line:
        return inside
    if inside:
        return bool(_STAYS.match(line) or _REOPENS.match(line))
    return bool(_OPENS.match(line))


def _splits(spark: SparkSession, files: list[str]) -> DataFrame:
    # Only line feeds end a line here: what stands in quotes is kept as it is.
    return spark.read.option("lineSep", "\n").text(files).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, block, outside, inside``: the state after each split that began outside or inside."""
    key, state = None, (False, True)

    def row():
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "outside": [state[0]], "inside": [state[1]]})

    for batch in batches:
        for line, file, block in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
            if (file, block) != key:
                if key is not None:
                    yield row()
                key, state = (file, block), (False, True)
            if b'"' in line:
                state = tuple(after(line, s) for s in state)
    if key is not None:
        yield row()


def starts(lines: DataFrame) -> DataFrame:
    """``file, block, start``: whether each split begins inside a quoted field."""
    ends = settled(lines.mapInArrow(_ends, "file string, block long, outside boolean, inside boolean"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # A split turns the state round, leaves it, or sets it; the last that sets it and the turns since then tell the rest.
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(upto)
    sets = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "turns"))
    marked = ends.withColumn("turns", turns).withColumn("set", sets)
    last = marked.withColumns({"last": F.last("set", ignorenulls=True).over(before), "seen": F.coalesce(F.last("turns").over(before), F.lit(0))})
    odd = (F.col("seen") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    return last.select("file", "block", (F.coalesce("last.outside", F.lit(False)) != odd).alias("start"))


def _join(encoding: str):
    def text(line: list[bytes], first: bool) -> str:
        whole = b"\n".join(line)
        return (whole.removeprefix(BOM) if first else whole).decode(encoding, "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, key, held, inside, kind, top = 0, None, [], False, _WHOLE, False

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()), strict=True)],
                names=["file", "block", "kind", "top", "record"],
            )
            out, size = [], 0
            return batch

        def put(kind: int) -> None:
            nonlocal size, top, held
            record = text(held, key[1] == 0 and top)
            held = []
            if kind == _WHOLE:
                record = record.removesuffix("\r")
            if record or kind != _WHOLE:
                # The first record of a file is its header; blank lines are none.
                out.append((key[0], key[1], kind, top, record))
                size += len(record) + 64
                top = False

        for batch in batches:
            for line, file, block, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, block) != key:
                    if held:
                        put(_HEAD if kind == _HEAD else _TAIL)
                    if start is None:
                        raise RuntimeError(f"{file} was split differently when it was looked at first")
                    key, inside, top = (file, block), start, block == 0
                    kind = _HEAD if start else _WHOLE
                held.append(line)
                inside = after(line, inside)
                if not inside:
                    put(kind)
                    kind = _WHOLE
                if size > BATCH_BYTES:
                    yield flush()
        if held:
            put(_HEAD if kind == _HEAD else _TAIL)
        if out:
            yield flush()

    return run


def records(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """``top, record``: the records of the files as text, the header of each file marked ``top``."""
    lines = _splits(spark, files)
    known = starts(lines).withColumnsRenamed({"file": "f", "block": "b"})
    # However the join is made, the lines of a split stay together and are put back into their order.
    ready = lines.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left").sortWithinPartitions("file", "block", "place")
    made = ready.select("line", "file", "block", "start").mapInArrow(_join(encoding), "file string, block long, kind int, top boolean, record string")
    parts = materialize(made.filter(F.col("kind") != _WHOLE))
    owner = F.sum((F.col("kind") == _TAIL).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0))
    stitched = parts.withColumn("owner", owner).groupBy("file", "owner").agg(
        F.bool_or("top").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda x: x["record"]), "\n").alias("record"),
    )
    whole = made.filter(F.col("kind") == _WHOLE).select("top", "record")
    return whole.unionAll(stitched.select("top", F.regexp_replace("record", r"\r\z", "").alias("record")))
