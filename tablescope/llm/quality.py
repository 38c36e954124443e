"""Operator 5: a quality classifier of naive Bayes support vectors.

Features of a text are indicators of n-grams: single words and pairs of words in lower case, shapes of words (runs of
capitals, of small letters and of digits shortened to one, other signs as they are) alone and in pairs, and runs of one
word repeated 2, 3, 4 and 8 times. ``linear.fit`` scales them by log-count ratios and fits the hinge-loss model.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hashes of their ids; every text is then
scored whole where it is read. Null and empty texts have no features: their score is that of a margin of 0. Labels that
are null are left out; without labels, or with one class alone, all texts score its smoothed share. Repeated rows score alike; a
repeated label counts as often as it occurs. Columns beside the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.linear import Model, fit, folded, per_text
from tablescope.llm.scan import Hasher, chunks, mixed, words
from tablescope.llm.workers import give_back

SAMPLE = 8_000
_SALTS = mixed(np.arange(1, 9, dtype=np.uint64))


def _shape_table() -> np.ndarray:
    kind = np.arange(256)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 65, 97, 48, 97
    return kind.astype(np.uint8)


_SHAPE = _shape_table()


def quality_features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end, text = words(raw, starts)
    if len(begin) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = Hasher(raw).of(begin, end)
    kind = _SHAPE[raw]
    kept = np.ones(len(raw), dtype=bool)
    kept[1:] = (kind[1:] != kind[:-1]) | ~np.isin(kind[1:], (65, 97, 48))
    kept[begin] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shape = Hasher(kind[kept]).of(place[begin], place[end])
    next_to = text[1:] == text[:-1]
    same = np.zeros(len(word), dtype=np.int64)
    again = np.flatnonzero(~np.concatenate([[False], (word[1:] == word[:-1]) & next_to]))
    same = np.arange(len(word)) - again[np.searchsorted(again, np.arange(len(word)), side="right") - 1]
    texts, features = [text, text], [word ^ _SALTS[0], shape ^ _SALTS[1]]
    for h, salt in ((word, _SALTS[2]), (shape, _SALTS[3])):
        texts.append(text[1:][next_to])
        features.append((mixed(h[:-1] + salt) + h[1:])[next_to])
    for i, n in enumerate((2, 3, 4, 8)):
        hit = text[same >= n - 1]
        texts.append(hit)
        features.append(np.full(len(hit), n, dtype=np.uint64) * _SALTS[4 + i])
    return per_text(np.concatenate(texts), folded(mixed(np.concatenate(features))))


Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def fitted(docs: DataFrame, labels: DataFrame, label: str, usable: Column, features: Features, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, cost: float = 1.0) -> Model:
    """A model of ``label`` from at most ``sample`` labelled rows for which ``usable`` (a test of the column ``id``) holds."""
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & usable)
    chosen = marked.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("id"))  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, raw, starts in chunks(batch.column(1)):
                at, found = features(raw, starts)
                border = np.searchsorted(at, np.arange(stop - begin + 1))
                lists = [found[a:b].astype(np.int32) for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]
                part = batch.slice(begin, stop - begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lists, pa.list_(pa.int32()))], names=["d", "y", "f"])

    kind = rows.schema["d"].dataType.simpleString()
    model = _model(rows.select("d", "t", "y").mapInArrow(run, f"d {kind}, y int, f array<int>"), cost)
    give_back()
    return model


def _model(sample: DataFrame, cost: float) -> Model:
    table = sample.toArrow()
    if table.num_rows == 0:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    table = table.take(pa.compute.sort_indices(table, [("d", "ascending"), ("y", "ascending")])).combine_chunks()
    lists, label = table["f"].chunk(0), table["y"].to_numpy().astype(np.int64)
    del table
    sizes = np.diff(lists.offsets.to_numpy())
    return fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), lists.values.to_numpy(), label, cost)


def scored(docs: DataFrame, model: Model, features: Features, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``score`` of every whole text; no shuffle."""
    narrow = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, raw, starts in chunks(batch.column(len(keep))):
                at, found = features(raw, starts)
                score = model.scores(model.margins(at, found, stop - begin))
                columns = [batch.column(i).slice(begin, stop - begin) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], names=schema.names)

    return narrow.mapInArrow(run, schema).toDF(*keep, "score")


def quality_scores(
    docs: DataFrame, train_docs: DataFrame, labels: DataFrame, usable: Column, keep: Sequence[str] = ("doc_id",), label: str = "quality", text: str = "text"
) -> DataFrame:
    """``keep`` and ``score`` (0 to 1, higher: label 1 likelier) of every row of ``docs``."""
    return scored(docs, fitted(train_docs, labels, label, usable, quality_features, text=text), quality_features, keep, text)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))
