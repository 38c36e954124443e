"""Operator 13: stretches of words that repeat with a period, by a dictionary of basic factors.

A basic factor is a stretch of ``2**k`` words. The dictionary names them so that equal factors of a text have equal
names: single words first, then each level from pairs of names of the level below. At every level the successor of a
place is the next place with the same name. A run of period ``q`` that is at least four periods long shows at the level
with ``q <= 2**k < 2 * q``: factors are then as long as a period and recur inside the run after exactly ``q`` words, no
sooner, because the run's root is no power of a shorter one. Their places are arithmetic progressions of step ``q``, one
beginning at each word of the run's first period, and together they make one stretch of places that all have their
successor ``q`` words on. So a stretch of places with one successor distance, extended by a factor and a period, is the
whole run with its smallest period, and no run is found twice. Only successors of at most ``2**k`` words are looked at.
Places whose factor does not recur in the text leave the dictionary, so levels end where nothing recurs.

Words are the runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return. They are told
apart as they are, not by hashes. Texts are read whole, a batch at a time; names are kept apart by text.

A null text, an empty one and one of white space have no words, no runs and an empty collapsed text. Null ids, repeated
rows and ties need nothing: a text alone decides its runs. An empty table gives an empty result. Columns other than the
text and those in ``keep`` are not read; names cannot clash with the result's, which come after them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS_AT_ONCE = 300_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(word: np.ndarray, owner: np.ndarray, periods: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs of at least ``periods`` periods and ``least`` words, by start, then period.

    ``word`` numbers the words of all texts in a row, ``owner`` their texts in ascending order; starts count from the first word of all.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods need not hold two factors as long as a period")
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none, none)]
    size, place = 1, np.arange(len(word))
    key = owner.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    name = np.full(len(word), -1, dtype=np.int64)
    while len(place) > 1:
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        same, step = key[1:] == key[:-1], np.diff(place)
        near = same & (step <= size) & (2 * step > size)
        if near.any():
            found.append(_stretches(place[:-1][near], step[near], size, periods, least))
        recurs = np.zeros(len(key), dtype=bool)
        recurs[1:] |= same
        recurs[:-1] |= same
        name[:] = -1
        name[place[recurs]] = np.cumsum(np.concatenate([[False], ~same]))[recurs]
        first = np.flatnonzero(name >= 0)
        first = first[first + size < len(name)]
        second = name[first + size]
        place = first[second >= 0]
        key = name[place] * len(word) + second[second >= 0]
        size *= 2
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _stretches(place: np.ndarray, step: np.ndarray, size: int, periods: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs out of the places of one level that have a successor ``step`` words on."""
    order = np.lexsort((place, step))
    place, step = place[order], step[order]
    new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(step) != 0)])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(place)) - 1
    start, period = place[begin], step[begin]
    length = place[last] + size + period - start
    long = length >= np.maximum(least, periods * period)
    return start[long], length[long], period[long]


def _batches(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of some texts at a time, with the number of the first text."""
    held, words, begin = [], 0, 0
    for i, t in enumerate(batch.column(text).cast(pa.large_binary())):
        if words >= WORDS_AT_ONCE:
            yield begin, held
            held, words, begin = [], 0, i
        held.append((t.as_py() or b"").split())
        words += len(held[-1])
    if held:
        yield begin, held


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", periods: int = 4, least: int = 6) -> DataFrame:
    """``keep`` plus ``n_words``, ``runs`` (an array of ``start, length, period`` by start, then period) and ``collapsed``.

    A run is a stretch of words with smallest period ``period``, at least ``periods`` times as long and at least ``least``
    words long, that no neighbouring word extends. ``collapsed`` is the text's words joined by blanks, without those that
    any run holds after its first period. Every row is worked on where it is read: no shuffle.
    """
    kept = [docs.schema[c] for c in keep]
    run_type = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([*(T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _batches(batch, len(kept)):
                counts = np.array([len(t) for t in texts], dtype=np.int64)
                offset = np.concatenate([[0], np.cumsum(counts)])
                words = np.empty(offset[-1], dtype=object)
                words[:] = [w for t in texts for w in t]
                owner = np.repeat(np.arange(len(texts)), counts)
                start, length, period = find_runs(pd.factorize(words)[0], owner, periods, least)
                of = np.searchsorted(offset, start, side="right") - 1
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                stays = np.cumsum(gone[:-1]) == 0
                touched = set(of.tolist())
                left = [
                    b" ".join(words[a:b][stays[a:b]] if i in touched else t)
                    for i, (t, a, b) in enumerate(zip(texts, offset[:-1].tolist(), offset[1:].tolist(), strict=True))
                ]
                rows = pa.StructArray.from_arrays([pa.array(start - offset[of], pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), rows)
                columns = [batch.column(i).slice(begin, len(texts)) for i in range(len(kept))]
                columns += [pa.array(counts, pa.int64()), lists, pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    narrow = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    return narrow.mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])


def strongest(runs: Column) -> Column:
    """The run of greatest length over period, compared exactly; of equal ones the earliest, then that of the smallest period."""

    def beats(b: Column, a: Column) -> Column:
        wide = [x.cast("decimal(19,0)") for x in (b["length"], a["period"], a["length"], b["period"])]
        return wide[0] * wide[1] > wide[2] * wide[3]

    # Runs come by start, then period: only a greater one takes the place.
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | beats(b, a), b).otherwise(a))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """A text some of whose documents end in a repeated stretch, chosen by their ids: every word from ``a`` on becomes word ``a + (i - a) % p``.

    With ``h`` the crc32 of the id in decimals and ``g = floor(h / 10)``: where ``h % 10 = 0`` and there are ``n > 0`` words,
    ``a = g % n`` and ``p = 1 + floor((n - a) / (3 + g % 8))``. Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    told = F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"))

    def changed(t: Column) -> Column:
        # A text is cut once: the fields below are read from the one element of an array.
        again = F.transform(t["w"], lambda w, i: F.when(i < t["a"], w).otherwise(F.get(t["w"], t["a"] + (i - t["a"]) % t["p"])))
        return F.array_join(again, " ")

    return F.when((h % 10 == 0) & (n > 0), F.get(F.transform(F.array(told), changed), F.lit(0))).otherwise(text)
