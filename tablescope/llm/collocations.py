"""Operator 12: phrases whose words come together far more often than apart, by fingerprints of all n-grams.

1. Texts are cut into pieces and words by array operations. Rabin-Karp fingerprints come from prefix polynomials: one over
   the bytes gives every word's, one over the words' fingerprints gives that of any run of words as a difference of two
   sums. A task folds equal fingerprints of a batch of texts and hands on sorted lists of fingerprints and counts, one list
   per range of fingerprints; the ranges are shuffled and their lists added up. Fingerprints below ``least`` occurrences
   are gone from here on: what occurs often enough has a fingerprint that does.
2. What is left is kept as a filter of bits in the shared folder: 64 bits a fingerprint, at most ``FILTER_BITS`` in all.
   It may let more through (all the more where it is full), but never less. Longer phrases are counted by their own pass,
   and only where both shorter phrases inside them are in the filter.
3. A last pass follows the occurrences of what is in the filters back into the texts. Occurrences of one fingerprint are
   held against the words of the first one in the batch, so a collision parts the phrases again, and only then are phrases
   written out, with their counts and the smallest document that has them. Adding up by the phrase itself gives exact
   numbers, whatever the fingerprints did; phrases below ``least`` go.
4. Scores, dropped phrases and ranks are joins and aggregates over the phrases, on whole numbers of up to 38 digits.

Letters A-Z count as small ones. ``lang`` parts everything; a null one is ``und``. Null texts count as empty and give no
words. Repeated rows count each time. Null ids are never an example. An empty table gives an empty result. Only the three
named columns are read; any other name may stand beside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.files import commit_file, read_file
from tablescope.llm.groups import whole_groups
from tablescope.llm.identity import equal_groups
from tablescope.llm.scan import Hasher, chunks, mixed, runs
from tablescope.llm.scratch import Scratch

UNKNOWN = "und"
BYTES_AT_ONCE = 1_000_000
ENTRIES_HELD = 1_500_000
BYTES_PER_RANGE = 64 << 20
LEAST_RANGES = 256
BITS_PER_FINGERPRINT = 64
FILTER_BITS = 1 << 30
FILTER_FILES = 64
RANK_GROUPS = 64
# The bytes that end a piece, and those that part the words of a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_STEP = 0xC2B2AE3D27D4EB4F


class Words:
    """Words of one chunk of texts with fingerprints of all runs of them."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lang: np.ndarray):
        """``lang`` holds one number per text."""
        inside = np.ones(256, dtype=bool)
        inside[list(ENDS + BLANKS)] = False
        ending = np.zeros(256, dtype=bool)
        ending[list(ENDS)] = True
        self.raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.begin, self.end, self.text = runs(inside[raw], starts)
        # Words of one text with as many ends of pieces before them stand in one piece.
        before = np.cumsum(ending[raw]) if len(raw) else np.zeros(0, dtype=np.int64)
        piece = before[self.begin] if len(self.begin) else self.begin
        new = np.ones(len(self.begin), dtype=bool)
        new[1:] = (np.diff(piece) != 0) | (np.diff(self.text) != 0)
        self.piece = np.cumsum(new)
        self.hash = Hasher(raw).of(self.begin, self.end)
        size = len(self.hash)
        power = np.cumprod(np.full(size + 1, _STEP, dtype=np.uint64))
        self.back = np.cumprod(np.full(size + 1, pow(_STEP, -1, 1 << 64), dtype=np.uint64))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.hash * power[:size])])
        self.lang = mixed(lang[self.text].astype(np.uint64)) if size else self.hash

    def places(self, n: int) -> np.ndarray:
        """Where runs of ``n`` words begin that stay inside a piece."""
        if len(self.piece) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1])

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the runs of ``n`` words at ``at``."""
        return mixed((self.sums[at + n] - self.sums[at]) * self.back[at] + self.lang[at] + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        """The runs of words at ``at``, written with one blank between words."""
        whole, begin, end = self.raw.tobytes(), self.begin, self.end
        if n == 1:
            return [whole[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
        columns = [[whole[a:b] for a, b in zip(begin[at + i].tolist(), end[at + i].tolist(), strict=True)] for i in range(n)]
        return [b" ".join(words) for words in zip(*columns, strict=True)]


def _lang_numbers(langs: list[str]) -> np.ndarray:
    """One number per language, the same in every task."""
    code, names = pd.factorize(np.array(langs, dtype=object))
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], dtype=np.uint64)[code]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str], list]]:
    """Words, languages and ids of chunks of ``t, lang, id`` rows."""
    for batch in batches:
        langs, ids = batch.column(1).to_pylist(), batch.column(2)
        for first, last, raw, starts in chunks(batch.column(0), BYTES_AT_ONCE):
            yield Words(raw, starts, _lang_numbers(langs[first:last])), langs[first:last], ids.slice(first, last - first).to_pylist()


def _folded(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different fingerprints and their added counts."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, dtype=np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


@lru_cache(maxsize=4)
def _filter(folder: str, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(read_file(folder, f"{name}-{i:02d}") for i in range(FILTER_FILES)), dtype=np.uint8)


def _passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether fingerprints are in a filter: their leading bits name one of its bits."""
    bit = prints >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _longer(words: Words, n: int, filters: dict[int, tuple[str, str]]) -> np.ndarray:
    """Places of runs of ``n`` words whose two shorter runs are both in their filter."""
    at = words.places(n)
    if n - 1 in filters and n > 2:
        bits = _filter(*filters[n - 1])
        at = at[_passes(bits, words.prints(at, n - 1))]
        at = at[_passes(bits, words.prints(at + 1, n - 1))]
    return at


def _counted(docs: DataFrame, sizes: list[int], filters: dict[int, tuple[str, str]], ranges: int, least: int, scratch: Scratch, name: str) -> tuple[str, str]:
    """A filter of the fingerprints of runs of ``sizes`` words that occur ``least`` times or more."""
    shift, filters = np.uint64(64 - (ranges - 1).bit_length()), dict(filters)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0

        def handed_on() -> pa.RecordBatch:
            prints, counts = _folded(*(np.concatenate(c) for c in zip(*held, strict=True)))
            where = (prints >> shift).astype(np.int32)
            cut = np.flatnonzero(np.diff(where)) + 1
            begin = np.concatenate([[0], cut])
            # What counts is whether they are enough: nothing is lost by an end at 2**32.
            counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
            lists = [[x.tobytes() for x in np.split(c, cut)] for c in (prints, counts)]
            return pa.RecordBatch.from_arrays([pa.array(where[begin], pa.int32()), *(pa.array(x, pa.binary()) for x in lists)], names=["part", "prints", "counts"])

        for words, _, _ in _scanned(batches):
            new = [words.prints(_longer(words, n, filters), n) for n in sizes]
            prints = np.concatenate(new)
            if not len(prints):
                continue
            held.append(_folded(prints, np.ones(len(prints), dtype=np.int64)))
            entries += len(held[-1][0])
            if entries >= ENTRIES_HELD:
                yield handed_on()
                held, entries = [], 0
        if held:
            yield handed_on()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            part = batch.column(0).to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                lists = [b"".join(batch.column(i).slice(a, b - a).to_pylist()) for i in (1, 2)]
                prints, counts = _folded(np.frombuffer(lists[0], dtype=np.uint64), np.frombuffer(lists[1], dtype=np.uint32).astype(np.int64))
                often = prints[counts >= least]
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([often.tobytes()], pa.binary()), pa.array([len(often)], pa.int64())], names=["part", "prints", "n"])

    lists = docs.mapInArrow(emit, "part int, prints binary, counts binary").repartition("part").sortWithinPartitions("part")
    frequent = scratch.write(lists.mapInArrow(add_up, "part int, prints binary, n long"), name)
    many = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    bits = min(FILTER_BITS, max(1 << 16, 1 << (BITS_PER_FINGERPRINT * many).bit_length()))
    folder = scratch.files("filters")
    _write_filter(frequent, folder, name, bits)
    scratch.drop(name)
    return folder, name


def _write_filter(frequent: DataFrame, folder: str, name: str, bits: int) -> None:
    """The filter's bits in ``FILTER_FILES`` files, each written whole by one task."""
    per_file = bits // FILTER_FILES

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for flat in batch.column(0).to_pylist():
                prints = np.frombuffer(flat, dtype=np.uint64)
                bit = np.unique(prints >> np.uint64(65 - bits.bit_length()))
                of = (bit // np.uint64(per_file)).astype(np.int32)
                cut = np.flatnonzero(np.diff(of)) + 1
                parts += [(int(o[0]), x.tobytes()) for o, x in zip(np.split(of, cut), np.split(bit, cut), strict=True) if len(o)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["file", "bits"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come file by file; only one file's bits are held.
        current, own = None, None

        def close() -> pa.RecordBatch:
            commit_file(folder, f"{name}-{current:02d}", [np.packbits(own, bitorder="little").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([int(own.sum())], pa.int64())], names=["file", "set"])

        for batch in batches:
            for file, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != current:
                    if current is not None:
                        yield close()
                    current, own = file, np.zeros(per_file, dtype=bool)
                own[(np.frombuffer(flat, dtype=np.uint64) - np.uint64(file * per_file)).astype(np.int64)] = True
        if current is not None:
            yield close()

    every = frequent.sparkSession.range(FILTER_FILES).select(F.col("id").cast("int").alias("file"), F.lit(b"").alias("bits"))
    found = frequent.select("prints").mapInArrow(slices, "file int, bits binary").unionAll(every)
    found.repartition("file").sortWithinPartitions("file").mapInArrow(write, "file int, set long").agg(F.sum("set")).collect()


def _written_out(docs: DataFrame, filters: dict[int, tuple[str, str]], longest: int) -> DataFrame:
    """``lang, words, phrase, f, example`` of what is in the filters, partly added up; an empty phrase counts all words."""
    schema = "lang string, words int, phrase string, f long, example long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, ids in _scanned(batches):
            name = np.array(langs, dtype=object)
            key = np.array([-1 if i is None else i for i in ids], dtype=np.int64)
            known = np.array([i is not None for i in ids], dtype=bool)
            code, names = pd.factorize(name)
            total = np.bincount(code[words.text], minlength=len(names))
            yield _rows(list(names), 0, [b""] * len(names), total, [None] * len(names))
            # Which words are equal, found by hash and checked letter by letter.
            _, same_word = equal_groups(words.raw, words.begin, words.end, words.hash)
            for n in range(1, longest + 1):
                at = _longer(words, n, filters)
                at = at[_passes(_filter(*filters[n]), words.prints(at, n))]
                if not len(at):
                    continue
                prints = words.prints(at, n)
                _, first, which = np.unique(prints, return_index=True, return_inverse=True)
                own, kept = at, at[first[which]]
                equal = code[words.text[own]] == code[words.text[kept]]
                for i in range(n):
                    equal &= same_word[own + i] == same_word[kept + i]
                # What differs from the first one of its fingerprint stands for itself.
                odd = np.flatnonzero(~equal)
                counts = np.concatenate([np.bincount(which[equal], minlength=len(first)), np.ones(len(odd), dtype=np.int64)])
                shown = np.concatenate([at[first], at[odd]])
                group = which.copy()
                group[odd] = len(first) + np.arange(len(odd))
                example = np.full(len(shown), np.iinfo(np.int64).max)
                has = known[words.text[at]]
                np.minimum.at(example, group[has], key[words.text[at]][has])
                examples = pa.array(example, pa.int64(), mask=example == np.iinfo(np.int64).max)
                yield _rows(list(name[words.text[shown]]), n, words.phrases(shown, n), counts, examples)
            del words, same_word

    return docs.mapInArrow(run, schema)


def _rows(langs: list, n: int, phrases: list[bytes], counts: np.ndarray, examples) -> pa.RecordBatch:
    columns = [
        pa.array(langs, pa.string()), pa.array(np.full(len(langs), n), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()),
        pa.array(counts, pa.int64()), pa.array(examples, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "f", "example"])


def phrase_counts(
    docs: DataFrame, scratch: Scratch, longest: int = 3, least: int = 10, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``lang, words, phrase, f, example``: exact counts of all phrases of 1 to ``longest`` words that occur ``least`` times.

    ``example`` is the smallest id of a document that has the phrase. The row of each language with no words and an empty
    phrase holds the number of all its words.
    """
    narrow = docs.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col(f"`{doc_id}`").cast("long").alias("id"),
    )
    size = narrow.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    ranges = 1 << max(LEAST_RANGES - 1, size // BYTES_PER_RANGE).bit_length()
    filters: dict[int, tuple[str, str]] = {}
    for n in range(2, max(longest, 2) + 1):
        made = _counted(narrow, [1, 2] if n == 2 else [n], filters, ranges, least, scratch, f"prints{n}")
        filters |= {1: made, 2: made} if n == 2 else {n: made}
    summed = _written_out(narrow, filters, longest).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"), F.min("example").alias("example"))
    return scratch.write(summed.filter((F.col("f") >= least) | (F.col("words") == 0)), "phrases")


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(15,0)")


def collocations(
    docs: DataFrame, scratch: Scratch, longest: int = 3, least: int = 10, within: int = 50, top: int = 2000,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The first ``top`` phrases of 2 to ``longest`` words per language: ``lang, rank, phrase, a, l, r, n, score, example``.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut of lowest ``score = floor(10**6 * a * a / (l * r))``
    (the first of equal ones), ``n`` all words of the language. A phrase inside a longer one that has at least ``within``
    percent of its occurrences is left out. Order: score, then ``a``, both from the greatest, then the phrase.
    """
    counts = phrase_counts(docs, scratch, longest, least, doc_id, text, lang)
    parted = counts.withColumn("w", F.split("phrase", " "))

    def span(begin: Column | int, size: Column | int) -> Column:
        return F.array_join(F.slice("w", begin, size), " ")

    phrases = parted.filter("words >= 2")
    # Shorter phrases inside each phrase, of two words at least.
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("words") - s + 1), lambda b: span(b, s)))))
    held = phrases.filter("words >= 3").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    alone = phrases.join(held.select(F.col("lang").alias("hl"), F.col("phrase").alias("hp"), "longer"), (F.col("lang") == F.col("hl")) & (F.col("phrase") == F.col("hp")), "left")
    alone = alone.filter(F.col("longer").isNull() | (F.lit(100) * _whole("longer") < F.lit(within) * _whole("f"))).select("lang", "words", "phrase", "w", "f", "example")
    cuts = alone.select("lang", "words", "phrase", "f", "example", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "f", "example", "k", span(1, F.col("k")).alias("first"), span(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    # Parts occur as often as the phrase, so they are counted too. A part that very many phrases share is a skewed key of
    # the large side alone, which adaptive execution splits.
    part = counts.select(F.col("lang").alias("pl"), F.col("phrase").alias("pp"), F.col("f").alias("pf"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part, (F.col("lang") == F.col("pl")) & (F.col(side) == F.col("pp"))).withColumnRenamed("pf", name).drop("pl", "pp", side)
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * (CAST(f AS DECIMAL(15,0)) * CAST(f AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    scored = cuts.withColumn("key", score * F.lit(longest + 1).cast("long") + F.col("k"))
    sides = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, longest) for c in ("l", "r")]
    best = scored.groupBy("lang", "phrase").agg(F.min("key").alias("key"), F.first("f").alias("a"), F.first("example").alias("example"), *sides)
    k = F.col("key") % (longest + 1)
    chosen = best.select(
        "lang", "phrase", "a", *[F.coalesce(*[F.when(k == i, F.col(f"{c}{i}")) for i in range(1, longest)]).alias(c) for c in ("l", "r")],
        F.floor(F.col("key") / (longest + 1)).alias("score"), "example",
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # The first ones of every group of a language hold its first ones.
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))).orderBy(*order)
    few = chosen.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    total = counts.filter("words = 0").select(F.col("lang").alias("tl"), F.col("f").alias("n"))
    out = ranked.join(total, F.col("lang") == F.col("tl"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "example")
