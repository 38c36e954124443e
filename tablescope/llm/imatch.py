"""Operator 10: document fingerprints by I-Match over randomised lexicon subsets, in DataFrame functions only.

Terms are runs of letters and digits, in lower case. The lexicon holds the terms whose document frequency lies within a
band, as a share of all documents: common words say little, rare ones break at the first edit. A text keeps all its distinct
terms of the lexicon, in sorted order. The lexicon has random subsets, the same for every text: the whole of it, and in
``SUBSETS`` so many of each size, down to one term in 256. For every subset the sorted terms of the text that it holds give
one 64-bit hash; a subset without terms of the text gives none. These hashes are the fingerprint. The likeness of two
fingerprints is the share of equal hashes among the subsets that hold terms of either. Sizes differ because texts do: an edit
of a quarter of a text leaves those subsets alone that hold about as many of its terms as it has changed ones to none,
whatever its length, and the larger ones tell exact copies apart from near ones.

The lexicon has at most ``mean number of distinct terms / low`` entries, whatever the number of documents; it is broadcast
only after it has been counted, and joined by a shuffle beyond ``BROADCAST_TERMS``. Texts are shuffled once, by their id.

Null texts count as empty. A text without terms of the lexicon (empty ones included) is its own single term, so equal texts
agree and different ones do not. Documents are ordered by id, nulls first, then by a hash of the text; rows that agree in
id and text count as one document and are all returned. The last document's next is the first; a single one is its own.
An empty table gives an empty result. Columns beside the two named ones are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.ranges import with_position
from tablescope.llm.scratch import Scratch

#: Subsets by size: ``{s: count}`` are ``count`` subsets that hold each term with odds of 1 in ``2**s``.
SUBSETS = {0: 1, 4: 2, 6: 3, 8: 4}
_EMPTY = 42  # the hash of no terms at all
BROADCAST_TERMS = 2_000_000
_NULL_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    found = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, scratch: Scratch, low: float, high: float, text: str = "t") -> DataFrame:
    """``lex, mask``: hashes of the terms in at least ``low`` and at most ``high`` of all documents, and a bit for each subset they are in.

    Terms of a single document are left out, and those of two always within ``high``.
    """
    rows = docs.count()
    counted = docs.select(F.explode(terms(F.col(text))).alias("lex")).groupBy("lex").agg(F.count("*").alias("df"))
    return scratch.write(counted.filter((F.col("df") >= max(2, low * rows)) & (F.col("df") <= max(2.0, high * rows))).select("lex", _mask(F.col("lex")).alias("mask")), "lexicon")


def _mask(term: Column) -> Column:
    """One bit for each subset, set with the odds of its size, by a hash of the term and the subset's number."""
    sizes = [s for s, count in SUBSETS.items() for _ in range(count)]
    bits = [F.when(F.xxhash64(term, F.lit(j)).bitwiseAND((1 << s) - 1) == 0, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")) for j, s in enumerate(sizes)]
    return reduce(Column.bitwiseOR, bits)


def fingerprint(kept: Column, whole: Column) -> Column:
    """Hashes of the subsets of ``kept``, sorted structs of ``lex`` and ``mask``; null for a subset without terms.

    A text without terms of the lexicon has the hash of the whole text in the first place.
    """
    count = sum(SUBSETS.values())

    def hashed(terms: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda j: F.xxhash64(F.transform(F.filter(terms, lambda t: F.getbit(t["mask"], j) == 1), lambda t: t["lex"])),
        )

    own = F.concat(F.array(whole), F.array_repeat(F.lit(_EMPTY).cast("long"), count - 1))
    # The terms are one element of an array, so that they are sorted once and not again for every subset.
    every = F.get(F.transform(F.array(kept), lambda terms: F.when(F.size(terms) > 0, hashed(terms)).otherwise(own)), F.lit(0))
    return F.transform(every, lambda x: F.when(x != _EMPTY, x))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either fingerprint has terms of, from 0 to 1."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    equal = F.size(F.filter(both, lambda x: x["a"] == x["b"]))
    return equal / F.size(F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))


def shown(fp: Column) -> Column:
    """A fingerprint as text: its hashes in order, nothing for a subset without terms."""
    return F.array_join(F.transform(fp, lambda x: F.coalesce(F.hex(x), F.lit(""))), ",")


def fingerprints(
    docs: DataFrame, scratch: Scratch, low: float = 1 / 2000, high: float = 1 / 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one row per document.

    The edited text of a document has its last quarter replaced by as much of the next document's beginning.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    ident = F.col(f"`{doc_id}`").cast("long")
    base = docs.select(
        F.coalesce(ident, F.lit(_NULL_ID)).alias("k"), F.xxhash64(ident.isNull(), t).alias("h"), t.alias("t"), ident.isNull().alias("no_id")
    )
    words = lexicon(base, scratch, low, high)
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    keys = base.select("k", "h", F.char_length("t").alias("n"), "no_id").groupBy("k", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.max("no_id").alias("no_id"))
    # Null ids hold the smallest key; an id of that very value comes right after them.
    order = [F.col("k").asc(), F.col("no_id").desc(), F.col("h").asc()]
    places = scratch.write(with_position(keys, order, scratch, "ordered"), "places")
    total = places.count()
    following = places.select(F.pmod(F.col("pos") + 1, F.lit(max(total, 1))).alias("p"), F.col("k").alias("prev_k"), F.col("h").alias("prev_h"), F.floor(F.col("n") / 4).cast("int").alias("ask"))
    asked = places.select("k", "h", "pos").join(following, F.col("pos") == F.col("p")).select(F.col("k").alias("ak"), F.col("h").alias("ah"), "prev_k", "prev_h", "ask")
    asked = scratch.write(asked, "asked")
    single = base.select("k", "h", "t")
    # Each document sends to the one before it as much of its beginning as that asks for.
    sent = single.join(asked, (F.col("k") == F.col("ak")) & (F.col("h") == F.col("ah"))).select("prev_k", "prev_h", F.substring("t", F.lit(1), F.col("ask")).alias("front"))
    sent = sent.dropDuplicates(["prev_k", "prev_h"]) if total < docs.count() else sent
    size = F.char_length("t")
    edited = F.concat(F.substring("t", F.lit(1), (size - F.floor(size / 4)).cast("int")), F.col("front"))
    texts = single.dropDuplicates(["k", "h"]) if total < docs.count() else single
    both = texts.join(sent, (F.col("k") == F.col("prev_k")) & (F.col("h") == F.col("prev_h"))).select("k", "h", "t", edited.alias("e"))

    def told(body: str, v: int) -> Column:
        return F.transform(terms(F.col(body)), lambda x: F.struct(x.alias("term"), F.lit(v).alias("v")))

    # A step of its own, so that nothing in it is worked out again for every term.
    termed = both.select(
        "k", "h", F.char_length("t").cast("long").alias("n_chars"), F.unhex(F.sha2("t", 256)).alias("sha"), F.unhex(F.sha2("e", 256)).alias("esha"),
        # One element more keeps texts without terms of the lexicon.
        F.concat(told("t", 0), told("e", 1), F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit(2).alias("v")))).alias("all"),
    )
    listed = termed.select("k", "h", "n_chars", "sha", "esha", F.explode("all").alias("one")).select("k", "h", "n_chars", "sha", "esha", "one.term", "one.v")
    # The texts' partitioning by key serves the grouping as well: no further shuffle.
    marked = listed.join(words, F.col("term") == F.col("lex"), "left").filter("lex IS NOT NULL OR v = 2")
    held = F.when(F.col("lex").isNotNull(), F.struct("lex", "mask"))
    grouped = marked.groupBy("k", "h", "n_chars", "sha", "esha").agg(*[F.sort_array(F.collect_list(F.when(F.col("v") == v, held))).alias(f"kept{v}") for v in (0, 1)])
    printed = grouped.select(
        "k", "h", "n_chars", F.lower(F.hex("esha")).alias("edited_sha256"),
        fingerprint(F.col("kept0"), F.xxhash64("sha")).alias("fp"), fingerprint(F.col("kept1"), F.xxhash64("esha")).alias("efp"),
    )
    where = places.select(F.col("k").alias("pk"), F.col("h").alias("ph"), "pos", "copies", "no_id")
    made = scratch.write(printed.join(where, (F.col("k") == F.col("pk")) & (F.col("h") == F.col("ph"))).drop("pk", "ph"), "made")
    after = made.select(F.pmod(F.col("pos") - 1, F.lit(max(total, 1))).alias("p"), F.col("fp").alias("next_fp"))
    out = made.join(after, F.col("pos") == F.col("p"))
    result = out.select(
        F.when(~F.col("no_id"), F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "copies",
    )
    return result.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
