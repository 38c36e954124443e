"""Operators 6 and 2: pieces, merges and files against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablescope.llm.bpe import bpe_round_trip, encoder
from tablescope.llm.pfor import pack, unpack
from tablescope.llm.pieces import code_points, piece_starts
from tablescope.llm.tokens import read_token_files, write_token_files

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
TEXTS = [None, "", " ", "  \n", "It's what we'll do, isn't it?  'S 's", "ñandú über 中文 😀́ ٣½", "a" * 5000, "<|endoftext|> x", "same", "same", "x\x1c\x85 y"]


def _pieces(text):
    points, starts = code_points([text])
    at = piece_starts(points, starts).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abstdmrevl'  \n\t 　éñ012½.,!_中😀́\x1c\x85ABST", max_size=60))
def test_pieces_are_those_of_the_pattern(text):
    assert _pieces(text) == [m.group() for m in PATTERN.finditer(text)]


@pytest.fixture(scope="module")
def reference():
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_exact(reference, text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    own = encoder(MULTI)
    ids, _ = own.encode([text])
    assert ids.tolist() == reference.encode_ordinary(text)
    assert own.decode(ids).tobytes() == text.encode("utf-8")


def test_long_random_pieces_are_exact(reference):
    rng = random.Random(5)
    for size in (1, 2, 3, 50, 400):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        assert encoder(MULTI).encode_piece(text) == reference.encode_ordinary(text)


def test_rows_of_the_round_trip(documents, reference):
    rows = {r.doc_id: r for r in bpe_round_trip(documents(list(enumerate(TEXTS))), MULTI).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = reference.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_round_trip(documents([]), MULTI).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=400), max_size=6), st.booleans())
def test_packed_files_come_back(docs, null):
    keys = [None if null and i == 0 else i - 3 for i in range(len(docs))]
    ids = np.array([x for d in docs for x in d], dtype=np.uint32)
    got, names, counts = unpack(pack(ids, keys, np.array([len(d) for d in docs], dtype=np.int64)))
    assert got.tolist() == ids.tolist() and names == keys and counts.tolist() == [len(d) for d in docs]


def test_token_files(documents, scratch):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    texts = [*TEXTS, "last"]
    ids = [None, *range(len(texts) - 2, -1, -1)]  # descending, one null, so order is made by the operator
    folder, manifest = write_token_files(documents(list(zip(ids, texts, strict=True))).repartition(3), scratch, public_tokenizers.path("byte_bpe_50k.json"), 2, ids_per_file=1000)
    rows = sorted(read_token_files(folder, manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert manifest.count() > 1  # the long text rolled a file
    expected = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, (i, text) in zip(rows, expected, strict=True):
        want = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.ids) == (i, start, want)
        assert row.ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes()) and row.n_tokens == len(want)
        start += len(want)


def test_added_tokens_of_the_query(spark, documents, tmp_path):
    from tablescope.llm.queries import op2_token_files

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*TEXTS, "end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext| >", "don<|endoftext|>'t  ", "last"]
    documents(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(op2_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert own.encode("end <|endoftext|> next", add_special_tokens=False).ids == [437, 220, 50256, 1306]
    start = 0
    for row, text in zip(rows, texts, strict=True):
        want = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, dtype="<u4").tobytes()))
        start += len(want)


def test_no_token_files(documents, scratch):
    folder, manifest = write_token_files(documents([]), scratch, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert read_token_files(folder, manifest).count() == 0


def swapped_words(size, a="a", b="b"):
    """Two different words of ``size`` letters whose polynomial hashes modulo a power of two agree for every odd base."""
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("size", [1024, 4096])
def test_pieces_of_equal_hash_keep_their_ids(documents, reference, size):
    from tablescope.llm.tokens import _encoder

    a, b = swapped_words(size)
    texts = [a, b, f"{b} {a} {b}", a]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for encode, want in (
        (encoder(MULTI).encode, reference.encode_ordinary),
        (_encoder(public_tokenizers.path("byte_bpe_50k.json"), True).encode, lambda t: library.encode(t, add_special_tokens=False).ids),
    ):
        ids, counts = encode(texts)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [want(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80), st.lists(st.tuples(st.integers(0, 79), st.integers(0, 40), st.integers(0, 2)), min_size=1, max_size=40))
def test_members_of_a_group_are_equal(values, ranges):
    from tablescope.llm.identity import equal_groups

    values = np.array(values)
    begin = np.array([min(b, len(values)) for b, _, _ in ranges])
    end = np.minimum(begin + np.array([n for _, n, _ in ranges]), len(values))
    first, which = equal_groups(values, begin, end, np.array([h for _, _, h in ranges]))
    for i, g in enumerate(which.tolist()):
        j = first[g]
        assert values[begin[i] : end[i]].tolist() == values[begin[j] : end[j]].tolist()
