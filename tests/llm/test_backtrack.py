"""Operator 11 against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablescope.llm.backtrack import Merger, encode_decode, merger
from tablescope.llm.queries import op11_backtracking_bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  \n", "It's what we'll do, isn't it?  'S 's", "ñandú über 中文 😀́ ٣½", "a" * 5000, "=-" * 3000, "same", "same", "x\x1c\x85 y",
    "end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext| >", "don<|endoftext|>'t  ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def same(own, library, texts):
    ids, counts = own.encode(texts)
    rows = np.split(ids, np.cumsum(counts)[:-1])
    for text, row in zip(texts, rows, strict=True):
        assert row.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(row) == text.encode("utf-8")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(library, texts):
    same(merger(FILE), library, [t.encode("utf-8", "ignore").decode("utf-8") for t in texts])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["in", "ing", "the", "he", "ab", "er", "ion", "a", "t", "=", "--", " "]), max_size=40))
def test_texts_of_overlapping_tokens(library, parts):
    same(merger(FILE), library, ["".join(parts)])


def test_repeats_and_long_pieces(library):
    rng = random.Random(4)
    same(merger(FILE), library, [c * n for c in "a =-0" for n in range(70)] + ["".join(rng.choice("abetns") for _ in range(n)) for n in (100, 5000, 30_000)])


def test_words_of_equal_hash(library):
    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    same(merger(FILE), library, [a, b, f"{b} {a}"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_decode(library, ids):
    assert merger(FILE).decode(np.array(ids, dtype=np.uint32)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_other_merges(tmp_path_factory, data):
    """Small vocabularies of random merges, in which ties and dead ends are common."""
    tokens, merges = list("abc"), []
    for _ in range(data.draw(st.integers(0, 12))):
        a, b = data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens))
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append([a, b])
    with open(FILE, encoding="utf-8") as lines:
        spec = json.load(lines)
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path_factory.mktemp("merges") / "t.json"
    path.write_text(json.dumps(spec))
    same(Merger(str(path)), Tokenizer.from_file(str(path)), [data.draw(st.text(alphabet="abc", max_size=40)) for _ in range(8)])


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"added_tokens": [{"id": 0, "content": "x", "single_word": True, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]}, {"pre_tokenizer": None}])
def test_unknown_rules_are_refused(tmp_path, change):
    with open(FILE, encoding="utf-8") as lines:
        spec = json.load(lines) | change
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match=next(iter(change))):
        Merger(str(tmp_path / "t.json"))


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_rows(documents, library):
    docs = documents([(None if i == 3 else i, t) for i, t in enumerate(TEXTS)])
    rows = encode_decode(docs.repartition(2), FILE, keep=("doc_id", "text", "score"), with_ids=True, with_text=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, r.text)
        assert r.decoded == (r.text or "") and len(r.ids) == r.n_tokens
    assert encode_decode(docs.limit(0), FILE).count() == 0


def test_query(spark, folder, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op11_backtracking_bpe(spark, folder).collect()}
    assert got == {i: digests(library, t) for i, t in docs.items()}
