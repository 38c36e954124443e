"""Operators 5, 8, 9 and 10, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tablescope.llm import queries as registered
from tablescope.llm.imatch import SUBSETS, fingerprints
from tablescope.llm.linear import fit
from tablescope.llm.mixing import mix
from tablescope.llm.quality import fitted, quality_features, quality_scores, remainder
from tablescope.llm.scratch import Scratch
from tablescope.llm.toxicity import Restorer, language_model, toxicity_scores, trigram_counts


@pytest.mark.parametrize(("query", "label", "floor"), [("op5_quality_classifier", "quality", 0.95), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, floor):
    folder = "/root/testdata/sf0.01"
    rows = registered.queries()[query](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r[label] for r in held) / len(held) >= floor


def test_scores_of_odd_texts(spark, documents):
    rows = [(1, "!! BAD !!"), (2, "good words here"), (3, None), (4, ""), (5, "good words here"), (None, "x " * 50_000)]
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    for scores in (quality_scores, toxicity_scores):
        out = {r.doc_id: r.score for r in scores(docs, docs, labels, F.lit(True)).collect()}
        assert len(out) == 6 and all(0 <= s <= 1 for s in out.values())
        assert out[3] == out[4] and out[2] == out[5]
        none = scores(docs, docs, labels.limit(0), F.lit(True)).collect()
        assert {r.score for r in none} == {0.5}
        assert scores(docs.limit(0), docs, labels, F.lit(True)).count() == 0


def test_remainder_is_crc32(spark):
    import zlib

    row = spark.createDataFrame([(123,)], "id long").select(remainder(F.col("id"), 5).alias("r")).first()
    assert row.r == zlib.crc32(b"123") % 5


def test_the_model_separates():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 400)
    rows = [np.unique(np.concatenate([rng.integers(100, 200, 10), [1 if y else 2]])) for y in label]
    text = np.repeat(np.arange(400), [len(r) for r in rows])
    model = fit(text, np.concatenate(rows), label)
    assert ((model.scores(model.margins(text, np.concatenate(rows), 400)) >= 0.5) == (label == 1)).all()


def test_a_fit_leaves_no_memory_behind_in_the_driver(spark):
    def private() -> int:
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) // 1024

    def model(rows: int, words: int):
        text = f"array_join(transform(sequence(1, {words}), i -> conv(abs(xxhash64(id, i)) % 60000, 10, 36)), ' ') AS text"
        docs = spark.range(rows).selectExpr("id AS doc_id", text, "CAST(id % 2 AS int) AS quality")
        return fitted(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), "quality", F.lit(True), quality_features)

    model(100, 50)
    before = private()
    model(6000, 500)
    assert private() - before < 50


def test_disguises(spark, documents):
    plain = "the idiot and the moron are pathetic and worthless said a clown in the trash to the loser it was disgusting stupid scum"
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample(plain.split(), 15)) + " nothing else is written here about other things") for i in range(60)]
    own = Restorer(language_model(trigram_counts(documents(rows))))
    for shown, word in {
        "1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "idiooot": "idiot", "m0r0n": "moron", "p@thetic": "pathetic", "w0rthl3ss": "worthless",
        "l0$er": "loser", "tr4sh": "trash", "$cum": "scum", "CL0WN": "clown",
    }.items():
        assert own.word(shown) == word
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, toxic int")
    train = documents([(i, "what an idiot he is" if i < 30 else "what a fine day it is") for i in range(60)] + [(i + 100, t) for i, t in rows])
    hidden = documents([(1, "such an 1d10t here"), (2, "such an i d i o t here"), (3, "such an idiooot"), (4, "such a nice person 2024"), (5, "an idiot")])
    out = {r.doc_id: r.score for r in toxicity_scores(hidden, train, labels, F.lit(True)).collect()}
    assert min(out[1], out[2], out[3], out[5]) >= 0.5 > out[4]


def test_disguises_of_any_length_and_sign(spark, documents):
    from tablescope.llm.scan import words
    from tablescope.llm.toxicity import LOOKS_LIKE, MARKS, disguised, toxicity_features

    def shown(text):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return [w for _, w in disguised(raw, *words(raw, np.array([0, len(raw)])))]

    assert all(f"st{c}pid" in shown(f"so st{c}pid today") for c in LOOKS_LIKE)
    assert all(c.join("idiot") in shown(f"an {c.join('idiot')} here") for c in MARKS)
    for text in ("what an i d i o t.", "an i d i o t, he said", "he said 'i d i o t' twice", "he said \u201ci d i o t\u201d twice", "(i d i o t)"):
        assert "i d i o t" in shown(text)
    plain = "you are worthless and this is what they say about the idiot"
    lines = [(i, plain if i < 30 else "what a fine day it is and this is what they say") for i in range(60)]
    own = Restorer(language_model(trigram_counts(documents(lines))))
    assert own.word("idi" + "o" * 70 + "t") == "idiot"
    features = toxicity_features(own)

    def found(text):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return set(features(raw, np.array([0, len(raw)]))[1].tolist())

    for text in (" ".join("youareworthlessandthisiswhattheysayabouttheidiotagainandagainandagain"), "w o r t h l e s s."):
        assert found("worthless") <= found(text)
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, toxic int")
    hidden = documents([(1, "such an idi" + "o" * 70 + "t"), (2, "an i d i o t."), (3, " ".join("youaresuchanidiot" * 6)), (4, "such a fine day")])
    train = documents([(i, "what an idiot he is" if i < 30 else "what a fine day it is") for i in range(60)] + [(i + 100, t) for i, t in lines])
    out = {r.doc_id: r.score for r in toxicity_scores(hidden, train, labels, F.lit(True)).collect()}
    assert min(out[1], out[2], out[3]) >= 0.5 > out[4]


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark, scratch):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "é", "z", None, "Z"] + ["hot"] * 6)) for i in range(900)]
    rows += [(5, None, "a"), (None, "three words here", "b"), (7, "twice", "b"), (7, "twice", "b")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, u int")
    out = mix(table.repartition(3), scratch).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = _targets(dict(sizes)), Counter()
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45
    again = mix(table.repartition(5), Scratch(spark, "again")).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in out) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)
    assert mix(table.limit(0), scratch).count() == 0


def _hash(parts, seed=42):
    """Spark's 64-bit hash of texts (bytes) and whole numbers, one after the other."""
    for p in parts:
        seed = xxhash.xxh64(p if isinstance(p, bytes) else (p % 2**64).to_bytes(8, "little"), seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def _hash_int(term, j):
    """Of a term's hash and a 32-bit number."""
    seed = xxhash.xxh64((term % 2**64).to_bytes(8, "little"), seed=42).intdigest()
    return xxhash.xxh64(int(j).to_bytes(4, "little"), seed=seed).intdigest()


def _fingerprints_by_hand(rows, low, high):
    unique = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))

    def terms(t):
        return set(filter(None, regex.split(r"[^\p{L}\p{N}]+", t.lower())))

    df = Counter(w for _, t in rows for w in terms(t or ""))
    n = len(rows)
    lexicon = {_hash([w.encode()]) for w, c in df.items() if c >= max(2, low * n) and c <= max(2.0, high * n)}
    sizes = [s for s, count in SUBSETS.items() for _ in range(count)]

    def fingerprint(t):
        kept = sorted(lexicon & {_hash([w.encode()]) for w in terms(t)})
        if not kept:
            return [_hash([hashlib.sha256(t.encode()).digest()])] + [None] * (len(sizes) - 1)
        held = [[x for x in kept if _hash_int(x, j) & ((1 << s) - 1) == 0] for j, s in enumerate(sizes)]
        return [_hash(h) if h else None for h in held]

    def near(a, b):
        return sum(x is not None and x == y for x, y in zip(a, b, strict=True)) / sum(x is not None or y is not None for x, y in zip(a, b, strict=True))

    def shown(fp):
        return ",".join("" if x is None else f"{x % 2**64:X}" for x in fp)

    out = {}
    for at, (i, own) in enumerate(unique):
        after = unique[(at + 1) % len(unique)][1]
        q = len(own) // 4
        edited = own[: len(own) - q] + after[:q]
        a, b = fingerprint(own), fingerprint(edited)
        out[i] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), near(a, b), near(a, fingerprint(after)))
    return out


@pytest.mark.parametrize("high", [1.0, 0.3])
def test_fingerprints(documents, scratch, high):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 40, 400]))) for _ in range(60)]
    texts += [texts[0], texts[1].upper() + " !", None, "", "é" * 7, "...", "😀a b"]
    rows = list(enumerate(texts)) + [(99, "repeated row"), (99, "repeated row")]
    out = sorted(fingerprints(documents(rows).repartition(4), scratch, high=high).collect(), key=lambda r: r.doc_id)
    assert len(out) == len(rows)
    want = _fingerprints_by_hand(rows, 1 / 2000, high)
    for r in out:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want[r.doc_id]
    by = {r.doc_id: r for r in out}
    assert by[0].fingerprint == by[60].fingerprint and by[62].fingerprint == by[63].fingerprint
    long = [r for r in out if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.1 + np.mean([r.near_next for r in long])


def test_fingerprints_see_every_term(documents, scratch):
    words = [f"w{i}" for i in range(1500)]
    # Each document lacks one term of the others; the rest of the terms are in all of them, and every term in two or more.
    texts = [" ".join(words[:i] + words[i + 1 :]) for i in range(0, 1500, 75)] + [" ".join(words)] * 2
    out = sorted(fingerprints(documents(list(enumerate(texts))), scratch, high=1.0).collect(), key=lambda r: r.doc_id)
    assert len({r.fingerprint for r in out}) == 21 and out[20].fingerprint == out[21].fingerprint
    assert all(0.7 < r.near_next < 1 for r in out[:20]) and out[20].near_next == 1


def test_fingerprints_of_one_and_none(documents, scratch):
    one = fingerprints(documents([(None, "only text of all")]), scratch).collect()
    assert len(one) == 1 and one[0].doc_id is None and one[0].near_next == 1.0
    assert fingerprints(documents([]), scratch).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch, sizes, ids = Scratch(spark, "pipe"), [docs.count()], {r.doc_id for r in docs.select("doc_id").collect()}
    names = ("toxicity", "quality classifier", "MinHash near-dedup", "mixing", "byte-level BPE")
    assert tuple(n for n, _ in pipeline.STAGES) == names
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = scratch.write(stage(spark, docs, folder), f"s{i}")
        sizes.append(docs.count())
        assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= ids
        if i < 4:
            assert docs.columns == list(pipeline.COLUMNS)
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] > 0 and sizes[5] == sizes[4]


def test_documents_without_words_stay_within_the_limit(spark):
    rows = [(i, "a " * 50, "big") for i in range(40)] + [(100, "b c", "small"), (101, "", "small"), (102, None, "small")]
    out = {r.doc_id: r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark, "limit"), weights=(1, 5)).collect()}
    assert out[100].target == 4.0 and out[100].taken == 4
    assert all(r.repeats <= 2 for r in out.values()) and {out[101].taken, out[102].taken} == {0}
