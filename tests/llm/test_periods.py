"""Operator 13: runs against a check of every stretch and period, and the query's digests."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.llm.periods import find_runs, periodic_runs
from tablescope.llm.queries import op13_periodic_runs


def every_run(words, periods=4, least=6):
    """Maximal stretches with their smallest period, by trying all periods at all starts."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = every_run(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 12)), max_size=8), max_size=4), st.integers(1, 9))
def test_runs_are_all_runs(texts, period):
    # Blocks of one word, and of a growing counter, repeated: many runs, some inside others.
    rows = [[w for v, n in t for w in ([v] * n if v else [i % period for i in range(n * period)])] for t in texts]
    word = np.array([w for r in rows for w in r], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    start, length, q = find_runs(word, owner)
    offset = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(int)
    assert list(zip(start.tolist(), length.tolist(), q.tolist(), strict=True)) == [(s + offset[i], n, p) for i, r in enumerate(rows) for s, n, p in every_run(r)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120), st.integers(3, 5), st.integers(1, 9))
def test_other_limits(words, periods, least):
    found = find_runs(np.array(words, dtype=np.int64), np.zeros(len(words), dtype=np.int64), periods, least)
    assert [tuple(r) for r in np.array(found).T.tolist()] == every_run(words, periods, least)


def test_too_few_periods():
    with pytest.raises(ValueError):
        find_runs(np.zeros(3, dtype=np.int64), np.zeros(3, dtype=np.int64), periods=2)


TEXTS = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "a b c " * 30, ("a a a a a a b " * 5), "A a A a A a A a", "é\x85é " * 9, "one\x0btwo\x0cone two one two one two", "w " * 5000]


def test_texts(documents):
    docs = documents([(None if i == 3 else i, t) for i, t in enumerate(TEXTS + TEXTS)])
    rows = periodic_runs(docs.repartition(3), keep=("doc_id", "n_chars", "text")).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = every_run(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, documents, tmp_path):
    # Ids of both kinds: those whose texts are repeated, and those left alone.
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:30] + list(range(20))
    texts = [*TEXTS, *(" ".join(str(i % m) for i in range(n)) for m, n in ((3, 60), (7, 29), (50, 200), (1, 9), (997, 1500)))]
    rows = [(i, texts[k % len(texts)]) for k, i in enumerate(ids)] + [(None, "a b " * 8), (ids[0], texts[0])]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(*r)) for r in rows)


def test_query_on_given_texts(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    short = [i for i, t in docs.items() if len(t or "") < 6000]
    assert len(short) > 100
    for i in short:
        assert got[i] == expected(i, docs[i])
