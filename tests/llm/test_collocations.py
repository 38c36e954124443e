"""Operator 12 against counting by hand, and its query against SQL."""

import re
from collections import Counter

import numpy as np
import pytest
from oracle import connection, difference

from tablescope.llm import collocations as module
from tablescope.llm.collocations import Words, collocations, phrase_counts
from tablescope.llm.queries import oracle_sql, queries


def by_hand(rows, longest=3, least=10, within=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    longer = {}
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer.get((lang, p[i : i + k]), 0), a)
    out = []
    for (lang, p), a in often.items():
        if 100 * longer.get((lang, p), 0) < within * a:
            score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked, seen = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked), f


@pytest.fixture
def docs(spark):
    def make(rows, ids=None):
        schema = "doc_id long, text string, lang string, t string, f long, words int, phrase string, id string"
        ids = ids or range(len(rows))
        return spark.createDataFrame([(i, t, g, "x", 1, 2, "y", "z") for i, (t, g) in zip(ids, rows, strict=True)], schema)

    return make


def texts(seed, count=120, names=("one", "two", "Three", "FOUR", "é", "x1", "中")):
    rng = np.random.default_rng(seed)
    marks = np.array([" ", "  ", "\t", ". ", ",", "\n", " "])
    return [
        ("".join(f"{names[int(w)]}{marks[int(m)]}" for w, m in zip(rng.zipf(1.7, 60) % len(names), rng.integers(0, len(marks), 60), strict=True)), (None, "en", "de")[i % 3])
        for i in range(count)
    ]


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("longest", "top"), [(2, 2000), (3, 2000), (3, 5), (4, 40)])
def test_by_hand(docs, scratch, longest, top):
    rows = [*texts(longest), (None, None), ("", "en"), (" ,;", "fr"), *[("a b c a b c", "en")] * 12]
    got = collocations(docs(rows).repartition(5), scratch, longest=longest, top=top)
    assert rows_of(got) == by_hand(rows, longest, top=top)[0]


def test_counts_and_examples(docs, scratch):
    rows = texts(9)
    ids = [None if i % 7 == 0 else 1000 - i for i in range(len(rows))]
    f = by_hand(rows)[1]
    got = {(r.lang, tuple(r.phrase.split(" "))): r for r in phrase_counts(docs(rows, ids).repartition(4), scratch).filter("words > 0").collect()}
    assert {p: r.f for p, r in got.items()} == {p: a for p, a in f.items() if a >= 10}
    for (lang, p), r in got.items():
        has = [i for i, (t, g) in zip(ids, rows, strict=True) if i is not None and (g or "und") == lang and (lang, p) in by_hand([(t, g)])[1]]
        assert r.example == min(has)


def test_collisions_are_parted(docs, scratch, spark):
    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    rows = [(f"{a} x {b} x {a} {b}", "en")] * 6 + [(f"{b} x {a}", "en")] * 5
    words = Words(np.frombuffer(f"{a} {b}".encode(), dtype=np.uint8), np.array([0]), np.zeros(1, dtype=np.uint64))
    assert words.hash[0] == words.hash[1]  # the case this is about
    assert rows_of(collocations(docs(rows).repartition(2), scratch)) == by_hand(rows)[0]


def test_a_full_filter_changes_nothing(docs, scratch, monkeypatch):
    rows = texts(5)
    monkeypatch.setattr(module, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(module, "BITS_PER_FINGERPRINT", 1)
    monkeypatch.setattr(module, "LEAST_RANGES", 2)
    assert rows_of(collocations(docs(rows).repartition(3), scratch)) == by_hand(rows)[0]


def test_no_rows(docs, scratch):
    assert collocations(docs([]), scratch).count() == 0
    assert collocations(docs([(None, None), ("", "en")]), scratch).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(queries()["op12_collocations"](spark, folder), connection(folder), oracle_sql()["op12_collocations"]) is None
