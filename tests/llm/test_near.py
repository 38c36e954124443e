"""Operators 7 and 1 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from tablescope.llm.components import connected_components
from tablescope.llm.embeddings import near_embeddings
from tablescope.llm.minhash import deduplicated, near_duplicates


def _classes(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def _shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _brute(rows, k, percent=80):
    sets = {i: _shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, _classes(ids, links)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(12)]
    for base in range(12):
        words = [word() for _ in range(60)]
        if base % 2:
            words[5:17] = passage
        for copy in range(1 if base > 8 else 9):
            own = list(words)
            for _ in range(copy // 3):
                own[rng.randrange(60)] = word()
            rows.append(" ".join(own) if copy % 2 else "  ".join(own).upper() + "\n")
    rows += [None, "", " \t\n", "one", "ONE", "two words", "two words", "a b c d e f", "A b c d e f", "É b c d e f", "é b c d e f"]
    return list(enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"node_limit": 3, "max_depth": 2}, {"node_limit": 2, "max_depth": 0}])
def test_classes_are_those_of_all_pairs(documents, scratch, corpus, limits):
    sizes, classes = _brute(corpus, 4)
    rows = near_duplicates(documents(corpus).repartition(3), scratch, words=4, **limits).collect()
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert {r.doc_id: r.component_id for r in rows} == classes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_repeated_and_null_ids(documents, scratch):
    text = "one two three four five six seven"
    rows = [(None, text), (5, text), (5, text), (9, text + " eight"), (None, "quite another text of some words"), (3, None)]
    classed = near_duplicates(documents(rows), scratch, words=4, percent=50)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in classed.collect()) == [(0, 0), (0, 5), (3, 3), (5, 5), (5, 5), (9, 5)]
    stay = deduplicated(documents(rows), scratch, words=4, percent=50, keep=("source", "row")).collect()
    assert sorted((r.doc_id or 0, r.text, r.source, r.row) for r in stay) == [(0, rows[4][1], "s", 7), (3, None, "s", 7), (5, text, "s", 7)]


def test_no_documents(documents, scratch):
    assert near_duplicates(documents([]), scratch).count() == 0


def test_components_of_a_path_and_a_star(spark, scratch):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    stars = connected_components(spark.createDataFrame(edges, "a long, b long"), scratch)
    found = {r.node: r.root for r in stars.collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


def _vectors():
    rng = np.random.default_rng(4)
    rows = [v.tolist() for v in rng.normal(size=(60, 16))]
    for base in range(0, 20, 2):
        for angle in (0.05, 0.2, 0.3, 0.33):
            other = rng.normal(size=16)
            v = np.array(rows[base])
            other -= other @ v / (v @ v) * v
            other *= np.linalg.norm(v) / np.linalg.norm(other)
            rows.append((np.cos(angle) * v + np.sin(angle) * other).tolist())
    rows += [rows[0], rows[0], [x * 1e-200 for x in rows[2]], [0.0] * 16, [float("nan")] * 16, [None, *rows[3][1:]], None, [], [float("inf"), *rows[3][1:]], rows[1][:15]]
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk", [512, 3])
def test_links_of_vectors(spark, scratch, chunk):
    rows = _vectors()
    fine = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.abs(v).max()
            fine[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in fine for b in fine if b < a and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.95]
    counts = {i: sum(i in p for p in links) for i, _ in rows}
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, label int").repartition(4)
    got = {r.vec_id: r for r in near_embeddings(table, scratch, chunk=chunk).collect()}
    assert {i: r.n_links for i, r in got.items()} == counts
    classes = _classes([i for i, _ in rows], links)
    assert {i: r.component_id for i, r in got.items()} == classes
    assert all(r.kept == (i == classes[i]) for i, r in got.items())


def test_no_vectors(spark, scratch):
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_agree_modulo_powers_of_two_are_not_linked(documents, scratch, size):
    a, b = "a", "b"
    while len(a) < size:
        a, b = a + b, b + a
    rows = {r.doc_id: r for r in near_duplicates(documents([(1, a), (2, b), (3, f"x {a}"), (4, f"x {b}"), (5, b.upper())]), scratch, words=4).collect()}
    assert {i: r.component_id for i, r in rows.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}
