"""Rank correlations at any number of rows and columns, against brute force."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.operators import charts, correlation


def shuffled_rows(spark, run):
    """What ``run`` gives, and the records its stages wrote to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def tau(x, y):
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = x[ok], y[ok]
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    spread = math.sqrt(np.abs(dx).sum()) * math.sqrt(np.abs(dy).sum())
    return (dx * dy).sum() / spread if spread else None


def frame(spark, data):
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in data.T.tolist()], ", ".join(f"x{i} double" for i in range(len(data))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 5), st.integers(1, 9)), max_size=40), st.booleans())
def test_inversions(rows, heavy):
    rows = sorted(rows, key=lambda r: r[0])
    numbers = {g: n for n, g in enumerate(sorted({r[0] for r in rows}))}
    scale = 2**33 if heavy else 1
    group, u, v, w = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
    got = correlation.inversions(np.array([numbers[g] for g in group.tolist()], dtype=np.int64), u.astype(float), v.astype(float), w * scale)
    want = [0] * len(numbers)
    for a, b in combinations(rows, 2):
        if a[0] == b[0] and (a[1] - b[1]) * (a[2] - b[2]) < 0:
            want[numbers[a[0]]] += a[3] * b[3] * scale * scale
    assert got == want


@pytest.mark.parametrize("limits", [{}, {"BLOCK_SHARE": 1, "GRID_WHOLE": 2, "GRID_STEP": 3}, {"MAX_BLOCKS": 2}, {"BLOCK_SHARE": 1, "GRID_WHOLE": 5, "GRID_STEP": 2}])
def test_kendall_on_any_grid(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(correlation, name, value)
    rng = np.random.default_rng(3)
    n = 700
    a = rng.normal(size=n)
    data = np.array([a, a + rng.normal(size=n), np.where(rng.random(n) < 0.4, 1.0, rng.integers(0, 9, n)), -a, np.where(rng.random(n) < 0.3, np.nan, rng.random(n)), np.full(n, 2.0)])
    got = {(r.i, r.j): r for r in correlation.kendall(frame(spark, data), [f"x{i}" for i in range(len(data))]).collect()}
    assert len(got) == 15
    for (i, j), r in got.items():
        want = tau(data[i], data[j])
        assert (r.correlation is None) == (want is None) and (want is None or abs(r.correlation - want) < 1e-12)


def test_kendall_moves_each_cell_a_few_times(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    df = frame(spark, rng.random((2, n))).repartition(4).cache()
    df.count()
    rows, moved = shuffled_rows(spark, lambda: correlation.kendall(df, ["x0", "x1"]).collect())
    assert rows[0].sample_size == n and abs(rows[0].correlation) < 0.05
    assert moved < 12 * n  # folding, two blocks, ties of both sides; once per bit would be 15 times as much alone
    df.unpersist()


def test_kendall_moves_a_row_once_a_column(spark):
    rng = np.random.default_rng(5)
    n = 10_000
    data = rng.random((5, n))
    data[4] = rng.integers(0, 7, n)  # nothing to compare in blocks of one value
    df = frame(spark, data).repartition(4).cache()
    df.count()
    rows, moved = shuffled_rows(spark, lambda: correlation.kendall(df, [f"x{i}" for i in range(5)]).collect())
    assert len(rows) == 10 and all(r.sample_size == n for r in rows)
    assert moved < 9 * n  # four rows and the grid; a cell for every pair, and two of them for blocks, would be over 20
    df.unpersist()


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=120), st.sampled_from([(1, 8), (2, 3), (4, 1024)]))
@settings(max_examples=100, deadline=None)
def test_wrong_order_in_tiles(rows, tiles):
    u, v = np.array(rows, dtype=np.int64).T
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(correlation, "TILE", tiles[0])
        patch.setattr(correlation, "TILES", tiles[1])
        got = correlation.wrong_order(u, v)
    pairs = list(combinations(rows, 2))
    assert got == (sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for a, b in pairs), sum(a == b for a, b in pairs))


@pytest.mark.parametrize("masks", [0, 1, 3])
def test_spearman_with_any_missing_values(spark, masks):
    rng = np.random.default_rng(masks)
    data = rng.integers(0, 30, (6, 400)).astype(float)
    data[1] += data[0]
    holes = [rng.random(400) < 0.3 for _ in range(masks)]
    for i, hole in enumerate(holes):
        data[i, hole] = np.nan
        data[5 - i, hole] = np.nan  # two columns that miss the same rows
    names = [f"x{i}" for i in range(6)]
    want = pd.DataFrame(data.T).corr("spearman", min_periods=3)
    got = correlation.spearman(frame(spark, data), names).collect()
    assert len(got) == 15
    for r in got:
        assert r.sample_size == int((~np.isnan(data[r.i]) & ~np.isnan(data[r.j])).sum())
        assert abs(r.correlation - want.loc[r.i, r.j]) < 1e-12


def test_spearman_of_nothing_in_common(spark):
    data = np.array([[1, 2, 3, np.nan, np.nan, np.nan], [np.nan, np.nan, np.nan, 1, 2, 3], [1, 1, 1, 1, 1, 1], [np.nan] * 6])
    got = {(r.i, r.j): (r.status, r.reason) for r in correlation.spearman(frame(spark, data), [f"x{i}" for i in range(4)]).collect()}
    assert set(got.values()) == {("skipped", "insufficient_samples"), ("skipped", "constant_variable_y")}
    assert got[0, 1][1] == "insufficient_samples" and got[0, 2][1] == "constant_variable_y"


def test_thirty_columns_move_as_thirty(spark):
    """Rows that travel follow the number of columns and not the number of their pairs, missing values or not."""
    rng = np.random.default_rng(8)
    n = 3000
    data = rng.normal(size=(30, n))
    for i in range(0, 30, 3):
        data[i, rng.random(n) < 0.1] = np.nan
    df = frame(spark, data).repartition(4).cache()
    df.count()
    names = [f"x{i}" for i in range(30)]
    want = pd.DataFrame(data.T).corr("spearman")
    rows, moved = shuffled_rows(spark, lambda: correlation.spearman(df, names).collect())
    assert len(rows) == 435 and max(abs(r.correlation - want.loc[r.i, r.j]) for r in rows) < 1e-12
    assert moved < 10 * 30 * n  # one copy a pair would be 435 * n for each of several steps
    rows, moved = shuffled_rows(spark, lambda: correlation.pearson(df, names).collect())
    plain = pd.DataFrame(data.T).corr()
    assert max(abs(r.correlation - plain.loc[r.i, r.j]) for r in rows) < 1e-9 and moved < 1000
    rows, moved = shuffled_rows(spark, lambda: charts.scatter_fits(df, names).collect())
    assert len(rows) == 435 and moved < 1000
    df.unpersist()
