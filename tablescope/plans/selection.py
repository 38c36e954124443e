"""Exact quantiles that never hold a column in one task.

``weighted_quantiles`` ranks a table of distinct values with counts. ``column_quantiles`` first
narrows each column of a frame: one sketch pass brackets every wanted rank, a second pass keeps
exact values inside the brackets and folds everything between two brackets into one counted row.
Only the values inside brackets, about one in a thousand, are shuffled and ranked. A rank that
falls on a folded row (a sketch outside its error bound) is noticed and the column is redone
without folding, so the result is always exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.plans.ordered import BLOCK, SEQ, block_summary, counted, join_summary, ordered_blocks, with_weights_below
from tablescope.plans.small import small_table

SKETCH_ACCURACY = 10_000
FEW_DISTINCT = 20_000  # below this the whole frequency table is cheap to shuffle
COLUMNS_PER_PASS = 40
GRID = 1000  # sketched values per column from which distances are bracketed


def weighted_quantiles(
    freq: DataFrame,
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    value: str = "value",
    weight: str = "weight",
    order: Sequence[str] = (),
    few: bool = False,
) -> DataFrame:
    """Linear-interpolation quantiles per key of distinct ``value`` rows counted by ``weight``.

    Returns ``keys, n, quantiles`` (an array in the order of ``probabilities``). ``order`` may
    name further sort columns after ``value``. ``few`` says that a single sort will do (``ordered.counted``).
    """
    # (index of the probability, 0 for the rank below and 1 for the rank above, rank)
    targets = "array({})".format(
        ", ".join(
            f"struct({i} AS i, {side} AS side, CAST({fn}(CAST({p!r} AS DOUBLE) * (_b_total - 1)) AS BIGINT) AS rank)"
            for i, p in enumerate(probabilities)
            for side, fn in ((0, "floor"), (1, "ceil"))
        )
    )
    if few:
        placed = with_weights_below(freq, [value, *order], {weight: "_below"}, keys, {weight: "_b_total"}, few=True)
        placed = placed.withColumn("_targets", F.expr(targets))
    else:
        blocks = ordered_blocks(freq, [value, *order], keys)
        summary = block_summary(blocks, keys, F.col(weight))
        # Only blocks that hold a wanted rank go on to the running sum.
        wanted = summary.withColumn(
            "_targets", F.expr(f"filter({targets}, t -> t.rank >= _b_before AND t.rank < _b_before + _b_weight)")
        ).filter("size(_targets) > 0")
        inside = Window.partitionBy(BLOCK, *keys).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1)
        placed = join_summary(blocks, wanted, keys).withColumn("_below", F.col("_b_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    hits = placed.withColumn("_hit", F.expr(f"explode(filter(_targets, t -> t.rank >= _below AND t.rank < _below + `{weight}`))"))
    picks = [
        F.expr(f"max(CASE WHEN _hit.i = {i} AND _hit.side = {side} THEN CAST(`{value}` AS DOUBLE) END) AS _v{i}_{side}")
        for i in range(len(probabilities))
        for side in (0, 1)
    ]
    extra = [F.max(c).alias(c) for c in order]
    grouped = hits.groupBy(*keys).agg(F.max("_b_total").alias("n"), *picks, *extra)
    parts = (
        f"_v{i}_0 + (CAST({p!r} AS DOUBLE) * (n - 1) - floor(CAST({p!r} AS DOUBLE) * (n - 1))) * (_v{i}_1 - _v{i}_0)"
        for i, p in enumerate(probabilities)
    )
    return grouped.select(*keys, "n", F.expr(f"array({', '.join(parts)})").alias("quantiles"), *order)


def _brackets(points: Sequence[float]) -> list[tuple[float, float]]:
    """Merge overlapping (low, high) pairs."""
    pairs = sorted(zip(points[0::2], points[1::2], strict=True))
    merged: list[tuple[float, float]] = []
    for low, high in pairs:
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _searched(brackets: Sequence[Sequence[tuple[float, float]]]) -> tuple[int, list[float], list[float]]:
    """``width, lows, highs``: the ends of every column's brackets as two flat lists of ``width`` places a column.

    ``width`` is a power of two above the largest number of brackets. With ``j`` the number of a column's lows that are not above
    a value, ``highs`` has at place ``j`` the end of the last bracket that begins at or before it. Spark puts NaN above all other
    numbers: it fills the places that are left, and a column without brackets is one bracket from minus infinity to NaN.
    """
    shown = [list(b) or [(-math.inf, math.nan)] for b in brackets]
    width = 1 << max(map(len, shown)).bit_length()
    lows = [x for b in shown for x in [*(low for low, _ in b), *[math.nan] * (width - len(b))]]
    highs = [x for b in shown for x in [-math.inf, *(high for _, high in b), *[b[-1][1]] * (width - 1 - len(b))]]
    return width, lows, highs


def _counted(df: DataFrame, names: Sequence[str], brackets: Mapping[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """``c, value, folded, weight`` of the named columns, what lies between two brackets folded into one row at the bracket end below it.

    Brackets are found by halving in one list for all columns, so the generated code has a few lines whatever the number of
    columns and brackets. With a branch for every bracket end of every column it outgrows what the JVM compiles (8,000 bytes
    a method) and runs interpreted, many times slower.
    """
    width, lows, highs = _searched([brackets.get(n, ()) for n in names])
    cells = df.select(F.posexplode(F.array(*names)).alias("c", "value")).filter("value IS NOT NULL")
    lows, highs = (F.array(*[F.lit(x) for x in ends]) for ends in (lows, highs))
    cells = cells.withColumn("_at", F.col("c") * width)
    step = width // 2
    while step:
        cells = cells.withColumn("_at", F.col("_at") + F.when(F.get(lows, F.col("_at") + (step - 1)) <= F.col("value"), step).otherwise(0))
        step //= 2
    cells = cells.withColumn("_high", F.get(highs, F.col("_at")))
    exact = (F.col("_at") > F.col("c") * width) & (F.col("value") <= F.col("_high"))
    cells = cells.select("c", F.when(exact, F.col("value")).otherwise(F.col("_high")).alias("value"), F.when(exact, 0).otherwise(1).alias("folded"))
    return cells.groupBy("c", "value", "folded").agg(F.count("*").alias("weight"))


def _ranked(freq: DataFrame, few: bool, names: Sequence[str], probabilities: Sequence[float]) -> dict[str, tuple[int, list[float], bool]]:
    # A folded row that is asked for would surface as folded = 1 among the picked rows.
    rows = weighted_quantiles(freq, probabilities, ["c"], order=["folded"], few=few).collect()
    return {names[r["c"]]: (r["n"], list(r["quantiles"]), bool(r["folded"])) for r in rows}


Reach = tuple[float, float, float, float]
_ALL: Reach = (-math.inf, math.inf, -1.0, math.inf)


def _reach(grid: Sequence[float], low: float, high: float) -> Reach:
    """The median's bracket, and distances from it between which the median distance must lie.

    ``grid`` are sketched values at even ranks. The share of values within a distance of the median is bounded from both
    sides by the ranks of the grid values around its two ends.
    """
    g = np.array(grid, dtype=np.float64)
    if not np.isfinite([low, high]).all():
        return _ALL
    error, steps = 2.0 / SKETCH_ACCURACY, len(g) - 1
    with np.errstate(invalid="ignore"):
        d = np.unique(np.abs(np.concatenate([g - low, g - high])))
    d = d[np.isfinite(d)]

    def at_most(x: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, np.searchsorted(g, x, side="right") / steps + error)

    def at_least(x: np.ndarray, side: str) -> np.ndarray:
        return np.maximum(0.0, (np.searchsorted(g, x, side=side) - 1) / steps - error)

    upper = at_most(high + d) - at_least(low - d, "left")
    lower = at_least(low + d, "right") - np.minimum(1.0, np.searchsorted(g, high - d, side="left") / steps + error)
    near, far = d[upper < 0.5 - error], d[lower >= 0.5 + error]
    return low, high, float(near.max(initial=-1.0)), float(far.min(initial=math.inf))


def _deviations(freq: DataFrame, few: bool, names: Sequence[str], middles: Mapping[str, float], reach: Mapping[str, Reach]) -> dict[str, tuple[float, bool]]:
    """Median distance from the median out of the counted values, and whether it fell outside what was kept exactly.

    Folded values between the two brackets of distances are nearer than all in them, those outside are farther.
    """
    spark = freq.sparkSession
    rows = [(i, middles[n], reach[n][1] - reach[n][2], reach[n][0] + reach[n][2], *reach[n][2:]) for i, n in enumerate(names) if n in middles]
    known = small_table(spark, rows, "k int, m double, inner_low double, inner_high double, near double, far double")
    d = F.when(F.col("folded") == 0, F.abs(F.col("value") - F.col("m"))).when(F.col("value").between(F.col("inner_low"), F.col("inner_high")) & (F.col("value") < F.col("inner_high")), -1.0)
    told = freq.join(F.broadcast(known), F.col("c") == F.col("k"))  # one row per column
    told = told.select("c", F.coalesce(d, F.lit(math.inf)).alias("value"), "weight", "near", "far")
    lost = ((F.col("value") < F.col("near")) | (F.col("value") > F.col("far"))).cast("int").alias("folded")
    weights = told.groupBy("c", "value", lost).agg(F.sum("weight").alias("weight"))
    return {n: (values[0], missed) for n, (_, values, missed) in _ranked(weights, few, names, [0.5]).items()}


Quantiles = dict[str, tuple[int, list[float]]]


def column_spreads(df: DataFrame, exprs: Mapping[str, Column], probabilities: Sequence[float], deviations: bool = True) -> tuple[Quantiles, dict[str, float]]:
    """Quantiles as ``column_quantiles`` has them, and with ``deviations`` the median distance from the median of each.

    Both come from the same counted values: the sketch brackets the median distance on both sides of the median before the
    median itself is known, and what lies in these brackets is kept exactly in the one pass that keeps the rest.
    ``probabilities`` must then hold 0.5.
    """
    out, spread = {}, {}
    names = list(exprs)
    margin = 4.0 / SKETCH_ACCURACY
    points = [x for p in probabilities for x in (max(0.0, p - margin), min(1.0, p + margin))]
    grid = [i / GRID for i in range(GRID + 1)] if deviations else []
    for start in range(0, len(names), COLUMNS_PER_PASS):
        batch = {f"v{i}": n for i, n in enumerate(names[start : start + COLUMNS_PER_PASS])}
        values = df.select(*[exprs[n].cast("double").alias(v) for v, n in batch.items()])
        asked = ", ".join(map(repr, points + grid))
        sketch = values.agg(
            *[F.expr(f"approx_count_distinct({v}, 0.05) AS d_{v}") for v in batch],
            *[F.expr(f"percentile_approx({v}, array({asked}), {SKETCH_ACCURACY}) AS p_{v}") for v in batch],
        ).first()
        present = [v for v in batch if sketch[f"p_{v}"] is not None]
        if not present:
            continue
        brackets, reach = {}, dict.fromkeys(present, _ALL)
        for v in present:
            known = list(sketch[f"p_{v}"])
            if sketch[f"d_{v}"] <= FEW_DISTINCT:
                continue
            wanted = known[: len(points)]
            if deviations:
                half = 2 * list(probabilities).index(0.5)
                reach[v] = low, high, near, far = _reach(known[len(points) :], wanted[half], wanted[half + 1])
                wanted += [low - far, high - near, low + near, high + far]
            brackets[v] = _brackets(wanted)
        freq, few = counted(_counted(values, present, brackets))
        result, away = _ranked(freq, few, present, probabilities), {}
        middle = list(probabilities).index(0.5) if deviations else 0
        if deviations:
            away = _deviations(freq, few, present, {v: values_of[middle] for v, (_, values_of, folded) in result.items() if not folded}, reach)
        missed = [v for v in present if result[v][2] or away.get(v, (0, deviations))[1]]
        if missed:
            freq, few = counted(_counted(values, missed, {}))
            result |= _ranked(freq, few, missed, probabilities)
            if deviations:
                away |= _deviations(freq, few, missed, {v: result[v][1][middle] for v in missed}, dict.fromkeys(missed, _ALL))
        out |= {batch[v]: result[v][:2] for v in present}
        spread |= {batch[v]: d for v, (d, _) in away.items()}
    return out, spread


def column_quantiles(df: DataFrame, exprs: Mapping[str, Column], probabilities: Sequence[float]) -> Quantiles:
    """``{name: (count, [quantile, ...])}`` of numeric expressions; nulls are skipped.

    The dictionary has one small entry per expression, so its size follows the schema, not the data.
    """
    return column_spreads(df, exprs, probabilities, deviations=False)[0]
