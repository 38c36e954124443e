"""Pearson, Spearman and Kendall correlation with pairwise deletion.

Results are long tables: ``method, x, y, i, j, correlation, p_value, sample_size, status, reason``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.clean import finite
from tablescope.functions.pvalues import correlation_p_value, normal_p_value
from tablescope.plans.materialize import materialize, settled
from tablescope.plans.ordered import counted, with_weights_below
from tablescope.plans.small import small_table
from tablescope.plans.wide import quoted
from tablescope.plans.workers import importable

STRONG, MODERATE = 0.7, 0.4
MEASURES_PER_PASS = 400
PAIR_MEASURES_PER_PASS = 30  # more of these fall out of generated code
PAIR_MEASURES = {
    "n": "long", "cov": "double", "std_x": "double", "std_y": "double", "mean_x": "double", "mean_y": "double", "x_min": "double", "x_max": "double",
    "y_min": "double", "y_max": "double",
}
# Kendall: blocks of a column are about BLOCK_SHARE square roots of the rows long; a grid of at most GRID_WHOLE borders is one
# task's work for a pair of columns, a wider one is cut again, every GRID_STEP blocks. Inside a block, at most TILES stretches of
# TILE places or more are compared place by place.
BLOCK_SHARE, MAX_BLOCKS, GRID_WHOLE, GRID_STEP = 8, 50_000, 500, 16
TILE, TILES = 96, 512


def column_pairs(columns: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]


def _clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as finite doubles ``c0, c1, ...``; nothing else is read."""
    return df.select(*[finite(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)])


def _both(i: int, j: int, c: int, prefix: str = "c") -> Column:
    """Values of column ``c`` where both columns of the pair are present."""
    other = j if c == i else i
    return F.when(F.col(f"{prefix}{other}").isNotNull(), F.col(f"{prefix}{c}"))


def pair_measures(i: int, j: int) -> dict[str, Column]:
    """What the rows of a pair of columns add up to; rows that lack either are left out."""
    x, y = _both(i, j, i), _both(i, j, j)
    return {
        "n": F.count(x), "cov": F.covar_pop(x, y), "std_x": F.stddev_pop(x), "std_y": F.stddev_pop(y), "mean_x": F.avg(x), "mean_y": F.avg(y),
        "x_min": F.min(x), "x_max": F.max(x), "y_min": F.min(y), "y_max": F.max(y),
    }


def pair_table(clean: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """``i, j`` and the measures of every pair of columns ``c0, c1, ...``; a scan for every ``PAIR_MEASURES_PER_PASS`` of them.

    No row is copied: each pass is one row of aggregates over the columns of its pairs.
    """
    rows, step = [], max(1, PAIR_MEASURES_PER_PASS // len(PAIR_MEASURES))
    for start in range(0, len(pairs), step):
        batch = pairs[start : start + step]
        row = clean.agg(*[m.alias(f"{k}_{p}") for p, (i, j) in enumerate(batch) for k, m in pair_measures(i, j).items()]).first()
        rows += [(i, j, *[row[f"{k}_{p}"] for k in PAIR_MEASURES]) for p, (i, j) in enumerate(batch)]
    # One row per pair of columns.
    return small_table(clean.sparkSession, rows, "i int, j int, " + ", ".join(f"{k} {t}" for k, t in PAIR_MEASURES.items()))


def _pearson_table(measures: DataFrame) -> DataFrame:
    return measures.select(
        "i", "j", "n", F.coalesce(F.col("x_min") == F.col("x_max"), F.lit(True)).alias("flat_x"),
        F.coalesce(F.col("y_min") == F.col("y_max"), F.lit(True)).alias("flat_y"),
        # corr() itself divides by zero on constant columns under ANSI rules
        F.try_divide("cov", F.col("std_x") * F.col("std_y")).alias("r"),
    )


def _reasons() -> Column:
    return (
        F.when(F.col("n") < 3, "insufficient_samples")
        .when(F.col("flat_x"), "constant_variable_x")
        .when(F.col("flat_y"), "constant_variable_y")
    )


def _named(table: DataFrame, method: str, columns: Sequence[str], p_value: Column) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    ok = F.col("reason").isNull()
    return table.select(
        F.lit(method).alias("method"), F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), "i", "j",
        F.when(ok, F.col("r")).alias("correlation"), F.when(ok, p_value).alias("p_value"),
        F.when(ok, F.col("n")).otherwise(0).cast("long").alias("sample_size"),
        F.when(ok, "ok").otherwise("skipped").alias("status"), "reason",
    )


def _finished(table: DataFrame) -> DataFrame:
    """Bound r to [-1, 1] and name pairs whose r is not a number."""
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), finite(F.col("r"))))
    return table.withColumn("r", F.when(finite(F.col("r")).isNotNull(), r)).withColumn(
        "reason", F.coalesce(_reasons(), F.when(F.col("r").isNull(), "non_finite_correlation"))
    )


def pearson(df: DataFrame, columns: Sequence[str], measures: DataFrame | None = None) -> DataFrame:
    """Every pair; ``measures`` is its ``pair_table`` where that is at hand."""
    measures = pair_table(_clean(df, columns), column_pairs(columns)) if measures is None else measures
    return _named(_finished(_pearson_table(measures)), "pearson", columns, correlation_p_value("r", "n"))


def presence_classes(clean: DataFrame, columns: int) -> list[int]:
    """For each column the first one that is present in exactly the same rows."""
    here = [F.col(f"c{i}").isNotNull() for i in range(columns)]
    counts = clean.agg(*[F.count_if(p).alias(f"p{i}") for i, p in enumerate(here)]).first()
    # Only columns of equal counts can be alike.
    asked = [(i, j) for i, j in column_pairs(range(columns)) if counts[i] == counts[j]]
    alike = {}
    for start in range(0, len(asked), MEASURES_PER_PASS):
        batch = asked[start : start + MEASURES_PER_PASS]
        row = clean.agg(*[F.coalesce(F.bool_and(here[i] == here[j]), F.lit(True)).alias(f"a{k}") for k, (i, j) in enumerate(batch)]).first()
        alike |= dict(zip(batch, row, strict=True))
    return [next((i for i in range(j) if alike.get((i, j))), j) for j in range(columns)]


def _rank_table(clean: DataFrame, columns: int, classes: Sequence[int]) -> DataFrame:
    """``c, value`` and for every class of presence ``w_q`` (rows of the value where the class is present) and ``d_q``: the
    value's average rank among those rows, less the middle rank of all of them.

    Values are counted first, then put in order once per column, whatever the number of partners; each class has its own
    running count along that one order.
    """
    kinds = sorted(set(classes))
    entries = ", ".join(f"struct({i} AS c, c{i} AS value)" for i in range(columns))
    here = [F.col(f"c{q}").isNotNull().cast("long").alias(f"w_{q}") for q in kinds]
    cells = clean.select(*here, F.expr(f"inline(array({entries}))")).filter("value IS NOT NULL")
    freq = cells.groupBy("c", "value").agg(*[F.sum(f"w_{q}").alias(f"w_{q}") for q in kinds])
    weights = {f"w_{q}": f"b_{q}" for q in kinds}
    freq, few = counted(freq)
    placed = with_weights_below(freq, ["value"], weights, ["c"], {f"w_{q}": f"t_{q}" for q in kinds}, few)
    centred = [(F.col(f"b_{q}") + (F.col(f"w_{q}") - F.col(f"t_{q}")) / 2.0).alias(f"d_{q}") for q in kinds]
    return settled(placed.select("c", "value", *[f"w_{q}" for q in kinds], *centred))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every pair over the rows where both are present, ranked among those rows.

    A value's rank in a pair depends on the partner only by the rows where that is missing, so ranks are kept per column
    and class of partners that miss the same rows. Ranks of a pair average its middle rank, which is taken off beforehand:
    one sum of products per pair is all that the rows are read for.
    """
    k, pairs = len(columns), column_pairs(columns)
    clean = _clean(df, columns)
    classes = presence_classes(clean, k)
    ranks = _rank_table(clean, k, classes)
    kinds = sorted(set(classes))
    w, d = (lambda q: F.col(f"w_{q}")), (lambda q: F.col(f"d_{q}"))
    sums = ranks.groupBy("c").agg(
        *[F.sum(w(q)).alias(f"n_{q}") for q in kinds], *[F.sum(w(q) * d(q) * d(q)).alias(f"s_{q}") for q in kinds],
        *[(F.count_if(w(q) > 0) <= 1).alias(f"flat_{q}") for q in kinds],
    )
    side = {r["c"]: r for r in sums.collect()}  # one row per column
    rows = clean.select(*[f"c{i}" for i in range(k)])
    for i in range(k):
        wanted = sorted({classes[j] for j in range(k) if j != i})
        table = ranks.filter(F.col("c") == i).select(F.col("value").alias(f"v{i}"), *[F.col(f"d_{q}").alias(f"d{i}_{q}") for q in wanted])
        # A shuffle join where the table is large: adaptive execution splits hot values.
        rows = rows.join(table, F.col(f"c{i}") == F.col(f"v{i}"), "left").drop(f"c{i}", f"v{i}")
    if len(pairs) > MEASURES_PER_PASS:
        rows = materialize(rows)
    found = []
    for start in range(0, len(pairs), MEASURES_PER_PASS):
        batch = pairs[start : start + MEASURES_PER_PASS]
        row = rows.agg(*[F.sum(F.col(f"d{i}_{classes[j]}") * F.col(f"d{j}_{classes[i]}")).alias(f"p{p}") for p, (i, j) in enumerate(batch)]).first()
        for p, (i, j) in enumerate(batch):
            x, y = (side[a].asDict() if a in side else {} for a in (i, j))
            n = x.get(f"n_{classes[j]}", 0)
            spread = ((x.get(f"s_{classes[j]}") or 0.0) * (y.get(f"s_{classes[i]}") or 0.0)) ** 0.5
            flat = x.get(f"flat_{classes[j]}", True), y.get(f"flat_{classes[i]}", True)
            found.append((i, j, n, *flat, row[p] / spread if spread and row[p] is not None else None))
    table = small_table(df.sparkSession, found, "i int, j int, n long, flat_x boolean, flat_y boolean, r double")
    return _named(_finished(table), "spearman", columns, correlation_p_value("r", "n"))


def _ties(cells: DataFrame, side: str) -> DataFrame:
    """Per pair of columns, of the blocks that are one value: tied pairs of rows, the two sums that ties take part in the variance with, and the number of values."""
    t = F.col("t").cast("decimal(38,0)")
    d = F.col("t").cast("double")
    groups = cells.filter(F.col(side) % 2 == 1).groupBy("pair", side).agg(F.sum("w").alias("t"))
    return groups.groupBy("pair").agg(
        F.sum((t * (t - 1) / 2).cast("decimal(38,0)")).alias(f"heavy_{side}"), F.sum(d * (d - 1) * (d - 2)).alias(f"heavy_thirds_{side}"),
        F.sum(d * (d - 1) * (2 * d + 5)).alias(f"heavy_spread_{side}"), F.count("*").alias(f"heavy_kinds_{side}"),
    )


def _block_borders(clean: DataFrame, columns: int) -> list[np.ndarray]:
    """Values that part each column into blocks of about equal numbers of rows.

    They only deal out work: a block holds at most one ``blocks``-th of the rows, about, and no result depends on it.
    """
    rows = clean.count()
    blocks = max(2, min(MAX_BLOCKS, math.isqrt(rows) // BLOCK_SHARE))
    points = ", ".join(repr(b / blocks) for b in range(1, blocks))
    row = clean.agg(*[F.expr(f"percentile_approx(c{i}, array({points}), {max(10_000, 4 * blocks)})").alias(f"b{i}") for i in range(columns)]).first()
    return [np.unique(np.array(b or [], dtype=np.float64)) for b in row]


def _blocks_of(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Odd numbers for the border values themselves, even ones for what lies between: a value shared by many rows is a block of its own."""
    left = np.searchsorted(borders, values, side="left")
    if not len(borders):
        return left.astype(np.int64)
    at = borders[np.minimum(left, len(borders) - 1)] == values
    return (2 * left + at).astype(np.int64)


_SIDE_BITS = 40  # the number of a block is below this bit


def _dealt_rows(clean: DataFrame, borders: Sequence[np.ndarray]) -> DataFrame:
    """``at, c0, c1, ..., w``: each row once for every column in which it lies in a block of several values, whatever the number of pairs.

    Of pairs of columns in which a row lies in blocks of one value there is nothing to compare: only how many rows such two
    blocks share is told, with the numbers of the blocks in ``c0`` and ``c1`` and rows in ``w``.
    """
    k = len(borders)
    pairs = column_pairs(range(k))
    names = ["at", *[f"c{i}" for i in range(k)], "w"]

    def shared(counts: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for p, parts in counts.items():
            i, j = pairs[p]
            wide = 2 * len(borders[j]) + 1
            code, w = _folded(parts)
            cells = [code // wide, code % wide]
            columns = [np.full(len(code), (k + p) << _SIDE_BITS) | (code & ((1 << _SIDE_BITS) - 1)), *[c.astype(np.float64) for c in cells], *[np.full(len(code), np.nan)] * (k - 2), w]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)]
            here = [~np.isnan(v) for v in values]
            blocks = [_blocks_of(v, b) for v, b in zip(values, borders, strict=True)]
            present = np.sum(here, axis=0)
            for i in range(k):
                own = np.flatnonzero(here[i] & (blocks[i] % 2 == 0) & (present > 1))
                if len(own):
                    columns = [blocks[i][own] | (i << _SIDE_BITS), *[v[own] for v in values], np.ones(len(own), dtype=np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            heavy = [h & (b % 2 == 1) for h, b in zip(here, blocks, strict=True)]
            for p, (i, j) in enumerate(pairs):
                both = heavy[i] & heavy[j]
                if both.any():
                    code, w = np.unique(blocks[i][both] * (2 * len(borders[j]) + 1) + blocks[j][both], return_counts=True)
                    counts.setdefault(p, []).append((code, w))
                    held += len(code)
            if held > _HELD_CELLS:
                counts = {p: [_folded(parts)] for p, parts in counts.items()}
                held = sum(len(parts[0][0]) for parts in counts.values())
                if held > _HELD_CELLS // 2:
                    yield from shared(counts)
                    counts, held = {}, 0
        yield from shared(counts)

    schema = ", ".join(["at long", *[f"c{i} double" for i in range(k)], "w long"])
    return clean.mapInArrow(run, schema)


_HELD_CELLS = 1_000_000


def _folded(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of cells without repetition and how many rows each has."""
    codes, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
    code, where = np.unique(codes, return_inverse=True)
    w = np.zeros(len(code), dtype=np.int64)
    np.add.at(w, where.reshape(-1), weights)
    return code, w


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of the values among the different ones, and how many of these there are."""
    order = np.argsort(values)
    ranked = values[order]
    step = np.ones(len(values), dtype=np.int64)
    step[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.cumsum(step) - 1
    return out, int(out[order[-1]]) + 1 if len(values) else 0


def wrong_order(u: np.ndarray, v: np.ndarray) -> tuple[int, int]:
    """How many pairs of rows ``u`` and ``v`` (whole numbers from 0) order the other way round, and how many agree in both, exactly.

    Rows in the order of (u, v) are cut into stretches of places and into stretches of ranks by v. Two rows that share neither are
    counted on the table of both, the others place by place inside the stretch that they share.
    """
    m = len(u)
    if m < 2:
        return 0, 0
    bits = int(v.max()).bit_length()
    key = np.sort((u.astype(np.int64) << bits) | v)
    runs = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
    same = int((runs * (runs - 1) // 2).sum())
    size = max(TILE, -(-m // TILES))
    tiles = -(-m // size)
    full = tiles * size
    bits_of_place = full.bit_length()
    # Equal values by v keep their order; what fills up the last stretch comes after all.
    place = np.arange(full, dtype=np.int64)
    place[:m] = np.sort(((key & ((1 << bits) - 1)) << bits_of_place) | place[:m]) & ((1 << bits_of_place) - 1)
    kind = np.uint16 if full < 1 << 16 else np.int32
    rank = np.empty(full, dtype=kind)
    rank[place] = np.arange(full, dtype=kind)
    lost, by_place = 0, rank.reshape(tiles, size)
    by_rank = (place // size).astype(np.uint16).reshape(tiles, size)
    for d in range(1, min(size, m)):
        lost += int(np.count_nonzero(by_place[:, :-d] > by_place[:, d:])) + int(np.count_nonzero(by_rank[:, :-d] > by_rank[:, d:]))
    if tiles > 1:
        table = np.bincount(np.repeat(np.arange(tiles), size) * tiles + rank // size, minlength=tiles * tiles).reshape(tiles, tiles)
        # Of each cell: rows in later stretches of places and earlier ones of ranks.
        later = table[::-1].cumsum(axis=0)[::-1][1:, :-1].cumsum(axis=1)
        lost += int((table[:-1, 1:] * later).sum())
    return lost, same


_SUMS = {"lost": "decimal(38,0)", "tied_both": "decimal(38,0)", "tied_x": "decimal(38,0)", "tied_y": "decimal(38,0)"} | {
    f"{k}_{s}": t for s in ("x", "y") for k, t in (("thirds", "double"), ("spread", "double"), ("kinds", "long"))}


def _in_blocks_of_rows(dealt: DataFrame, borders: Sequence[np.ndarray]) -> DataFrame:
    """``pair, x, y, w``: rows of each cell of the grid of block numbers; and with null there, what the blocks of a task add up to.

    Every cell is told by one block: that of x, or that of y where the block of x is one value, or by none of both.
    """
    k = len(borders)
    pairs = column_pairs(range(k))
    number = {ij: p for p, ij in enumerate(pairs)}
    names = ["pair", "x", "y", "w", *_SUMS]
    kinds = {"decimal(38,0)": pa.decimal128(38, 0), "double": pa.float64(), "long": pa.int64()}

    def cells(p: np.ndarray | int, x: np.ndarray | int, y: np.ndarray | int, w: np.ndarray) -> pa.RecordBatch:
        n = len(w)
        columns = [np.broadcast_to(np.asarray(p, dtype=np.int32), n), *[np.broadcast_to(np.asarray(c, dtype=np.int64), n) for c in (x, y, w)]]
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], *[pa.nulls(n, kinds[t]) for t in _SUMS.values()]], names=names)

    def counted(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.bincount(block)
        found = np.flatnonzero(w)
        return found, w[found]

    def tied(sums: dict, side: str, ranks: np.ndarray) -> None:
        t = np.bincount(ranks)
        t = t[t > 0]
        d = t.astype(np.float64)
        sums[f"tied_{side}"] += int((t * (t - 1) // 2).sum())
        sums[f"thirds_{side}"] += float((d * (d - 1) * (d - 2)).sum())
        sums[f"spread_{side}"] += float((d * (d - 1) * (2 * d + 5)).sum())
        sums[f"kinds_{side}"] += len(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, dict] = {}

        def looked_at(group: pa.Table) -> Iterator[pa.RecordBatch]:
            at = group.column("at")[0].as_py()
            side, block = at >> _SIDE_BITS, at & ((1 << _SIDE_BITS) - 1)
            values = [group.column(f"c{i}").to_numpy() for i in range(k)]
            own, _ = _dense(values[side])
            for j in range(k):
                here = ~np.isnan(values[j])
                if j == side or not here.any():
                    continue
                whole = here.all()
                mine, other = (own, values[j]) if whole else (own[here], values[j][here])
                p = number[min(side, j), max(side, j)]
                s = sums.setdefault(p, dict.fromkeys(_SUMS, 0))
                met = _blocks_of(other, borders[j])
                if side < j:
                    tied(s, "x", mine)
                    lost, same = wrong_order(mine, _dense(other)[0])
                    s["lost"] += lost
                    s["tied_both"] += same
                    found, w = counted(met)
                    yield cells(p, block, found, w)
                else:
                    tied(s, "y", mine)
                    s["lost"] += wrong_order(met, mine)[0]
                    if (heavy := met % 2 == 1).any():
                        s["tied_both"] += _same(met[heavy], mine[heavy])
                        found, w = counted(met[heavy])
                        yield cells(p, found, block, w)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).to_numpy(zero_copy_only=False)
            # Cells that two blocks of one value share come after all blocks.
            last = int(np.searchsorted(at, k << _SIDE_BITS))
            if last < len(at):
                x, y, w = (batch.column(i).to_numpy(zero_copy_only=False)[last:].astype(np.int64) for i in (1, 2, k + 1))
                yield cells((at[last:] >> _SIDE_BITS) - k, x, y, w)
                batch, at = batch.slice(0, last), at[:last]
            if not last:
                continue
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                # A block that goes on in the next batch waits for it.
                if held and held[-1].column(0)[0].as_py() != at[a]:
                    yield from looked_at(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from looked_at(pa.Table.from_batches(held))
        if sums:
            columns = [pa.array(list(sums), pa.int32()), *[pa.nulls(len(sums), pa.int64())] * 3]
            for name, t in _SUMS.items():
                columns.append(pa.array([Decimal(s[name]) if t.startswith("decimal") else s[name] for s in sums.values()], kinds[t]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(["pair int, x long, y long, w long", *[f"{n} {t}" for n, t in _SUMS.items()]])
    return dealt.repartition("at").sortWithinPartitions("at").mapInArrow(run, schema)


def _same(u: np.ndarray, v: np.ndarray) -> int:
    """Pairs of rows that agree in both."""
    key = np.sort((u.astype(np.int64) << int(v.max()).bit_length()) | v)
    runs = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
    return int((runs * (runs - 1) // 2).sum())


_SIDED = "pair int, side int, block long, u double, v double, w long"


def _dealt_to_blocks(cells: DataFrame, borders: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Each cell once for its block of x and once for its block of y, and once (``side`` 2) with both block numbers.

    A block of one value has nothing to compare: its cells are tied there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, x, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for p in np.unique(pair).tolist():
                own = pair == p
                px, py = _blocks_of(x[own], borders[p][0]), _blocks_of(y[own], borders[p][1])
                a, b = px % 2 == 0, py % 2 == 0
                parts = [(0, px[a], x[own][a], y[own][a], w[own][a]), (1, py[b], px[b], y[own][b], w[own][b]), (2, px, px, py, w[own])]
                for side, block, u, v, weight in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(u), p), pa.int32()), pa.array(np.full(len(u), side), pa.int32()), pa.array(block, pa.int64()),
                         pa.array(u.astype(np.float64)), pa.array(v.astype(np.float64)), pa.array(weight, pa.int64())],
                        names=["pair", "side", "block", "u", "v", "w"])

    return cells.mapInArrow(run, _SIDED)


def inversions(group: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[int]:
    """Per group (numbered from 0, ascending) the weight of pairs of rows that ``u`` and ``v`` order the other way round, exactly.

    Rows are put in the order of (u, v). Two of them are out of order exactly if, at the first bit in which their ranks by v
    differ, the earlier one has a one: at every bit each zero adds up the ones before it that agree with it in the bits above.
    """
    groups = int(group[-1]) + 1 if len(group) else 0
    by_v = np.lexsort((v, group))
    new = np.ones(len(v), dtype=bool)
    new[1:] = (np.diff(v[by_v]) != 0) | (np.diff(group[by_v]) != 0)
    rank = np.empty(len(v), dtype=np.int64)
    rank[by_v] = np.cumsum(new) - 1
    order = np.lexsort((v, u, group))
    group, rank, w = group[order], rank[order], w[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
    # Ranks start anew in each group, so that the bits above tell groups apart only by the group's own number.
    rank -= np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(rank)))) if len(rank) else 0
    bits = int(rank.max(initial=0)).bit_length()
    wide = float(w.sum(dtype=np.float64)) ** 2 >= 2.0**62
    out = [0] * groups
    above = group
    for bit in range(bits - 1, -1, -1):
        # Rows stay in the order of (bits above, u, v): a stable sort by the next bit keeps it.
        one = (rank >> bit) & 1
        ones = np.cumsum(w * one)
        start = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        base = np.repeat((ones - w * one)[start], np.diff(np.append(start, len(above))))
        lost = (ones - base) * (1 - one)
        for g, part in _per_group(group, lost, w, wide):
            out[g] += part
        order = np.argsort(above * 2 + one, kind="stable")
        above, group, rank, w = (above * 2 + one)[order], group[order], rank[order], w[order]
    return out


def _per_group(group: np.ndarray, a: np.ndarray, w: np.ndarray, wide: bool) -> Iterator[tuple[int, int]]:
    """Sums of ``a * w`` by group; rows of a group stand together. With whole numbers of any size where 64 bits might not do."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    product = a.astype(object) * w.astype(object) if wide else a * w
    for g, total in zip(group[start].tolist(), np.add.reduceat(product, start).tolist(), strict=True):
        yield g, int(total)


def _in_blocks(dealt: DataFrame) -> DataFrame:
    """``pair, lost``: pairs of rows in the wrong order, added up block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def added(batch: pa.RecordBatch) -> pa.RecordBatch:
            pair, side, block, u, v, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            new = np.ones(len(pair), dtype=bool)
            new[1:] = (np.diff(pair) != 0) | (np.diff(side) != 0) | (np.diff(block) != 0)
            lost = inversions(np.cumsum(new) - 1, u, v, w)
            return pa.RecordBatch.from_arrays([pa.array(pair[new], pa.int32()), pa.array([Decimal(x) for x in lost], pa.decimal128(38, 0))], names=["pair", "lost"])

        # Blocks are sorted; a block that goes on in the next batch waits for it.
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
            whole = held and any(held[-1].column(i)[-1].as_py() != k[0] for i, k in enumerate(key))
            if whole:
                yield added(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield added(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield added(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return dealt.repartition("pair", "side", "block").sortWithinPartitions("pair", "side", "block").mapInArrow(run, "pair int, lost decimal(38,0)")


def _coarse(cuts: Mapping[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Borders on a grid of block numbers: none if one task may hold a pair of columns' cells."""
    if max((max(len(a), len(b)) for a, b in cuts.values()), default=0) <= GRID_WHOLE:
        return {p: (np.zeros(0), np.zeros(0)) for p in cuts}
    return {p: tuple(2.0 * np.arange(GRID_STEP, len(c) + 1, GRID_STEP) for c in both) for p, both in cuts.items()}


def _discordant(level: DataFrame, cuts: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs of rows that x and y order the other way round, of counted cells ``pair, x, y, w``: ``pair, discordant``.

    x and y are cut into blocks. Two rows in different blocks of both are counted on the grid of block numbers; two in one
    block of x, or in one of y only, are counted inside that block. So each cell travels twice, whatever the number of rows.
    The grid is counted in the same way, its numbers being the values: it holds far fewer cells, and once they are few
    enough per pair of columns one block holds them.
    """
    lost = None
    while True:
        # With no border left all cells of a pair are one block of x, and nothing is left for the grid.
        dealt = settled(_dealt_to_blocks(level, cuts))
        part = _in_blocks(dealt.filter("side < 2"))
        lost = part if lost is None else lost.unionAll(part)
        if not max((max(len(a), len(b)) for a, b in cuts.values()), default=0):
            break
        level = dealt.filter("side = 2").groupBy("pair", F.col("u").alias("x"), F.col("v").alias("y")).agg(F.sum("w").alias("w"))
        cuts = _coarse(cuts)
    return lost.groupBy("pair").agg(F.sum("lost").cast("decimal(38,0)").alias("discordant"))


def kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tau-b of every pair at any number of rows; p-values by the normal limit with its correction for ties.

    Each column is cut into blocks of values. A row travels once a column, to its block there, which looks at all partners:
    pairs of rows in one block of x, or in one of y only, are compared inside it, and all others on the grid of block numbers,
    which has far fewer cells than there are rows. Blocks of one value have nothing to compare and are only counted.
    """
    pairs = column_pairs(columns)
    clean = _clean(df, columns)
    importable(df.sparkSession)
    borders = _block_borders(clean, len(columns))
    parts = settled(_in_blocks_of_rows(_dealt_rows(clean, borders), borders))
    cells = settled(parts.filter("w IS NOT NULL").groupBy("pair", "x", "y").agg(F.sum("w").alias("w")))
    inside = parts.filter("w IS NULL").groupBy("pair").agg(*[F.sum(name).cast(t).alias(name) for name, t in _SUMS.items()])
    w = F.col("w").cast("decimal(38,0)")
    sizes = cells.groupBy("pair").agg(
        F.sum("w").alias("n"), F.sum(F.when((F.col("x") % 2 == 1) & (F.col("y") % 2 == 1), (w * (w - 1) / 2).cast("decimal(38,0)"))).alias("heavy_both"))
    grid = _discordant(cells.select("pair", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "w"),
        _coarse({p: (borders[i], borders[j]) for p, (i, j) in enumerate(pairs)}))
    found = sizes
    for part in (inside, _ties(cells, "x"), _ties(cells, "y"), grid):
        found = found.join(part, "pair", "left")
    found = settled(found.fillna(0))
    added = lambda a, b: (F.col(a) + F.col(b)).cast("decimal(38,0)")
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    found = found.select(
        names[F.col("pair")]["i"].alias("i"), names[F.col("pair")]["j"].alias("j"), "n", added("tied_both", "heavy_both").alias("tied_both"),
        added("lost", "discordant").alias("discordant"), *[added(f"tied_{s}", f"heavy_{s}").alias(f"tied_{s}") for s in ("x", "y")],
        *[(F.col(f"{k}_{s}") + F.col(f"heavy_{k}_{s}")).alias(f"{k}_{s}") for k in ("thirds", "spread") for s in ("x", "y")],
        *[(F.col(f"kinds_{s}") + F.col(f"heavy_kinds_{s}") == 1).alias(f"flat_{s}") for s in ("x", "y")],
    )
    n, big = F.col("n").cast("double"), F.col("n").cast("decimal(38,0)")
    all_pairs = (big * (big - 1) / 2).cast("decimal(38,0)")
    score = (all_pairs - F.col("tied_x") - F.col("tied_y") + F.col("tied_both") - 2 * F.col("discordant")).cast("double")
    tau = F.try_divide(F.try_divide(score, F.sqrt((all_pairs - F.col("tied_x")).cast("double"))), F.sqrt((all_pairs - F.col("tied_y")).cast("double")))
    m = n * (n - 1.0)
    variance = (
        (m * (2 * n + 5) - F.col("spread_x") - F.col("spread_y")) / 18
        + F.try_divide(2.0 * F.col("tied_x").cast("double") * F.col("tied_y").cast("double"), m)
        + F.try_divide(F.col("thirds_x") * F.col("thirds_y"), 9 * m * (n - 2))
    )
    table = found.select(
        "i", "j", "n", "flat_x", "flat_y", tau.alias("r"), normal_p_value(F.try_divide(F.abs(score), F.sqrt(F.greatest(variance, F.lit(0.0))))).alias("p")
    )
    wanted = small_table(df.sparkSession, pairs, "i int, j int")
    table = wanted.join(table, ["i", "j"], "left").fillna(0, ["n"]).fillna(True, ["flat_x", "flat_y"])
    return _named(_finished(table), "kendall", columns, F.col("p"))


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def matrix_of(pairs: DataFrame, single: Mapping[str, tuple[int, bool]]) -> DataFrame:
    """Symmetric matrix in long form: both triangles of ``pairs`` plus the diagonal.

    ``single`` has for every column the number of its values and whether they vary.
    """
    methods = [r["method"] for r in pairs.select("method").distinct().collect()]
    selves = small_table(
        pairs.sparkSession, [(m, c, c, 1.0 if varies else None, 0.0 if varies else None, n if n >= 2 else None) for m in methods for c, (n, varies) in single.items()],
        "method string, x string, y string, correlation double, p_value double, sample_size long",
    )
    ok = F.col("status") == "ok"
    upper = pairs.select("method", "x", "y", "correlation", "p_value", F.when(ok, F.col("sample_size")).alias("sample_size"))
    lower = upper.select("method", F.col("y").alias("x"), F.col("x").alias("y"), "correlation", "p_value", "sample_size")
    return upper.unionByName(lower).unionByName(selves)


def correlation_matrix(pairs: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``matrix_of`` with the columns' numbers of values found in one scan."""
    clean = _clean(df, columns)
    row = clean.agg(*[a for i in range(len(columns)) for a in (F.count(f"c{i}").alias(f"n{i}"), (F.min(f"c{i}") < F.max(f"c{i}")).alias(f"v{i}"))]).first()
    return matrix_of(pairs, {c: (row[f"n{i}"], bool(row[f"v{i}"])) for i, c in enumerate(columns)})


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(r.isNull(), "unknown").when(size >= STRONG, "strong").when(size >= MODERATE, "moderate").otherwise("weak")


def important_pairs(pairs: DataFrame, threshold: float = STRONG) -> DataFrame:
    """Pairs at or above ``threshold`` in size, strongest first."""
    r = F.col("correlation")
    return (
        pairs.filter(F.abs(r) >= threshold)
        .select(
            F.col("x").alias("variable_1"), F.col("y").alias("variable_2"), "method", "correlation", "p_value", "sample_size",
            F.when(r > 0, "positive").otherwise("negative").alias("direction"), strength(r).alias("strength"),
        )
        .orderBy(F.desc(F.abs("correlation")), "variable_1", "variable_2")
    )


def skipped_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("status") == "skipped").select(
        "method", F.col("x").alias("variable_1"), F.col("y").alias("variable_2"), "reason", "sample_size"
    )


def correlation_cells(matrix: DataFrame, columns: Sequence[str], max_columns: int | None = None) -> DataFrame:
    """Matrix cells by column index, nulls dropped; ``max_columns`` keeps the first ones."""
    shown = list(columns)[:max_columns]
    index = F.create_map(*[part for i, c in enumerate(shown) for part in (F.lit(c), F.lit(i))])
    return (
        matrix.filter(F.col("correlation").isNotNull() & F.col("x").isin(shown) & F.col("y").isin(shown))
        .select(
            "method", F.try_element_at(index, F.col("x")).alias("x_index"), F.try_element_at(index, F.col("y")).alias("y_index"),
            F.col("correlation").alias("value"),
        )
    )


def correlation_report(df: DataFrame, columns: Sequence[str], measures: DataFrame | None = None) -> DataFrame:
    """All three methods; fewer than two columns give a single skipped row. ``measures`` is the ``pair_table`` where that is at hand."""
    if len(columns) < 2:
        return small_table(df.sparkSession, [(m, "skipped", "insufficient_numeric_variables") for m in METHODS], "method string, status string, reason string"
        )
    return reduce(DataFrame.unionByName, [pearson(df, columns, measures), spearman(df, columns), kendall(df, columns)])
