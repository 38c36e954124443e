"""Operator 1: near-duplicate embeddings by cross-polytope hashing.

A hash of a vector is the signed axis that lies nearest to it after a random rotation; a rotation is three rounds of
random signs and a fast Hadamard transform. A table joins ``rotations`` hashes into a bucket. Every vector enters its own
bucket, and looks into ``probes`` further ones: those whose axes lie only a little farther (multiprobe). Pairs that meet
are verified by their cosine in double precision, bucket by bucket with matrix products; of a large bucket every pair of
chunks is a task of its own. A pair that meets in several tables counts in the first. No pairs leave the tasks: only
each vector's number of links, and a spanning forest of them.

The number of rotations follows the number of vectors, so that a bucket of unrelated vectors stays small; the number of
tables follows ``recall``, with the odds of meeting measured on random pairs exactly at the threshold.

Equal vectors meet in one vertex first, with their number. Vectors that are null, empty or zero, or hold null, NaN or
infinite components, link with nothing; vectors of different lengths do not link. Repeated rows and ids are vectors of
their own; null ids never name a class that has another. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.components import connected_components
from tablescope.llm.groups import Forest, borders, whole_groups
from tablescope.llm.scan import mixed
from tablescope.llm.scratch import Scratch

CHUNK = 512
_NEAREST = 3  # axes of a rotation that probes may choose from


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    rows, d = x.shape
    signs = np.random.default_rng(seed)
    for _ in range(3):
        x = x * signs.choice(np.array([-1.0, 1.0]), d)
        half = 1
        while half < d:
            pair = x.reshape(rows, -1, 2, half)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(rows, d)
            half *= 2
    return x / d**1.5


def _codes(units: np.ndarray, table: int, rotations: int, probes: int) -> np.ndarray:
    """(rows, 1 + probes) bucket numbers of unit vectors: their own, then the next best."""
    rows, length = units.shape
    d = max(2, 1 << (length - 1).bit_length())
    x = np.zeros((rows, d))
    x[:, :length] = units
    near = min(_NEAREST, d)
    axes, gaps = [], []
    for r in range(rotations):
        y = _rotated(x, 1000 * table + r)
        size = np.abs(y)
        # Ties go to the smaller axis.
        first = np.argsort(-size, axis=1, kind="stable")[:, :near] if d <= 8 else _top(size, near)
        chosen = np.take_along_axis(y, first, axis=1)
        axes.append(first * 2 + (chosen < 0))
        gaps.append((np.abs(chosen[:, :1]) - np.abs(chosen)) ** 2)
    choices = list(itertools.product(range(near), repeat=rotations))
    cost = np.stack([sum(gaps[r][:, c[r]] for r in range(rotations)) for c in choices], axis=1)
    best = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
    code = np.full((rows, len(choices)), table * 1_000_003 + length, dtype=np.uint64)
    for r in range(rotations):
        code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + np.stack([axes[r][:, c[r]] for c in choices], axis=1).astype(np.uint64))
    return np.take_along_axis(code, best, axis=1).view(np.int64)


def _top(size: np.ndarray, n: int) -> np.ndarray:
    part = np.argpartition(-size, n, axis=1)[:, :n]
    part.sort(axis=1)
    order = np.argsort(-np.take_along_axis(size, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


@cache
def meeting_odds(length: int, cosine: float, rotations: int, probes: int, pairs: int = 4000) -> float:
    """Measured odds that two random vectors at ``cosine`` meet in one table."""
    random = np.random.default_rng(7)
    a, g = random.normal(size=(2, pairs, length))
    a /= np.linalg.norm(a, axis=1)[:, None]
    g -= (g * a).sum(axis=1)[:, None] * a
    g /= np.maximum(np.linalg.norm(g, axis=1), 1e-300)[:, None]
    b = cosine * a + math.sqrt(1 - cosine * cosine) * g
    x, y = _codes(a, 0, rotations, probes), _codes(b, 0, rotations, probes)
    met = ((x[:, :1] == y).any(axis=1) | (y[:, :1] == x).any(axis=1)).mean()
    return float(min(max(met, 0.05), 0.999))


def _units(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    # Scaling first keeps squares of very large and very small components finite.
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _profile(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id, vec, h1, h2``: the vector as little-endian doubles, null if it links with nothing, and a 128-bit hash."""
    narrow = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, h1, h2 = [], [], []
            for e in batch.column(1):
                x = None
                if e.is_valid and e.values.null_count == 0 and len(e.values):
                    x = e.values.to_numpy(zero_copy_only=False) + 0.0  # turns -0.0 into 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                raw = None if x is None else x.astype("<f8").tobytes()
                key = np.frombuffer(blake2b(raw or b"", digest_size=16).digest(), dtype="<i8")
                vecs.append(raw)
                h1.append(int(key[0]))
                h2.append(int(key[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(vecs, pa.binary()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["id", "vec", "h1", "h2"]
            )

    return narrow.mapInArrow(run, "id long, vec binary, h1 long, h2 long")


def _by_length(vecs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each length of vector."""
    sizes = np.array([len(v) for v in vecs])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, _units(np.frombuffer(b"".join(vecs[i] for i in at.tolist()), dtype="<f8").reshape(len(at), -1))


def _buckets(vertices: DataFrame, tables: int, rotations: int, probes: int) -> DataFrame:
    """``node, tab, row, own``: every vector in its bucket (own) and in those it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4000):
                part = batch.slice(begin, 4000)
                row = part.column(0).to_numpy()
                for at, units in _by_length(part.column(1).to_pylist()):
                    for t in range(tables):
                        code = _codes(units, t, rotations, probes)
                        own = np.zeros(code.shape, dtype=bool)
                        own[:, 0] = True
                        yield pa.RecordBatch.from_arrays([
                            pa.array(code.reshape(-1)), pa.array(np.full(code.size, t, dtype=np.int32)),
                            pa.array(np.repeat(row[at], code.shape[1])), pa.array(own.reshape(-1)),
                        ], names=["node", "tab", "row", "own"])

    return vertices.select("row", "vec").mapInArrow(run, "node long, tab int, row long, own boolean")


def _met(buckets: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """``node, tab, row, own, part, split``: buckets in which pairs meet; large ones as pairs of chunks."""
    sized = buckets.groupBy("node").agg(F.count("*").alias("size"), F.max("own").alias("any_own")).filter("size > 1 AND any_own")
    key = sized.select(F.col("node").bitwiseXOR(F.lit(0).cast("long")).alias("key"), "size")
    held = scratch.write(buckets.join(key, F.col("node") == F.col("key")).drop("key"), "met")
    parts = F.ceil(F.col("size") / chunk).cast("int")
    small = held.filter(F.col("size") <= 2 * chunk).select("node", "tab", "row", "own", F.lit(0).alias("part"), F.lit(False).alias("split"))
    large = held.filter(F.col("size") > 2 * chunk).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    dealt = large.select("node", "tab", "row", "own", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = dealt.select(
        F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), "tab", "row", "own", "part",
        (F.col("part") != F.col("other")).alias("split"),
    )
    return small.unionAll(pairs)


def _verified(met: DataFrame, vertices: DataFrame, cosine: float, rotations: int, probes: int) -> DataFrame:
    """``row, links, other``: numbers of links to add up (``other`` null), and links of a spanning forest."""
    rows = met.join(vertices.select("row", "vec", "copies"), "row").select("node", "tab", "row", "own", "part", "split", "vec", "copies")
    ordered = rows.repartition("node").sortWithinPartitions("node", "row")

    def first_meeting(units: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, own_a: np.ndarray) -> np.ndarray:
        """Whether the pairs, of which ``a`` has the smaller row, meet nowhere before this bucket."""
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        new = np.ones(len(a), dtype=bool)
        x, y = place[: len(a)], place[len(a) :]
        for t in range(table):
            code = _codes(units[used], t, rotations, probes)
            new &= ~((code[x, :1] == code[y]).any(axis=1) | (code[y, :1] == code[x]).any(axis=1))
        # In one table, two vectors may look into each other's bucket: that of the smaller row counts.
        code = _codes(units[used], table, rotations, probes)
        both = (code[x, :1] == code[y]).any(axis=1) & (code[y, :1] == code[x]).any(axis=1) & (code[x, 0] != code[y, 0])
        return new & (~both | own_a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            node, table, row, own, part, split = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            vecs, copies = batch.column(6).to_pylist(), batch.column(7).to_numpy()
            begin = borders(node).tolist()
            # Links of all groups of the batch, table by table, so that earlier tables are looked up for many at once.
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            units: list[np.ndarray] = [None] * len(row)
            for at, u in _by_length(vecs):
                for i, x in zip(at.tolist(), u, strict=True):
                    units[i] = x
            for first, last in zip(begin[:-1], begin[1:], strict=True):
                lengths = {len(x) for x in units[first:last]}
                if len(lengths) > 1:  # two buckets whose numbers are equal by chance
                    continue
                own_units = np.stack(units[first:last])
                near = np.triu(own_units @ own_units.T >= cosine, 1)
                if not near.any():
                    continue
                i, j = np.nonzero(near)
                i, j = i + first, j + first
                ok = (own[i] | own[j]) & (row[i] != row[j]) & (~split[i] | (part[i] != part[j]))
                if ok.any():
                    found.setdefault(int(table[first]), []).append((i[ok], j[ok]))
            weights, edges = np.zeros(len(row), dtype=np.int64), []
            for t, pairs in found.items():
                i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                for at in {len(units[k]) for k in i.tolist()}:
                    same = np.array([len(units[k]) == at for k in i.tolist()])
                    a, b = i[same], j[same]
                    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                    new = first_meeting(np.stack([units[k] for k in used.tolist()]), place[: len(a)], place[len(a) :], t, own[a])
                    a, b = a[new], b[new]
                    np.add.at(weights, a, copies[b])
                    np.add.at(weights, b, copies[a])
                    edges.append((row[a], row[b]))
            counted = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[counted]), pa.array(weights[counted]), pa.nulls(len(counted), pa.int64())], names=["row", "links", "other"]
            )
            if edges:
                x, y = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
                names, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                forest = Forest(len(names))
                keep = [k for k, (i, j) in enumerate(zip(place[: len(x)].tolist(), place[len(x) :].tolist(), strict=True)) if forest.join(i, j)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]), pa.array(np.zeros(len(keep), dtype=np.int64)), pa.array(y[keep])], names=["row", "links", "other"]
                )

    return ordered.mapInArrow(run, "row long, links long, other long")


def near_embeddings(
    vectors: DataFrame, scratch: Scratch, cosine: float = 0.95, recall: float = 1 - 1e-7, vec_id: str = "vec_id", embedding: str = "embedding",
    chunk: int = CHUNK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per vector, by links of at least ``cosine``."""
    raw = scratch.write(_profile(vectors, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()), "vectors")
    full = raw.filter("vec IS NOT NULL")
    firsts = full.groupBy("h1", "h2").agg(F.min("row").alias("vertex"), F.count("*").alias("copies"))
    keyed = firsts.select(F.col("h1").bitwiseXOR(F.lit(0).cast("long")).alias("g1"), F.col("h2").bitwiseXOR(F.lit(0).cast("long")).alias("g2"), "vertex", "copies")
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    of = scratch.write(full.select("row", "h1", "h2").join(keyed, same).select("row", "vertex", "copies"), "vertex")
    vertices = scratch.write(full.select("row", "vec").join(of.filter("row = vertex").select("row", "copies"), "row"), "vertices")
    shape = vertices.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    length = (shape.bytes or 16) // 8
    axes = 2 * max(2, 1 << (length - 1).bit_length())
    rotations = max(2, math.ceil(math.log(max(shape.n, 2)) / math.log(axes)))
    probes = rotations
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meeting_odds(length, cosine, rotations, probes))))
    met = _met(_buckets(vertices, tables, rotations, probes), scratch, chunk)
    found = scratch.write(_verified(met, vertices, cosine, rotations, probes), "found")
    links = found.filter("other IS NULL").groupBy("row").agg(F.sum("links").alias("links")).withColumnRenamed("row", "v")
    stars = connected_components(found.filter("other IS NOT NULL").select(F.col("row").alias("a"), F.col("other").alias("b")), scratch)
    classes = scratch.write(
        of.filter("row = vertex").select("vertex", "copies").join(links, F.col("vertex") == F.col("v"), "left").drop("v")
        .join(stars, F.col("vertex") == F.col("node"), "left")
        .select(F.col("vertex").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vertex").alias("class")),
        "classes",
    )
    placed = raw.select("row", "id").join(of.select(F.col("row").alias("r"), "vertex"), F.col("row") == F.col("r"), "left").drop("r")
    placed = placed.join(classes, F.col("vertex") == F.col("v"), "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "row").alias("class")
    )
    rows = scratch.write(placed, "placed")
    least = rows.groupBy("class").agg(F.min("vec_id").alias("component_id")).select(F.col("class").bitwiseXOR(F.lit(0).cast("long")).alias("key"), "component_id")
    return rows.join(least, F.col("class") == F.col("key")).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
