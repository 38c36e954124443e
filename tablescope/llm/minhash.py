"""Operator 7: near-duplicate documents by a chosen-path set similarity join.

1. One pass turns each text into its set of word shingles and keeps the set's size, a 128-bit hash of the set and
   ``COORDINATES`` minwise tokens. Documents with equal sets meet in one vertex from here on.
2. Each of ``trees`` independent trees splits the vertices by one minwise token. Nodes that are still large choose
   ``BRANCHES`` further tokens of their own and split by them, again and again: documents that only share a passage
   part ways, and a similar pair keeps a common path. A node that ``MAX_DEPTH`` choices leave large is dealt out as
   pairs of chunks, which meets all its pairs exactly.
3. Inside a small node, minwise tokens are compared exhaustively; documents without a likely partner leave.
4. What is left of a node is joined with the texts, once however many trees found it, and linked on full sets.
   Comparing inside a node skips pairs that are already connected, so a group of copies costs its size, not its square,
   and only a spanning forest of links leaves the task.
5. Components of the links give the classes.

A pair of similarity ``s`` meets in a tree with odds ``s`` or more where nodes are small: the number of trees follows
from ``recall`` as ``ceil(log(1 - recall) / log(1 - threshold))``, 12 for the default.

Null texts and texts without words have an empty set and are linked with nothing; each is its own class. Texts shorter
than a shingle have one element. Repeated rows, equal ids and null ids are fine: vertices are rows, a class is named by
its smallest id (null if it has none). An empty table gives an empty result. Only the two named columns and those in
``keep`` are read; any names will do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.components import connected_components
from tablescope.llm.groups import Forest, borders, whole_groups
from tablescope.llm.scan import chunks, distinct, mixed, shingles
from tablescope.llm.scratch import Scratch

COORDINATES = 64
NODE_LIMIT = 4000  # documents that are compared with each other in one task
BRANCHES = 2
MAX_DEPTH = 3
#: Standard deviations below the threshold at which minwise tokens rule a pair out: odds of 1 in 10**6.
SLACK = 4.75
_A = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))


def _signatures(elements: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) minwise tokens; texts without elements get zeros."""
    out = np.zeros((len(offset) - 1, COORDINATES), dtype=np.uint32)
    some = np.flatnonzero(np.diff(offset))
    if len(some):
        for i in range(COORDINATES):
            out[some, i] = np.minimum.reduceat((elements * _A[i] + _B[i]) >> np.uint64(32), offset[some])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def profile(docs: DataFrame, k: int, doc_id: str, text: str, keep: Sequence[str]) -> DataFrame:
    """``id, body, n, h1, h2, sig`` and the kept columns of every row."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("body"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[2:])
    schema = f"id {narrow.schema[0].dataType.simpleString()}, body string{extra}, n long, h1 long, h2 long, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, raw, starts in chunks(batch.column(1)):
                own, offset = distinct(*shingles(raw, starts, k))
                n = np.diff(offset)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(own))]), np.concatenate([[np.uint64(0)], np.cumsum(mixed(own ^ np.uint64(0x5851F42D4C957F2D)))])
                h1, h2 = (mixed(s[offset[1:]] - s[offset[:-1]] + n.astype(np.uint64)).view(np.int64) for s in sums)
                columns = [c.slice(begin, stop - begin) for c in batch.columns]
                columns += [pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), _binary(_signatures(own, offset))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n", "h1", "h2", "sig"])

    return narrow.mapInArrow(run, schema)


def _token(sig: Column, coordinate: Column) -> Column:
    """One minwise token out of the packed ones."""
    return sig.substr((coordinate * 4 + 1).cast("int"), F.lit(4))


def _leaves(vertices: DataFrame, scratch: Scratch, trees: int, node_limit: int, max_depth: int) -> DataFrame:
    """``node, row``: every vertex of every node with at least two and at most ``node_limit`` vertices.

    Nodes that stay large come as pairs of chunks of half that size.
    """
    first = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    at = vertices.select("row", "sig", first.alias("tree"))
    level = at.select(F.xxhash64("tree", _token(F.col("sig"), F.col("tree"))).alias("node"), "row")
    found, depth = [], 0
    while True:
        sized = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1").select(F.col("node").bitwiseXOR(F.lit(0).cast("long")).alias("key"), "size")
        held = scratch.write(level.join(sized, F.col("node") == F.col("key")).select("node", "row", "size"), f"level{depth}")
        found.append(held.filter(F.col("size") <= node_limit).select("node", "row"))
        large = held.filter(F.col("size") > node_limit)
        if large.isEmpty():
            break
        if depth == max_depth:
            half = max(1, node_limit // 2)
            parts = F.ceil(F.col("size") / half).cast("int")
            own = F.pmod(F.xxhash64("row"), parts).cast("int")
            others = F.sequence(F.lit(0), F.col("parts") - 1)
            met = large.select("node", "row", parts.alias("parts"), own.alias("own")).select("node", "row", "own", F.explode(others).alias("other"))
            found.append(met.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "row"))
            break
        depth += 1
        # Each large node chooses tokens of its own: the choice is a hash of the node.
        chosen = large.join(vertices.select("row", "sig"), "row").select("node", "row", "sig", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("branch"))
        coordinate = F.pmod(F.xxhash64("node", "branch"), F.lit(COORDINATES))
        level = chosen.select(F.xxhash64("node", "branch", _token(F.col("sig"), coordinate)).alias("node"), "row")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _likely(sig: np.ndarray, least: int) -> np.ndarray:
    """Group number of every vertex of a node after joining likely pairs; alone means no likely partner."""
    forest = Forest(len(sig))
    for i in range(len(sig) - 1):
        same = (sig[i + 1 :] == sig[i]).sum(axis=1) >= least
        for j in (np.flatnonzero(same) + i + 1).tolist():
            forest.join(i, j)
    return forest.roots()


def _clusters(leaves: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """``cluster, row``: likely groups inside nodes; equal groups of several trees share their number."""
    # Two sets of similarity t share each token with odds t.
    least = math.floor(COORDINATES * threshold - SLACK * math.sqrt(COORDINATES * threshold * (1 - threshold)))
    rows = leaves.hint("merge").join(vertices.select("row", "sig"), "row").select("node", "row", "sig")
    sorted_rows = rows.repartition("node").sortWithinPartitions("node", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            node, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(len(row), COORDINATES)
            begin = borders(node)
            begin, size = begin[:-1], np.diff(begin)
            label = np.arange(len(row))
            pairs = begin[size == 2]
            near = (sig[pairs] == sig[pairs + 1]).sum(axis=1) >= least
            label[pairs[near] + 1] = pairs[near]
            for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                label[b : b + n] = b + _likely(sig[b : b + n], least)
            order = np.argsort(label, kind="stable")
            start = borders(label[order])
            start, count = start[:-1], np.diff(start)
            # The same members give the same number in every tree.
            total = np.add.reduceat(mixed(row[order].astype(np.uint64) + np.uint64(1)), start)
            number = np.repeat(mixed(total + count.astype(np.uint64)).view(np.int64), count)
            many = np.repeat(count > 1, count)
            yield pa.RecordBatch.from_arrays([pa.array(number[many]), pa.array(row[order][many])], names=["cluster", "row"])

    return sorted_rows.mapInArrow(run, "cluster long, row long").distinct()


def _linked(elements: np.ndarray, offset: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one group of sets."""
    n = len(offset) - 1
    size = np.diff(offset)
    order = np.argsort(size, kind="stable")
    values, code = np.unique(elements, return_inverse=True)
    # Sets whose elements many others share link many: they go first, and most pairs are then connected already.
    popular = np.add.reduceat(np.bincount(code)[code], offset[:-1]) / size
    label, out = np.arange(n), []
    member = np.zeros(len(values), dtype=bool)
    by_size, place = size[order], np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    moved = np.concatenate([code[offset[i] : offset[i + 1]] for i in order.tolist()])
    begin = np.concatenate([[0], np.cumsum(by_size)])
    for i in np.argsort(-popular, kind="stable").tolist():
        s = int(size[i])
        # 100 * |a & b| >= percent * |a | b| needs sizes within this ratio.
        low, high = np.searchsorted(by_size, -(-s * percent // 100)), np.searchsorted(by_size, s * 100 // percent, side="right")
        others = order[low:high]
        if (label[others] == label[i]).all():
            continue
        own = code[offset[i] : offset[i + 1]]
        member[own] = True
        common = np.add.reduceat(member[moved[begin[low] : begin[high]]].astype(np.int64), begin[low:high] - begin[low])
        member[own] = False
        near = 100 * common >= percent * (s + by_size[low:high] - common)
        for j in others[near].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _links(clusters: DataFrame, profiled: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: rows linked on full sets."""
    # Always a shuffle of the texts: what grows with the corpus is never broadcast, whichever side looks small.
    texts = clusters.hint("merge").join(profiled.select("row", "body"), "row").select("cluster", "row", "body")
    sorted_rows = texts.repartition("cluster").sortWithinPartitions("cluster", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            row = batch.column(1).to_numpy()
            parts, sizes = [], [np.zeros(1, dtype=np.int64)]
            for _, _, raw, starts in chunks(batch.column(2)):
                own, offset = distinct(*shingles(raw, starts, k))
                parts.append(own)
                sizes.append(np.diff(offset))
            elements, offset = np.concatenate(parts), np.cumsum(np.concatenate(sizes))
            begin = borders(batch.column(0).to_numpy()).tolist()
            a, b = [], []
            for first, last in zip(begin[:-1], begin[1:], strict=True):
                near = _linked(elements[offset[first] : offset[last]], offset[first : last + 1] - offset[first], percent)
                a += [row[first + i] for i, _ in near]
                b += [row[first + j] for _, j in near]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def _classed(
    docs: DataFrame, scratch: Scratch, words: int, percent: int, recall: float, doc_id: str, text: str, keep: Sequence[str], node_limit: int, max_depth: int
) -> tuple[DataFrame, DataFrame]:
    """The written profile of the documents, and ``row, doc_id, n_shingles, class, component_id`` of each of its rows."""
    threshold = percent / 100
    trees = min(COORDINATES, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))
    raw = scratch.write(profile(docs, words, doc_id, text, keep).withColumn("row", F.monotonically_increasing_id()), "profile")
    full = raw.filter("n > 0")
    # Equal sets meet in the smallest row; the expression keeps the join's sides apart, so that a set with very many copies can be split.
    firsts = full.groupBy("h1", "h2").agg(F.min("row").alias("vertex"), F.count("*").alias("copies"))
    keyed = firsts.select(F.col("h1").bitwiseXOR(F.lit(0).cast("long")).alias("g1"), F.col("h2").bitwiseXOR(F.lit(0).cast("long")).alias("g2"), "vertex")
    of = scratch.write(full.select("row", "h1", "h2").join(keyed, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("row", "vertex"), "vertex")
    reps = of.filter("row = vertex").select("row")
    vertices = scratch.write(full.select("row", "sig").join(reps.hint("merge"), "row"), "vertices")
    leaves = _leaves(vertices, scratch, trees, node_limit, max_depth)
    clusters = scratch.write(_clusters(leaves, vertices, threshold), "clusters")
    links = scratch.write(_links(clusters, full, words, percent), "links")
    stars = connected_components(links, scratch)
    classed = of.join(stars, F.col("vertex") == F.col("node"), "left").select(F.col("row").alias("r"), F.coalesce("root", "vertex").alias("class"))
    rows = raw.select("row", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles")).join(classed, F.col("row") == F.col("r"), "left").drop("r")
    own = scratch.write(rows.withColumn("class", F.coalesce("class", "row")), "classed")
    # Within a class the smallest id is kept.
    best = own.groupBy("class").agg(F.min("doc_id").alias("component_id")).withColumn("key", F.col("class").bitwiseXOR(F.lit(0).cast("long"))).drop("class")
    return raw, own.join(best, F.col("class") == F.col("key")).drop("key")


def near_duplicates(
    docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80, recall: float = 1 - 1e-8, doc_id: str = "doc_id", text: str = "text",
    node_limit: int = NODE_LIMIT, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per document.

    ``component_id`` is the smallest id of the documents reachable by links of ``100 * |a & b| >= percent * |a | b|``;
    ``kept`` is true where it is the document's own.
    """
    _, named = _classed(docs, scratch, words, percent, recall, doc_id, text, (), node_limit, max_depth)
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(
    docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80, recall: float = 1 - 1e-8, doc_id: str = "doc_id", text: str = "text",
    keep: Sequence[str] = (), node_limit: int = NODE_LIMIT, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """``doc_id, text`` and the columns in ``keep`` of one document of every class: that with the smallest id, one row of several."""
    raw, named = _classed(docs, scratch, words, percent, recall, doc_id, text, keep, node_limit, max_depth)
    named = scratch.write(named.select("row", "class", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("best")), "named")
    chosen = named.filter("best").groupBy("class").agg(F.min("row").alias("r")).select("r")
    gone = named.select("row").join(chosen, F.col("row") == F.col("r"), "left_anti").select(F.col("row").alias("g"))
    # Texts travel once more, and only to leave out what goes; by a shuffle at every size.
    return raw.join(gone.hint("merge"), F.col("row") == F.col("g"), "left_anti").select(F.col("id").alias(doc_id), F.col("body").alias(text), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
