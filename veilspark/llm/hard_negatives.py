"""Hard-negative mining by branch and bound on ball trees.

Vectors are dealt to blocks of bounded size by a hash, and each block's task
builds a ball tree: nodes have a centre and a radius, so an anchor's inner
product with what a node holds lies between q.c - |q|r and q.c + |q|r. A
search first reads one leaf for a first k-th score; then it goes down
level by level and leaves out nodes that lie outside the window of scores or
strictly beneath the k-th score, and reads the leaves that remain, those with
the highest upper bounds first, for a higher k-th score. The searches of a
block of anchors go through a tree together: bounds and scores are products of
matrices, over the leaves that each anchor needs.
Anchors meet all blocks, once for their positives (own label, no window) and
once for their negatives (other labels, a window for each positive's score).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise, released

#: Fixed values of the query's contract.
SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 5, 5, 80, 100
VECTOR_BLOCK = 8192
ASK_BLOCK = 512
LEAF = 64
#: Leaves read before the k-th score is looked at for the last time.
LEAVES_AT_ONCE = 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Sums below are exact in floats.
EXACT = 2.0**53


@dataclass(frozen=True)
class BallTree:
    """Vectors in the order of the leaves. Level l has 2**l nodes; node i holds
    the rows from n*i >> l to n*(i+1) >> l, nodes of all levels stand end to end."""

    vectors: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    depth: int

    def rows(self, level: int, node: int) -> slice:
        n = len(self.vectors)
        return slice(n * node >> level, n * (node + 1) >> level)


def ball_tree(v: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
    """A tree over the rows of ``v`` and the order that it puts them in.

    A node is halved at the median along the line from the row that is
    farthest from its centre to the row that is farthest from that one."""
    n, order, depth = len(v), np.arange(len(v)), 0
    while n >> depth > leaf:
        for i in range(1 << depth):
            a, b, cut = n * i >> depth, n * (i + 1) >> depth, (n * (2 * i + 1) >> (depth + 1))
            own = v[order[a:b]]
            one = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
            line = own[np.argmax(((own - one) ** 2).sum(1))] - one
            order[a:b] = order[a:b][np.argpartition(own @ line, cut - a)]
        depth += 1
    return measured(v[order], depth), order


def measured(v: np.ndarray, depth: int) -> BallTree:
    """The tree of rows that are in its order."""
    n, centres, radii = len(v), [], []
    for level in range(depth + 1):
        for i in range(1 << level):
            own = v[n * i >> level : n * (i + 1) >> level]
            centres.append(own.mean(0))
            radii.append(np.sqrt(((own - centres[-1]) ** 2).sum(1).max()))
    return BallTree(v, np.array(centres), np.array(radii), depth)


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def search(tree: BallTree, ids: np.ndarray, may: np.ndarray, q: np.ndarray, low: float, high: float, k: int, trace: list | None = None) -> list[tuple[int, int]]:
    """(score, id) of the ``k`` best rows of a tree that ``may`` be taken and
    score from ``low`` to ``high``; ties to smaller ids. ``trace`` gets the
    rows read."""
    return search_all(tree, ids, may[None, :], q[None, :], [[(low, high)]], k, trace)[0][0]


def search_all(tree: BallTree, ids: np.ndarray, may: np.ndarray, qs: np.ndarray, windows: list[list[tuple[float, float]]], k: int, trace: list | None = None) -> list[list[list[tuple[int, int]]]]:
    """search() for each of a block of vectors ``qs`` and each of its windows
    (low, high); ``may`` has a row for each vector. Bounds of all nodes and
    scores of a leaf's rows are products of matrices for all vectors that need
    them; a leaf's rows are scored once for all windows of a vector."""
    of = np.repeat(np.arange(len(qs)), [len(w) for w in windows])
    low, high = np.array([x for w in windows for x in w], np.float64).reshape(-1, 2).T
    length = np.sqrt((qs * qs).sum(1))
    size = np.sqrt((tree.centres * tree.centres).sum(1)) + tree.radii
    mid = tree.centres @ qs.T
    reach = tree.radii[:, None] * length + 1e-9 * (size[:, None] * length + 1)
    lower, upper = mid - reach, mid + reach
    leaves, at_leaf = 1 << tree.depth, (1 << tree.depth) - 1
    scores = np.full(may.shape, -np.inf)
    read = np.zeros((leaves, len(qs)), bool)
    bar = low.copy()

    def take(wanted: np.ndarray) -> None:
        """Scores of the leaves ``wanted`` (leaf, vector) that weren't read."""
        for leaf in np.flatnonzero((wanted & ~read).any(1)).tolist():
            who, rows = np.flatnonzero(wanted[leaf] & ~read[leaf]), tree.rows(tree.depth, leaf)
            scores[who, rows] = np.where(may[who, rows], qs[who] @ tree.vectors[rows].T, -np.inf)
        read[wanted] = True

    def best(j: int, a: float, z: float) -> np.ndarray:
        at = np.flatnonzero((scores[j] >= max(a, -1.7e308)) & (scores[j] <= z))
        if len(at) > k:
            least = np.partition(scores[j, at], len(at) - k)[len(at) - k]
            at = at[scores[j, at] >= least]
        return at[np.lexsort((ids[at], -scores[j, at]))[:k]]

    def alive() -> np.ndarray:
        """Leaves (leaf, search) that neither they nor what they stand under
        rule out."""
        on = np.ones((1, len(of)), bool)
        for level in range(tree.depth + 1):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            on = (on if level == 0 else np.repeat(on, 2, axis=0)) & (upper[nodes][:, of] >= bar) & (lower[nodes][:, of] <= high)
        return on

    def any_of(on: np.ndarray) -> np.ndarray:
        out = np.zeros((leaves, len(qs)), bool)
        np.logical_or.at(out, (slice(None), of), on)
        return out

    for some in (1, LEAVES_AT_ONCE, leaves):
        on = alive()
        if some < leaves:  # those with the highest bounds first, for a k-th score
            height = np.where(on, np.minimum(mid[at_leaf:][:, of], high) if some == 1 else upper[at_leaf:][:, of], -np.inf)
            first = np.argpartition(-height, some - 1, axis=0)[:some] if some < len(height) else np.argsort(-height, axis=0)
            picked = np.zeros_like(on)
            np.put_along_axis(picked, first, True, axis=0)
            take(any_of(on & picked))
            for i, j in enumerate(of.tolist()):
                found = best(j, bar[i], high[i])
                if len(found) == k:
                    bar[i] = max(bar[i], scores[j, found[-1]])
        else:
            take(any_of(on))
    if trace is not None:
        trace += [int(sum(tree.rows(tree.depth, leaf).stop - tree.rows(tree.depth, leaf).start for leaf in np.flatnonzero(read[:, j]))) for j in range(len(qs))]
    out: list[list[list[tuple[int, int]]]] = [[] for _ in windows]
    for i, j in enumerate(of.tolist()):
        out[j].append([(int(scores[j, x]), int(ids[x])) for x in best(j, low[i], high[i])])
    return out


def plain_search(vectors: np.ndarray, ids: np.ndarray, may: np.ndarray, q: np.ndarray, low: int, high: int, k: int) -> list[tuple[int, int]]:
    """As search(), with whole numbers of any size; scores beyond 64 bits
    count as the least or greatest of 64 bits."""
    own = [int(x) for x in q.tolist()]
    scores = ((sum(a * int(b) for a, b in zip(own, vectors[i].tolist(), strict=True)), int(ids[i])) for i in np.flatnonzero(may))
    return _best([(s, i) for s, i in ((min(MOST, max(LEAST, s)), i) for s, i in scores) if low <= s <= high], k)


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest whole s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal (dim, block) of sorted frames, in the order of
    its ball tree."""
    at, ids, labels, parts = None, [], [], []

    def row():
        v = np.concatenate(parts).reshape(len(ids), -1)
        with np.errstate(over="ignore", invalid="ignore"):
            if np.abs(v).max() ** 2 * v.shape[1] < EXACT:
                tree, order = ball_tree(v)
                depth = tree.depth
            else:
                order, depth = np.arange(len(v)), -1
        own = v[order]
        if np.abs(own).max() < 1 << 15:
            own = own.astype(np.int16)
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([at[0]], pa.int32()), "block": pa.array([at[1]], pa.int64()), "depth": pa.array([depth], pa.int32()), "kind": [own.dtype.str],
            "ids": [np.array(ids, np.int64)[order].tobytes()], "labels": [np.array(labels, np.int64)[order].tobytes()], "m": [own.tobytes()],
        })

    for frame in frames:
        for d, b, i, c, x in zip(*(frame[n].to_pylist() for n in ("dim", "block", "vec_id", "label", "vec")), strict=True):
            if (d, b) != at:
                if at is not None:
                    yield row()
                at, ids, labels, parts = (d, b), [], [], []
            ids.append(i)
            labels.append(c)
            parts.append(np.array(x, np.float64))
    if at is not None:
        yield row()


def _searched(k: int, low: int | None, high: int | None):
    """Rows (anchor_id, row, positive_score, other_id, score): the best ``k``
    of a block for each ask; without ``low`` of the anchor's label, else of
    others in the window of each of the ask's scores."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i, (dim, depth, kind, a, b, m) in enumerate(zip(*(frame[c].to_pylist() for c in ("dim", "depth", "kind", "ids", "labels", "m")), strict=True)):
                ids, labels = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                v = np.frombuffer(m, np.dtype(kind)).astype(np.float64).reshape(-1, dim)
                tree, most, out = (measured(v, depth) if depth >= 0 else None), np.abs(v).max(), []
                asks = frame["asks"][i].values
                vecs = asks.field("vec").flatten().to_numpy().reshape(-1, dim)
                whos, rows, kinds, asked = (asks.field(c).to_pylist() for c in ("vec_id", "row", "label", "scores"))
                of = lambda s: (LEAST, MOST) if low is None else window_of(s, low, high)
                plain = np.full(len(vecs), tree is None) | (most * np.abs(vecs).max(1) * dim >= EXACT)
                own = np.array(kinds, np.int64)[:, None]
                may = (ids[None, :] != np.array(whos, np.int64)[:, None]) & ((labels[None, :] == own) if low is None else (labels[None, :] != own))
                at = np.flatnonzero(~plain & may.any(1)).tolist()
                found = dict(zip(at, search_all(tree, ids, may[at], vecs[at], [[of(s) for s in asked[j]] for j in at], k), strict=True)) if at else {}
                found |= {j: [plain_search(v, ids, may[j], vecs[j], *of(s), k) for s in asked[j]] for j in np.flatnonzero(plain & may.any(1)).tolist()}
                for j, each in found.items():
                    out += [(whos[j], rows[j], s, other, score) for s, best in zip(asked[j], each, strict=True) for score, other in best]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(("anchor_id", "row", "positive_score", "other_id", "score"), columns, strict=True)})

    return run


def _meet(blocks: DataFrame, asks: DataFrame, run) -> DataFrame:
    """``run`` over each block of vectors with each block of asks of one length."""
    counts = asks.groupBy("dim").agg(F.ceil(F.count("*") / ASK_BLOCK).alias("ask_blocks"))
    dealt = asks.join(F.broadcast(counts), "dim").withColumn("ask_block", F.expr("pmod(xxhash64(vec_id, row), ask_blocks)"))
    packed = dealt.groupBy("dim", "ask_block").agg(F.collect_list(F.struct("vec_id", "row", "label", "scores", "vec")).alias("asks"))
    counts = blocks.groupBy("dim").agg(F.max("block").alias("last"))
    packed = packed.join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    met = blocks.join(packed, ["dim", "block"]).repartition("dim", "block", "ask_block")
    return met.mapInArrow(released(run), "anchor_id long, row long, positive_score long, other_id long, score long")


def mine_hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) from ``vectors`` (vec_id, embedding, label).

    Components become floor(scale * x); a row's score is its inner product
    with the anchor, ties to the smaller vec_id. Anchors are the rows whose
    vec_id is divisible by ``every``. An anchor's positives are its best
    ``positives`` rows of the same label and another vec_id; for each, the best
    ``negatives`` rows of other labels come with low * positive_score <= 100 *
    negative_score <= high * positive_score, fewer or none where no more score
    so (always none where the positive's score is negative and low < high).
    Scores beyond 64 bits count as the ends of 64 bits.

    Rows take no part that have no vec_id or label, an empty vector, or a
    component that is null, or not finite when scaled. Only vectors of one
    length meet. Rows that repeat vec_id, label and vector count once; ones
    that share the vec_id alone are rows of their own, never each other's
    positives or negatives. An empty table gives an empty one; other columns
    are ignored.
    """
    bounded_batches(vectors.sparkSession)
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(scale))
    base = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("vec"))
        .where("vec_id is not null and label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        .withColumn("vec", F.transform("vec", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)))
        .dropDuplicates(["vec_id", "label", "vec"])
        .select(F.size("vec").alias("dim"), "vec_id", "label", "vec", F.xxhash64("label", "vec").alias("row"))
    )
    base = materialise(base, "vectors")
    counts = base.groupBy("dim").agg(F.ceil(F.count("*") / VECTOR_BLOCK).alias("blocks"))
    dealt = base.join(F.broadcast(counts), "dim").withColumn("block", F.expr("pmod(xxhash64(vec_id, row), blocks)")).select("dim", "block", "vec_id", "label", "vec")
    dealt = dealt.repartition("dim", "block").sortWithinPartitions("dim", "block")
    blocks = materialise(dealt.mapInArrow(released(_pack), "dim int, block long, depth int, kind string, ids binary, labels binary, m binary"), "blocks")
    anchors = base.where(F.col("vec_id") % every == 0)
    first = lambda k, *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")) <= k
    near = _meet(blocks, anchors.withColumn("scores", F.array(F.lit(0).cast("long"))), _searched(positives, None, None))
    near = near.withColumn("in", first(positives, "anchor_id", "row")).where("in").select("anchor_id", "row", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = materialise(near, "positives")
    asked = near.groupBy(F.col("anchor_id").alias("vec_id"), "row").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    far = _meet(blocks, anchors.join(asked, ["vec_id", "row"]), _searched(negatives, low, high))
    by = ("anchor_id", "row", "positive_score")
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id"))).where(F.col("rank") <= negatives)
    return near.join(far, [*by]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def with_moved_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The query's labels: (label + 1) % ``labels`` where vec_id is divisible
    by ``every``."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long")))


NEGATIVES_ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_inner_product(a.e, o.e)::BIGINT AS score
  FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
