"""Exact top-k inner products without random access.

Vectors are held in blocks of bounded size. In a block each component is one
sorted list, which a query reads from the end that its sign prefers; lists of
components in which it is 0 aren't read. Reading goes on in rounds, to the same
depth in all lists. After a round each candidate has the score of what was
read of it, and two bounds for what wasn't: unread components lie between the
worst value of their list and the one that reading has reached, and their part
is at most the product of the norms of the unread rests of query and candidate
(each candidate's norm is known). Outsiders whose upper bound doesn't reach the
k-th lower bound are out. A query stops when so few candidates are left that
their final scores are resolved at once; what the last round leaves is read to
the end.
For the same depth in all lists a round is a number of matrix products, which
serve all queries of a block that haven't stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise, released

QUERY_BLOCK = 1024
VECTOR_BLOCK = 8192
#: Queries that read a block's lists at once (bounds take 8 bytes for each with each vector).
AT_ONCE = 256
#: Depths of reading, as shares of the lists.
ROUNDS = (1 / 16, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8)
#: A query stops when this many times k candidates are left.
RESOLVED = 4
#: Range of a score; what lies beyond counts as its ends.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _bounds(v: np.ndarray, lists: np.ndarray, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each query with each candidate after reading
    ``depth`` entries of each list."""
    n = len(v)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    high, low = lists[n - depth], lists[depth - 1]
    top, bottom = v >= high, v <= low
    read = plus @ (v * top).T + minus @ (v * bottom).T
    best = plus @ np.where(top, 0, high).T + minus @ np.where(bottom, 0, low).T
    worst = plus @ np.where(top, 0, lists[0]).T + minus @ np.where(bottom, 0, lists[-1]).T
    rest_q = (plus**2) @ (~top).T + (minus**2) @ (~bottom).T
    rest_v = (q > 0) @ (v**2 * ~top).T + (q < 0) @ (v**2 * ~bottom).T
    rest = np.sqrt(rest_q * rest_v) * (1 + 1e-9) + 1
    return read + np.maximum(worst, -rest), read + np.minimum(best, rest)


def block_top(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, rounds=ROUNDS, trace: list | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the best ``k`` of one block, ties to
    smaller candidates; a candidate with the query's id is none.

    Sums below 2^53 are exact in floats. Vectors with larger components than
    that allows are scored one by one with whole numbers of any size.
    ``trace`` gets (query, rounds read, candidates resolved) of each query.
    """
    most = np.sqrt(2.0**53 / max(1, v.shape[1]))
    big, big_q = (np.abs(x).max(axis=1, initial=0) >= most for x in (v, q))
    found: list[list[tuple[int, int]]] = [[] for _ in q]
    for j, i in [(j, i) for j in range(len(q)) for i in (range(len(v)) if big_q[j] else np.flatnonzero(big))]:
        if ids[i] != qids[j]:
            score = sum(int(x) * int(y) for x, y in zip(v[i].tolist(), q[j].tolist(), strict=True))
            found[j].append((-min(MOST, max(LEAST, score)), int(ids[i])))
    ids, v = ids[~big], v[~big]
    n = len(ids)
    lists = np.sort(v, axis=0)
    keep = ids[None, :] != qids[:, None]
    keep[big_q] = False
    n_rounds = np.zeros(len(q), int)
    for share in rounds:
        on = np.flatnonzero(keep.sum(axis=1) > RESOLVED * k)
        depth = int(np.ceil(n * share))
        if not len(on) or depth >= n:
            break
        lower, upper = _bounds(v, lists, q[on], depth)
        lower[~keep[on]] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k]
        keep[on] &= upper >= bar[:, None]
        n_rounds[on] += 1
    out = []
    for j in range(len(q)):
        left = np.flatnonzero(keep[j])
        if trace is not None:
            trace.append((int(qids[j]), int(n_rounds[j]), len(left)))
        score = v[left] @ q[j]
        best = np.lexsort((ids[left], -score))[:k]
        rows = found[j] + [(-int(score[i]), int(ids[left[i]])) for i in best]
        out += [(int(qids[j]), i, -s) for s, i in sorted(rows)[:k]]
    return out


def _pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal (dim, block) of sorted frames."""
    at, ids, parts = None, [], []

    def row():
        return pa.RecordBatch.from_pydict({"dim": pa.array([at[0]], pa.int32()), "block": pa.array([at[1]], pa.int64()), "ids": [np.array(ids, np.int64).tobytes()], "m": [np.concatenate(parts).tobytes()]})

    for frame in frames:
        for d, b, i, x in zip(*(frame[c].to_pylist() for c in ("dim", "block", "vec_id", "vec")), strict=True):
            if (d, b) != at:
                if at is not None:
                    yield row()
                at, ids, parts = (d, b), [], []
            ids.append(i)
            parts.append(np.floor(1024 * np.array(x, np.float64)))
    if at is not None:
        yield row()


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors packed to blocks of about ``size`` rows of one length."""
    counts = vectors.groupBy("dim").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = vectors.join(F.broadcast(counts), "dim").withColumn("block", F.expr("pmod(xxhash64(vec_id, vec), blocks)"))
    dealt = dealt.select("dim", "block", "vec_id", "vec").repartition("dim", "block").sortWithinPartitions("dim", "block")
    return materialise(dealt.mapInArrow(released(_pack), "dim int, block long, ids binary, m binary"), name)


def _score(k: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for dim, a, m, b, q in zip(*(frame[c].to_pylist() for c in ("dim", "ids", "m", "qids", "q")), strict=True):
                v, w = (np.frombuffer(x, np.float64).reshape(-1, dim) for x in (m, q))
                ids, qids = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                rows = [r for lo in range(0, len(w), AT_ONCE) for r in block_top(ids, v, qids[lo : lo + AT_ONCE], w[lo : lo + AT_ONCE], k)]
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query.

    vectors: (vec_id, embedding). Components become floor(1024 * x). Queries
    are the rows whose vec_id is divisible by ``every``; candidates are all
    rows with another vec_id and as many components. Score: inner product;
    ties go to the smaller vec_id; a query with fewer candidates has fewer
    rows. Scores beyond 64 bits count as the least or greatest of 64 bits.

    Rows without vec_id, with a null or empty vector or with null or
    non-finite components take no part. Rows that repeat a vec_id with the
    same vector count once; with another vector they are queries and
    candidates of their own, and such queries share one ranking. An empty
    table gives an empty one; other columns are ignored.
    """
    bounded_batches(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    base = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vec"))
        .where("vec_id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        .dropDuplicates(["vec_id", "vec"])
        .withColumn("dim", F.size("vec"))
    )
    base = materialise(base, "vectors")
    candidates = _blocks(base, VECTOR_BLOCK, "candidates")
    queries = _blocks(base.where(F.col("vec_id") % every == 0), QUERY_BLOCK, "queries").withColumnsRenamed({"ids": "qids", "m": "q", "block": "query_block"})
    counts = candidates.groupBy("dim").agg(F.max("block").alias("last"))
    queries = queries.join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    met = candidates.join(queries, ["dim", "block"]).repartition("dim", "block", "query_block")
    partial = met.mapInArrow(released(_score(k)), "query_id long, vec_id long, score long").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
