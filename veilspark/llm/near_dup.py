"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Texts with the same shingle set form one class (a partial aggregation), so
   groups of copies never meet anywhere.
2. Each class is posted under its (coordinate, value) tokens. Tokens of one
   class only cannot collide and are skipped. Of the rest only a prefix is
   posted: two signatures that agree in ``matches`` of ``coordinates`` share
   one of the ``coordinates - matches + 1`` rarest tokens of either.
3. Each posting list is merged: collisions are counted over whole signatures,
   first with the list's first class, then only for classes which that one
   didn't reach. Classes with at least ``matches`` collisions are connected;
   a list emits a spanning forest, never its pairs.
4. Links are confirmed on full shingle sets within the connected clusters.
   Large clusters are dealt out to blocks of bounded size, each with the
   cluster's first class too, which connects most of a group of near copies
   in one linear pass; only clusters that aren't connected by then are
   compared in pairs of blocks. Pairs that are already connected are skipped.

A pair at the similarity bound itself is missed with the probability that a
binomial(coordinates, similarity) falls below ``matches``; by default that is
MARGIN standard deviations below its mean (42 of 64 for 85 %: 3e-5).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, find, forest
from .shingles import batches, mix, shingle_sets
from .storage import bounded_batches, materialise, released

COORDINATES = 64
#: Standard deviations that the match threshold lies below the mean.
MARGIN = 4.5
LIST_BLOCK = 8192
SET_BLOCK = 1_000_000
BROADCAST_ROWS = 1_000_000


def signatures(values: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """Minimum of each of ``coordinates`` hash functions over each set."""
    rng = np.random.Generator(np.random.PCG64(5))
    a = rng.integers(0, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, coordinates, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, coordinates), np.uint64)
    if len(full):
        for k in range(coordinates):
            out[full, k] = mix(np.minimum.reduceat(values * a[k] + b[k], offsets[full]), k)
    return out


def _sketch(coordinates: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame["text"].to_pylist()
            for lo, hi in batches(texts):
                values, offsets = shingle_sets(texts[lo:hi])
                n = np.diff(offsets)
                key = _set_keys(values, offsets)
                sig = signatures(values, offsets, coordinates)
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, coordinates), pa.int32()), pa.array(sig.view(np.int64).ravel()))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": frame["doc_id"].slice(lo, hi - lo), "text_hash": frame["text_hash"].slice(lo, hi - lo), "n_shingles": n, "h1": key[0], "h2": key[1], "tokens": tokens, "sig": [x.tobytes() for x in sig.astype(np.uint16)]}
                )

    return run


def _set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set, which stand for its identity."""
    full = np.flatnonzero(np.diff(offsets))
    key = np.zeros((2, len(offsets) - 1), np.uint64)
    if len(full):
        for k in range(2):
            key[k, full] = np.add.reduceat(mix(values, 10 + k), offsets[full])
    return key.view(np.int64)


def _resketch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        texts = frame["text"].to_pylist()
        for lo, hi in batches(texts):
            values, offsets = shingle_sets(texts[lo:hi])
            key = _set_keys(values, offsets)
            sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"n_shingles": np.diff(offsets), "h1": key[0], "h2": key[1], "shingles": sets})


def _merge_list(ids: np.ndarray, side: np.ndarray, sig: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Spanning edges of the classes of one posting list or pair of blocks.

    side: for two different blocks 0 or 1, and only pairs across are looked
    at; else 0 throughout.
    """
    across = side.any() and not side.all()
    parent: dict[int, int] = {}
    out = []

    def join(i: int, hits: np.ndarray) -> None:
        for j in hits.tolist():
            x, y = find(parent, i), find(parent, j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[j])))

    for i in range(len(ids)):
        if i and find(parent, i) == 0:
            continue
        others = (side != side[i]) if across else np.ones(len(ids), bool)
        others[i] = False
        join(i, np.flatnonzero(others & (np.count_nonzero(sig == sig[i], axis=1) >= matches)))
    return out


def _keys(frame, keys: list[str]) -> np.ndarray:
    return np.stack([frame[k].to_numpy(zero_copy_only=False) if isinstance(frame, pa.RecordBatch) else frame[k].to_numpy() for k in keys], axis=1)


def _segments(frames: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups of frames that are sorted by ``keys``."""
    rest: list[pa.RecordBatch] = []
    at = None
    for frame in frames:
        if not frame.num_rows:
            continue
        k = _keys(frame, keys)
        if rest and (k[0] != at).any():
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        other = np.flatnonzero((k != k[-1]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*rest, frame.slice(0, cut)]).combine_chunks()
            rest = []
        rest.append(frame.slice(cut))
        at = k[-1]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _bounds(frame: pa.Table, keys: list[str]) -> np.ndarray:
    k = _keys(frame, keys)
    return np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]))


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*set(edges), strict=True) if edges else ((), ())
    return pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _weak_edges(matches: int):
    keys = ["token", "bi", "bj"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _segments(frames, keys):
            at = _bounds(frame, keys)
            ids, b, bi, bj = (frame[c].to_numpy() for c in ("class_id", "b", "bi", "bj"))
            side = b != bi
            sig = np.frombuffer(b"".join(frame["sig"].to_pylist()), np.uint16).reshape(len(ids), -1)
            first = np.repeat(at[:-1], np.diff(at))
            reached = np.empty(len(ids), bool)
            for lo in range(0, len(ids), LIST_BLOCK):
                part = slice(lo, lo + LIST_BLOCK)
                reached[part] = np.count_nonzero(sig[part] == sig[first[part]], axis=1) >= matches
            reached &= bi == bj
            new = np.flatnonzero(reached & (first != np.arange(len(ids))))
            edges = list(zip(ids[new].tolist(), ids[first[new]].tolist(), strict=True))
            for g in np.flatnonzero(np.add.reduceat(~reached, at[:-1])).tolist():
                s = slice(at[g], at[g + 1])
                if at[g + 1] - at[g] > 1:
                    edges += _merge_list(ids[s], side[s], sig[s], matches)
            yield _edge_batch(edges)

    return run


def _confirm_block(ids, side, n, values, offsets, similarity: int, root: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the links of one cluster or pair of its blocks.

    Every pair (across, for two blocks) that isn't connected yet is compared
    on its full sets; root: equal for classes that are connected by now.
    """
    across = side.any() and not side.all()
    _, local = np.unique(values, return_inverse=True)
    mark = np.zeros(int(local.max()) + 1 if len(local) else 0, np.int64)
    root = np.unique(root, return_inverse=True)[1]
    out = []
    for i in range(len(ids)):
        others = np.flatnonzero((root != root[i]) & ((side != side[i]) if across else (np.arange(len(ids)) != i)) & (100 * np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])))
        if not len(others):
            continue
        own = local[offsets[i] : offsets[i + 1]]
        mark[own] = 1
        where = np.concatenate([local[offsets[j] : offsets[j + 1]] for j in others])
        starts = np.concatenate(([0], np.cumsum(n[others])))[:-1]
        both = np.add.reduceat(mark[where], starts)
        mark[own] = 0
        for j in others[100 * both >= similarity * (n[others] + n[i] - both)].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _links(similarity: int):
    keys = ["label", "bi", "bj"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _segments(frames, keys):
            at = _bounds(frame, keys)
            ids, roots = frame["class_id"].to_numpy(), frame["root"].to_numpy()
            side = frame["b"].to_numpy() != frame["bi"].to_numpy()
            sets = frame["shingles"].combine_chunks()
            sets = sets if isinstance(sets, pa.ListArray) else sets.chunk(0)
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            edges = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo > 1:
                    edges += _confirm_block(ids[lo:hi], side[lo:hi], np.diff(ends[lo : hi + 1]), values[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], similarity, roots[lo:hi])
            yield _edge_batch(edges)

    return run


def _in_blocks(df: DataFrame, nb: str) -> DataFrame:
    """Deals rows to the pairs (bi, bj) of the blocks of their group."""
    df = df.withColumn("b", F.expr(f"cast(pmod(xxhash64(class_id), {nb}) as int)"))
    return df.withColumn("o", F.explode(F.expr(f"sequence(0, cast({nb} as int) - 1)"))).select(
        "*", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj")
    ).drop("o")


def near_duplicates(
    docs: DataFrame,
    similarity: int = 85,
    coordinates: int = COORDINATES,
    matches: int | None = None,
    list_block: int = LIST_BLOCK,
    set_block: int = SET_BLOCK,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its component.

    Links texts with ``100 * intersection >= similarity * union`` of their
    shingle sets. Returns doc_id, text_hash (xxhash64), n_shingles, component_id
    (smallest doc_id of the component), kept, cluster (a label of the
    component that doesn't depend on ids) and first (the component's row with
    the smallest doc_id, then text_hash; rows that repeat both share it).

    Null and word-less texts have n_shingles 0 and no cluster, are linked with
    nothing and are first. Repeated rows are copies of each other. A null doc_id is never a
    component_id unless all ids of the component are null; such rows are kept.
    Components without ids, or with one id in common, differ in cluster.
    An empty table gives an empty one; other columns of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    if matches is None:
        share = similarity / 100
        matches = max(1, math.ceil(coordinates * share - MARGIN * math.sqrt(coordinates * share * (1 - share))))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    sketched = base.mapInArrow(released(_sketch(coordinates)), "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, tokens array<long>, sig binary")
    key = ["n_shingles", "h1", "h2"]
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = materialise(sketched, "sketch")
    classes = materialise(
        rows.where("n_shingles > 0").groupBy(*key).agg(F.min(row).alias("rep"), F.any_value("tokens").alias("tokens"), F.any_value("sig").alias("sig")).withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )

    posted = classes.select("class_id", F.explode("tokens").alias("token"))
    frequent = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    prefix = coordinates - matches + 1
    lists = (
        posted.join(frequent, "token").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        .withColumn("t", F.slice("t", F.lit(1), F.greatest(F.lit(0), F.lit(prefix - coordinates) + F.size("t"))))
        .where(F.size("t") > 0)
    )
    lists = materialise(lists.join(classes.select("class_id", "sig"), "class_id").select("class_id", "sig", F.explode("t.token").alias("token")), "lists")
    sizes = lists.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token", F.ceil(F.col("n") / list_block).alias("nb"))
    weak = _in_blocks(lists.join(sizes, "token"), "nb").select("token", "bi", "bj", "b", "class_id", "sig")
    weak_edges, confirmed = _weak_edges(matches), _links(similarity)
    weak = weak.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "class_id").mapInArrow(released(lambda frames: forest(weak_edges(frames))), "src long, dst long")
    clusters = materialise(connected_components(weak, reduced=True).withColumnRenamed("node", "class_id"), "clusters")

    near = clusters.join(classes.select("class_id", "rep", *key), "class_id")
    blocks = near.groupBy("label").agg(F.ceil(F.sum("n_shingles") / set_block).alias("nb"))
    near = materialise(near.join(blocks, "label"), "near")

    def full_sets(part: DataFrame) -> DataFrame:
        ids = part.select("rep.doc_id", "rep.text_hash")
        if part.count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        texts = base.join(ids, base["doc_id"].eqNullSafe(ids["doc_id"]) & (base["text_hash"] == ids["text_hash"]), "left_semi").select("text")
        sets = texts.mapInArrow(released(_resketch), "n_shingles long, h1 long, h2 long, shingles array<long>")
        return part.join(sets, key).dropDuplicates(["class_id"])

    def linked(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("label", "bi", "bj", "b", "class_id", "root", "shingles").repartition("label", "bi", "bj").sortWithinPartitions("label", "bi", "bj", "class_id")
        return dealt.mapInArrow(released(lambda frames: forest(confirmed(frames))), "src long, dst long")

    zero, own = F.lit(0), F.col("class_id").alias("root")
    links = linked(full_sets(near.where("nb = 1")).select("*", zero.alias("bi"), zero.alias("bj"), zero.alias("b"), own))
    if near.where("nb > 1").limit(1).count():
        large = materialise(full_sets(near.where("nb > 1")), "large")
        block = F.expr("cast(pmod(xxhash64(class_id), nb) as int)")
        first = F.explode(F.when(F.col("class_id") == F.col("label"), F.expr("sequence(0, cast(nb as int) - 1)")).otherwise(F.array(block)))
        alone = large.select("*", first.alias("bi"), own).withColumns({"bj": F.col("bi"), "b": F.col("bi")})
        links = materialise(links.unionByName(linked(alone)), "links")
        roots = connected_components(links, reduced=True).select(F.col("node").alias("class_id"), F.col("label").alias("found"))
        rooted = large.join(roots, "class_id", "left").withColumn("root", F.coalesce("found", "class_id")).drop("found")
        apart = materialise(rooted.groupBy("label").agg((F.min("root") < F.max("root")).alias("apart")).where("apart").select("label"), "apart")
        if apart.limit(1).count():
            links = links.unionByName(linked(_in_blocks(rooted.join(apart, "label"), "nb").where("bi < bj")))
    parts = connected_components(links, reduced=True).withColumnRenamed("node", "class_id")

    named = parts.join(classes.select("class_id", "rep"), "class_id")
    lowest = named.groupBy("label").agg(F.min("rep").alias("low"))
    low = classes.select("class_id", *key, "rep").join(named.join(lowest, "label").select("class_id", "label", "low"), "class_id", "left")
    low = low.select(*key, F.coalesce("low", "rep").alias("low"), F.coalesce("label", "class_id").alias("cluster"))
    out = rows.select("doc_id", "text_hash", *key).join(low, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("low.doc_id")).otherwise(F.col("doc_id"))
    first = F.when(F.col("n_shingles") > 0, row == F.col("low")).otherwise(True)
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "cluster", first.alias("first"))
