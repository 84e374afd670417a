"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, released


def find(parent: dict, x):
    """Root of ``x`` with path halving; unknown nodes are their own root."""
    while (p := parent.get(x, x)) != x:
        parent[x] = g = parent.get(p, p)
        x = g
    return x


def forest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars around the smallest node."""
    for frame in frames:
        parent: dict[int, int] = {}
        for a, b in zip(frame["src"].to_pylist(), frame["dst"].to_pylist(), strict=True):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_pydict({"src": pa.array(nodes, pa.int64()), "dst": pa.array([find(parent, x) for x in nodes], pa.int64())})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step; minima are pre-aggregated before any shuffle."""
    if large:
        both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")).toDF("src", "dst"))
    else:
        both = edges
    low = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
    joined = both.join(low, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", F.col("m")).toDF("src", "dst"))
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame, reduced: bool = False) -> DataFrame:
    """(node, label) of every node of ``edges`` (src long, dst long).

    label is the smallest node of the component. Alternates the large-star
    and small-star contractions until the edge set stays the same, which takes
    a number of rounds logarithmic in the longest path; each round is written
    to the shared folder. Nulls and loops in ``edges`` are ignored; no edges
    give no rows. ``reduced``: forest() has been over the edges where they
    were made, so they need no worker of their own.
    """
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    edges = materialise((edges if reduced else edges.mapInArrow(released(forest), "src long, dst long")).distinct(), "edges")
    state = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if not sums[0] or tuple(sums) == state:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(
                edges.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
            )
        state = tuple(sums)
        edges = materialise(_star(_star(edges, True), False), "edges")
