"""Dictionaries of any size: texts are routed to the shards of values that
they may hold.

Each value has an anchor, the run of GRAM bytes that fewest values share, and
goes to the shard of its anchor; shorter values are their own anchors. A text
visits only shards of anchors that it holds, for which a bitmap of all anchors
(at most MOST_BITS) is sent to the tasks. A shard's texts are dealt out to parts
of about PART_BYTES; the task of a part builds one automaton of the shard's
values and reads its texts through it. All matches of a text meet again,
and the leftmost-longest ones are taken across shards. The dictionary is never
on the driver, and no task holds more than a shard of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_token
from ..session import written

GRAM = 4
#: Bytes of the values of a shard, about.
SHARD_BYTES = 32 << 20
#: Bytes of the texts that one task reads through a shard, about.
PART_BYTES = 32 << 20
MOST_BITS = 1 << 27
MATCH = "doc_id long, start int, length int, value string, category string"
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(raw: bytes, sizes: tuple[int, ...]) -> np.ndarray:
    """Distinct runs of bytes of each size, as numbers that tell sizes apart."""
    a = np.frombuffer(raw, np.uint8).astype(_U)
    out = [np.zeros(0, _U)]
    for n in sizes:
        if len(a) >= n:
            g = np.full(len(a) - n + 1, n, _U)
            for k in range(n):
                g = g << _U(8) | a[k : len(a) - n + 1 + k]
            out.append(np.unique(g))
    return np.concatenate(out)


def _value_grams(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        values, categories, found = [], [], []
        for v, c in zip(frame["value"].to_pylist(), frame["category"].to_pylist(), strict=True):
            raw = v.encode()
            own = grams(raw, (min(GRAM, len(raw)),)).tolist()
            values += [v] * len(own)
            categories += [c] * len(own)
            found += own
        yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string()), "category": pa.array(categories, pa.string()), "gram": pa.array(found, pa.int64())})


def _placed(bits: int, shards: int):
    """Adds to each anchor its shard and its place in the bitmap."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            h = _mix(frame["gram"].to_numpy(zero_copy_only=False).astype(_U))
            at = h & _U(bits - 1)
            columns = [*frame.columns, pa.array((h >> _U(32)) % _U(shards), pa.int64()), pa.array((at >> _U(6)).astype(np.int64)), pa.array((at & _U(63)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*frame.schema.names, "shard", "word", "bit"])

    return run


def _routed(bits: int, shards: int, sizes: tuple[int, ...], bitmap):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids, places, lengths = [], [], []
            for i, text in zip(frame["doc_id"].to_pylist(), frame["text"].to_pylist(), strict=True):
                raw = (text or "").encode()
                h = _mix(grams(raw, sizes))
                at = h & _U(bits - 1)
                hit = bitmap.value[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1) == 1
                own = np.unique((h[hit] >> _U(32)) % _U(shards)).tolist()
                ids += [i] * len(own)
                places += own
                lengths += [len(raw)] * len(own)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "shard": pa.array(places, pa.int64()), "n": pa.array(lengths, pa.int64())})

    return run


def _matched(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All matches of the texts of each part of a shard; its values come first."""
    import ahocorasick

    rows = (r for frame in frames for r in frame.to_pylist())
    for _, own in groupby(rows, lambda r: (r["shard"], r["part"])):
        automaton, made, out = ahocorasick.Automaton(), False, []

        def batch():
            columns = list(zip(*out, strict=True)) or [[]] * 5
            names = [x.split()[0] for x in MATCH.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=names)

        for r in own:
            if r["value"] is not None:
                automaton.add_word(r["value"], (r["value"], r["category"]))
                continue
            if not made:
                automaton.make_automaton()
                made = True
            if len(automaton):
                out += [(r["doc_id"], end + 1 - len(v), len(v), v, c) for end, (v, c) in automaton.iter(r["text"])]
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if out:
            yield batch()


def matches(texts: DataFrame, dictionary: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, start, length, value, category) of every dictionary value in
    every text (doc_id, text), overlaps included, from 0 in characters.

    dictionary: (value, category); of a value's categories the last in order
    counts, null and empty values don't. doc_ids are distinct; null texts hold
    nothing.
    """
    spark = texts.sparkSession
    own = dictionary.where("value is not null and value <> ''").groupBy("value").agg(F.max("category").alias("category"))
    each = written(own.mapInArrow(_value_grams, "value string, category string, gram long"), "grams")
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    anchored = each.join(counts, "gram").groupBy("value", "category").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)), F.sort_array(F.collect_set(F.least(F.octet_length("value"), F.lit(GRAM))))).first()
    if not size[0]:
        return spark.createDataFrame([], MATCH)
    bits = min(MOST_BITS, max(64, 1 << (16 * size[0] - 1).bit_length()))
    shards = max(1, -(-size[1] // shard_bytes))
    placed = written(anchored.mapInArrow(_placed(bits, shards), "value string, category string, gram long, shard long, word long, bit int"), "anchors")
    words = placed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(bits >> 6, _U)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(_U)
    base = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    routes = written(base.mapInArrow(_routed(bits, shards, tuple(size[2]), spark.sparkContext.broadcast(bitmap)), "doc_id long, shard long, n long"), "routes")
    # a row for each shard, of which there are few: each has SHARD_BYTES of values
    sizes = written(routes.groupBy("shard").agg(F.ceil((F.sum("n") + 1) / PART_BYTES).cast("long").alias("parts")), "parts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes.agg(F.sum("parts")).first()[0] or 1)
    none = F.lit(None).cast("string")
    dealt = routes.join(F.broadcast(sizes), "shard").select("doc_id", "shard", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))
    visits = dealt.join(base, "doc_id").select("shard", "part", F.lit(1).alias("kind"), "doc_id", "text", none.alias("value"), none.alias("category"))
    copies = placed.join(F.broadcast(sizes), "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    held = copies.select("shard", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), none.alias("text"), "value", "category")
    return held.unionByName(visits).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(_matched, MATCH)


def leftmost_longest(found: DataFrame) -> DataFrame:
    """(doc_id, parts) of matches(): those of each text that are left when one
    goes from left to right, takes the longest at each place and goes on
    behind it; in order, as (start, length, value, category)."""
    longest = found.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "start").orderBy(F.desc("length")))).where("__n = 1")
    listed = longest.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "value", "category"))).alias("m"))
    kind = "array<struct<start:int,length:int,value:string,category:string>>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("taken"))
    step = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct((x["start"] + x["length"]).alias("at"), F.array_append(acc["taken"], x).alias("taken"))).otherwise(acc)
    return listed.select("doc_id", F.aggregate("m", start, step)["taken"].alias("parts"))


def replace_values(texts: DataFrame, dictionary: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``texts`` (doc_id, text) with each leftmost-longest value of a
    dictionary of any size replaced by its category's token."""
    parts = leftmost_longest(matches(texts, dictionary, shard_bytes))
    met = texts.join(parts.withColumnRenamed("doc_id", "__d"), F.col("doc_id") == F.col("__d"), "left").drop("__d")
    return met.withColumn("text", F.when(F.col("parts").isNull(), F.col("text")).otherwise(_rebuilt(F.col("text"), F.col("parts")))).drop("parts")


def _rebuilt(text: Column, parts: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    step = lambda acc, p: F.struct((p["start"] + p["length"]).alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), mask_token(p["category"], p["value"]))).alias("out"))
    done = F.aggregate(parts, start, step)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text) - done["at"]))
