"""Mixing sources to target weights by hash-random keys and prefix sums.

Every document gets a random key from a hash of its id. A source's documents
are cut into ranges of equal width of the key; as keys are uniform, ranges are
even, whatever share of the rows a source has. Sums of the ranges give each
range's offset, sums within a range each document's place, and the budget cuts
the order at the exact word; a budget above the source's size takes whole
epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
RANGE_ROWS = 5_000
KEYS = 1 << 32


def words(text: Column) -> Column:
    """Number of runs of other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of their code points, null last, have the weights in
    turn. All sizes together are shared by weight; no target exceeds ``most``
    times its source's size, and what is above is shared again among the
    others. With sources by size per weight, the capped ones come first: the
    level is the rest divided by the weight of the others, at the first
    source whose cap it doesn't exceed.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    sized = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    in_turn = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").cast("binary").asc_nulls_last())
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    others = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = sized.withColumns({"level": rest / others, "turn": F.row_number().over(in_turn)})
    level = level.withColumn("open", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("turn"))).over(everything))
    level = level.withColumn("level", F.min(F.when(F.col("turn") == F.col("open"), F.col("level"))).over(everything))
    target = F.when(F.col("turn") < F.col("open"), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level")))
    return level.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text) with its part in the
    mix: doc_id, source, the columns in ``keep``, size, source_size, target,
    taken, epochs.

    taken: the words that the mix takes of the document; whole epochs of its
    source, and in the last one the documents by random key up to the
    source's budget, of which the one at the cut gives only the words that
    fit. A source's taken words are its target without the fraction.
    epochs: how often the document occurs, the cut occurrence included.

    Null and empty texts have size 0 and are never taken. Rows with one doc_id
    are rows of their own, in order of size. A null source is a source. An
    empty table gives an empty one; columns that aren't kept are ignored.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), *keep).withColumn("key", key), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sources.select("source", "source_size"), weights, most)
    budget = F.floor("target").cast("long")
    plan = targets.join(sources.select(F.col("source").alias("s"), F.ceil(F.col("n") / RANGE_ROWS).alias("ranges")), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", "ranges",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("full"),
    ).withColumn("rest", F.floor("target").cast("long") - F.col("full") * F.col("source_size"))
    plan = materialise(plan, "plan")
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.floor(F.col("key") * F.col("ranges") / KEYS))
    dealt = materialise(dealt.drop("s", "ranges"), "dealt")
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("place", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("place"))).cast("long")
    return placed.select("doc_id", "source", *keep, "size", "source_size", "target", (F.col("full") * F.col("size") + part).alias("taken"), (F.when(F.col("size") > 0, F.col("full")).otherwise(0) + F.when(part > 0, 1).otherwise(0)).cast("int").alias("epochs"))


MIX_ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER ()) - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0) AS rest,
         (sum(w) OVER ()) - coalesce(sum(w) OVER b, 0) AS others,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) ASC NULLS LAST) AS turn
  FROM src WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT min(turn) FILTER (WHERE rest / others <= cap / w) AS open FROM lev),
tgt AS (
  SELECT source, source_size,
         CASE WHEN turn < open THEN cap
              ELSE least(cap, w * (SELECT min(rest / others) FROM lev, cut WHERE turn = open)) END AS target
  FROM lev, cut),
pl AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS f FROM tgt),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.f, floor(p.target)::BIGINT - p.f * p.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place,
         d.source
  FROM sized d JOIN pl p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target,
       (f * size + greatest(0, least(size, rest - place)))::BIGINT AS taken,
       (CASE WHEN size > 0 THEN f ELSE 0 END + CASE WHEN greatest(0, least(size, rest - place)) > 0 THEN 1 ELSE 0 END)::INT AS epochs
FROM placed
"""
