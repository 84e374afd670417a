"""Wildcard patterns joined with texts by an index of their parts.

A pattern is an exact text, ``*``, or ``*x*`` for what contains x, in any case.
Exact ones are joined on equality. Of ``*x*`` the rarest run of letters, as
long as the greatest of RUNS that fits in x, is looked up among the runs of all
texts, and only what shares it is compared, so no join compares every pattern
with every text. Runs grow with the patterns: short ones of many patterns and
texts would be shared by ever more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffled

#: Parts of the texts that patterns for everything meet.
_DEAL = 64
#: Letters of a run: a run has more than half of a pattern of up to 63 letters.
RUNS = (1, 2, 4, 8, 16, 32)


def is_part(pattern: Column) -> Column:
    return (F.length(pattern) > 1) & pattern.startswith("*") & pattern.endswith("*")


def bare(pattern: Column) -> Column:
    return F.substring(pattern, F.lit(2), F.length(pattern) - 2)


def _runs(text: Column, n: Column) -> Column:
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    return F.coalesce(F.transform(at, lambda i: F.substring(text, i, n)), F.expr("cast(array() as array<string>)"))


def _run_length(text: Column) -> Column:
    return F.greatest(*[F.when(F.length(text) >= n, n).otherwise(RUNS[0]) for n in RUNS], F.lit(RUNS[0]))


def matches(patterns: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """Each row of ``patterns`` (keys, pattern, ...) with each of ``values``
    (keys, value, ...) of equal keys that it matches; no other column may be in
    both. Nulls match nothing. Both may be large, so no side is broadcast."""
    p = patterns.withColumn("__p", F.lower("pattern"))
    v = values.where("value is not null").withColumn("__v", F.lower("value")).withColumn("__one", F.length("__v") - F.length("__v"))
    columns = [*patterns.columns, *[c for c in values.columns if c not in keys]]
    wild = is_part(F.col("__p"))
    every = (F.col("__p") == "*") | (wild & (bare(F.col("__p")) == ""))
    exact = p.where(~wild & (F.col("__p") != "*")).withColumn("__v", F.col("__p")).join(shuffled(v), [*keys, "__v"]).select(*columns)
    dealt = v.withColumn("__deal", F.pmod(F.xxhash64("__v"), F.lit(_DEAL)).cast("int"))
    all_ = p.where(every).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(_DEAL - 1)))).join(shuffled(dealt), [*keys, "__deal"]).select(*columns)
    parts = p.where(wild & ~every).withColumn("__x", bare(F.col("__p"))).withColumn("__n", _run_length(F.col("__x")))
    # texts give runs of the lengths alone that patterns ask for
    lengths = parts.agg(F.collect_set("__n").alias("__ns")).withColumn("__one", F.size("__ns") - F.size("__ns"))
    texts = v.select(*keys, "value", "__v", "__one").distinct().join(F.broadcast(lengths), "__one")
    grams = texts.select(*keys, "value", "__v", F.explode(F.array_distinct(F.flatten(F.transform("__ns", lambda n: _runs(F.col("__v"), n))))).alias("__gram"))
    counts = grams.groupBy("__gram").agg(F.count("*").alias("__held"))
    asked = parts.select(*keys, "pattern", "__x", "__n").distinct()
    asked = asked.select(*keys, "pattern", "__x", F.explode(F.array_distinct(_runs(F.col("__x"), F.col("__n")))).alias("__gram")).join(shuffled(counts), "__gram")
    rarest = asked.groupBy(*keys, "pattern", "__x").agg(F.min_by("__gram", F.struct("__held", "__gram")).alias("__gram"))
    hits = rarest.join(shuffled(grams), [*keys, "__gram"]).where(F.contains("__v", F.col("__x"))).select(*keys, "pattern", "value")
    held = hits.join(shuffled(patterns), [*keys, "pattern"]).join(shuffled(values), [*keys, "value"]).select(*columns)
    return exact.unionByName(all_).unionByName(held)


def coverings(wide: DataFrame, narrow: DataFrame, *keys: str) -> DataFrame:
    """Each row of ``wide`` (keys, pattern, ...) with each of ``narrow`` (keys,
    narrow, ...) whose pattern it provably covers and isn't equal to."""
    w = F.col("pattern")
    able = wide.where((w == "*") | (is_part(w) & (F.length(w) > 2)))
    n = F.col("narrow")
    value = F.when(n == "*", F.lit("*")).when(is_part(n) & (F.length(n) > 2), bare(n)).otherwise(n)
    met = matches(able, narrow.withColumn("value", value), *keys)
    # what matches everything is covered by what matches everything alone
    return met.where((F.col("pattern") != F.col("narrow")) & ((F.col("narrow") != "*") | (F.col("pattern") == "*"))).drop("value")
