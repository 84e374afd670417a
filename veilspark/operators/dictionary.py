"""Value dictionaries: statistics, hits and replacement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mask_token, replace_matches
from . import automata

#: Up to so many values one alternation is used, beyond an automaton.
NATIVE_VALUES = 200
LARGE_SOURCE = 100_000
#: What a dictionary has at most; checked before it goes to the driver.
MAX_VALUES, MAX_BYTES = 1_000_000, 1 << 30


def source_stats(feed: DataFrame) -> DataFrame:
    """(source_path, category, values, bytes) of a feed (pos, source_path,
    category, value)."""
    return feed.groupBy("source_path").agg(F.min_by("category", "pos").alias("category"), F.count("*").alias("values"), F.sum(F.octet_length("value")).cast("long").alias("bytes"))


def first_source(feed: DataFrame) -> DataFrame:
    return feed.groupBy("category").agg(F.min_by("source_path", "pos").alias("source_path"))


def last_wins(feed: DataFrame) -> DataFrame:
    """(value, category): the category that a value has last in the feed."""
    return feed.groupBy("value").agg(F.max_by("category", "pos").alias("category"))


def fingerprint(dictionary: DataFrame) -> DataFrame:
    """A hash of (value, category) pairs that doesn't depend on their order."""
    entry = F.conv(F.substring(F.md5(F.concat_ws("\x1f", "value", "category")), 1, 15), 16, 10).cast("long")
    return dictionary.agg(F.bit_xor(entry).alias("fingerprint"), F.count("*").alias("n_values"))


def large_sources(stats: DataFrame, threshold: int = LARGE_SOURCE) -> DataFrame:
    """Load time and memory of sources of ``threshold`` values or more; where
    ``stats`` has an estimate of the values, the larger number counts."""
    if "estimated" in stats.columns:
        stats = stats.withColumn("values", F.greatest("values", "estimated"))
    big = stats.where(F.col("values") >= threshold)
    return big.select("source_path", "values", F.greatest(F.lit(1), F.ceil(F.col("values") / 20000)).cast("long").alias("load_s"), (F.col("bytes") * 2 + F.col("values") * 48).cast("long").alias("memory_bytes"))


def loaded(dictionary: DataFrame, most: int = MAX_VALUES, most_bytes: int = MAX_BYTES) -> dict[str, str]:
    """value -> category of a dictionary (value, category), which is checked to
    have at most ``most`` values and ``most_bytes`` bytes before it is fetched."""
    own = dictionary.where("value is not null and value <> ''").select("value", "category").distinct()
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    if n > most or size > most_bytes:
        raise ValueError(f"a dictionary has at most {most} values and {most_bytes} bytes, not {n} and {size}")
    return {r["value"]: r["category"] for r in own.orderBy("value", "category").collect()}


def contained(texts: DataFrame, values: dict[str, str], name: str, column: str = "text") -> DataFrame:
    """``texts`` with ``name``: the values that stand in ``column``, overlaps
    included; one pass of an automaton for each text."""
    if not values:
        return texts.withColumn(name, F.expr("cast(array() as array<string>)"))
    shared = texts.sparkSession.sparkContext.broadcast(values)
    schema = T.StructType([*texts.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))])
    return texts.mapInArrow(automata.contained(column, name, automata.content_key(values), shared), schema)


def held_values(texts: DataFrame, values: dict[str, str], name: str, column: str = "text", native: int = NATIVE_VALUES) -> DataFrame:
    """``texts`` with ``name``: (value, category) of the values that stand in
    ``column``, overlaps included, in order of the values; compared with each
    of up to ``native`` values, beyond that one pass of an automaton."""
    if not values:
        return texts.withColumn(name, F.expr("cast(array() as array<struct<value:string,category:string>>)"))
    if len(values) <= native:
        each = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(values[v]).alias("category")) for v in sorted(values)])
        return texts.withColumn(name, F.filter(each, lambda x: F.coalesce(F.contains(F.col(column), x["value"]), F.lit(False))))
    shared = texts.sparkSession.sparkContext.broadcast(values)
    kind = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("category", T.StringType())]))
    return texts.mapInArrow(automata.held(column, name, automata.content_key(values), shared), T.StructType([*texts.schema.fields, T.StructField(name, kind)]))


def marked_values(texts: DataFrame, values: dict[str, str], column: str, name: str, native: int = NATIVE_VALUES) -> DataFrame:
    """``texts`` with ``name``: ``column`` in parts (before, value, category),
    value and category of the leftmost-longest matches, null in the last part;
    by one alternation of up to ``native`` values, beyond that an automaton."""
    part = T.StructType([T.StructField(n, T.StringType()) for n in ("before", "value", "category")])
    if not values:
        return texts.withColumn(name, F.array(F.struct(F.coalesce(column, F.lit("")).alias("before"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("category"))))
    if len(values) <= native:
        pattern = "|".join(re.escape(v) for v in sorted(values, key=lambda v: (-len(v), v)))
        kinds = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        found = F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(m.alias("value"), F.element_at(kinds, m).alias("category")))
        between = F.split(F.coalesce(column, F.lit("")), pattern, -1)
        return texts.withColumn(name, F.zip_with(between, found, lambda b, f: F.struct(b.alias("before"), f["value"].alias("value"), f["category"].alias("category"))))
    shared = texts.sparkSession.sparkContext.broadcast(values)
    return texts.mapInArrow(automata.parts(column, name, automata.content_key(values), shared), T.StructType([*texts.schema.fields, T.StructField(name, T.ArrayType(part))]))


def hits(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, value, category) of every dictionary value in every text
    (doc_id, text), overlaps included. dictionary: (value, category), within
    the bounds of loaded(); a value of several categories has a row for each."""
    found = contained(texts.select("doc_id", "text"), loaded(dictionary), "value").select("doc_id", F.explode("value").alias("value"))
    return found.join(dictionary.select("value", "category"), "value").select("doc_id", "value", "category")


def action_of(categories: DataFrame, rules: DataFrame) -> DataFrame:
    """(category, action) of dictionary categories (category): that of the
    strongest dictionary rule (pos, selector, pattern, action, category,
    priority) whose pattern matches, else mask."""
    from .policy import strongest_rules

    fields = categories.select(F.col("category").alias("field"), F.lit("dictionary").alias("selector"), F.col("category").alias("value")).distinct()
    best = strongest_rules(fields, rules).select(F.col("field").alias("category"), "action")
    return categories.select("category").distinct().join(best, "category", "left").select("category", F.coalesce("action", F.lit("mask")).alias("action"))


def replace_values(texts: DataFrame, values: dict[str, str], column: str = "text", pairs: str | None = None, native: int = NATIVE_VALUES) -> DataFrame:
    """Leftmost-longest replacement of each value by its category's token.

    Up to ``native`` values: one alternation, longest first, which for literals
    is the same; more: an automaton, built once per worker. ``pairs``: a further
    column of the (token, value) that were put in.
    """
    none = F.expr("cast(array() as array<struct<token:string,value:string>>)")
    if not values:
        return texts if pairs is None else texts.withColumn(pairs, none)
    if len(values) <= native:
        longest = sorted(values, key=lambda v: (-len(v), v))
        pattern = "|".join(re.escape(v) for v in longest)
        kinds = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        token = lambda m: mask_token(F.element_at(kinds, m), m)
        if pairs is not None:
            found = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(f"({pattern})"), F.lit(1)))
            texts = texts.withColumn(pairs, F.coalesce(F.transform(found, lambda m: F.struct(token(m).alias("token"), m.alias("value"))), none))
        return texts.withColumn(column, replace_matches(F.col(column), pattern, token))
    shared = texts.sparkSession.sparkContext.broadcast(values)
    marked = f"__{column}_parts"
    part = T.StructType([T.StructField(n, T.StringType()) for n in ("before", "value", "category")])
    schema = T.StructType([*texts.schema.fields, T.StructField(marked, T.ArrayType(part))])
    out = texts.mapInArrow(automata.parts(column, marked, automata.content_key(values), shared), schema)
    rebuilt = F.array_join(F.transform(marked, lambda p: F.concat(p["before"], F.when(p["value"].isNull(), "").otherwise(mask_token(p["category"], p["value"])))), "")
    if pairs is not None:
        put = F.filter(marked, lambda p: p["value"].isNotNull())
        out = out.withColumn(pairs, F.array_distinct(F.transform(put, lambda p: F.struct(mask_token(p["category"], p["value"]).alias("token"), p["value"].alias("value")))))
    return out.withColumn(column, F.when(F.col(column).isNotNull(), rebuilt)).drop(marked)


def memory_estimate(stats: DataFrame, top: int = 3) -> DataFrame:
    """One row: values, bytes, memory_bytes, mean bytes of a value, and the
    share of all bytes that the ``top`` largest sources have."""
    largest = stats.orderBy(F.desc("bytes"), "source_path").limit(top).agg(F.sum("bytes").alias("top_bytes"))
    all_ = stats.agg(F.sum("values").alias("values"), F.sum("bytes").alias("bytes"))
    out = all_.crossJoin(F.broadcast(largest))
    return out.select("values", "bytes", (F.col("bytes") * 2 + F.col("values") * 48).alias("memory_bytes"), F.floor(F.col("bytes") / F.col("values")).alias("mean_bytes"), F.floor(F.lit(100) * F.col("top_bytes") / F.col("bytes")).alias("top_percent"))
