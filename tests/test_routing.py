"""Dictionaries in shards give what one automaton of all values gives."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import dictionary, routing


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_shards_equal_one_automaton(spark, shard_bytes):
    rng = random.Random(shard_bytes)
    word = lambda n: "".join(rng.choice("abcÄ ") for _ in range(n))
    values = {word(rng.randrange(1, 9)): f"K{i % 3}" for i in range(150)}
    texts = [(i, word(rng.randrange(0, 120))) for i in range(80)] + [(100, None), (101, ""), (102, "x😀" + max(values, key=len) + "😀")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([*values.items(), ("", "E"), (None, "N")], "value string, category string")
    found = sorted((r.doc_id, r.value, r.category) for r in routing.matches(df, known, shard_bytes).select("doc_id", "value", "category").distinct().collect())
    assert found == sorted((r.doc_id, r.value, r.category) for r in dictionary.hits(df.where("text is not null"), known).collect())
    expected = {r.doc_id: r.text for r in dictionary.replace_values(df, values, native=0).collect()}
    assert {r.doc_id: r.text for r in routing.replace_values(df, known, shard_bytes).collect()} == expected
    at = routing.matches(df, known, shard_bytes).join(df, "doc_id").where(F.substring("text", F.col("start") + 1, F.col("length")) != F.col("value"))
    assert at.count() == 0


def test_nothing_known(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "value string, category string")
    assert routing.matches(df, none).collect() == [] and routing.replace_values(df, none).collect() == df.collect()


def test_texts_visit_few_shards(spark):
    known = spark.range(2000).select(F.concat(F.lit("value-"), F.sha2(F.col("id").cast("string"), 256)).alias("value"), F.lit("K").alias("category"))
    texts = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("no value here, but value-"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    assert sorted(r.doc_id for r in routing.matches(texts, known, 4096).collect()) == list(range(50))
