"""Importance resampling against plain Python, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm.resampling import gain_table, importance_resample, ranked, words


def _grams(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(own[i : i + k]) for k in range(1, n + 1) for i in range(len(own) - k + 1)], len(own)


def _plain(docs, target, n, buckets, percent, least, seed="2024"):
    s, t = Counter(), Counter()
    for rows, c in ((docs, s), (target, t)):
        for _, text in rows:
            c.update(zlib.crc32(g.encode()) % buckets for g in _grams(text, n)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (big_t * 0.0 + big_s + buckets)) / ((s[b] + 1) * float(big_t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in docs:
        grams, m = _grams(text, n)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), m])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k for k, r in enumerate(able, 1) if k <= percent * len(able) // 100}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize(("n", "buckets", "percent", "least"), [(1, 50, 40, 3), (2, 97, 100, 1), (3, 10_000, 25, 0)])
def test_rows_equal_plain_python(spark, n, buckets, percent, least):
    rng = random.Random(n)
    some = ["Wort", "wort", "ÉTÉ", "été", "42", "don't", "数据", "a_b", "x" * 50, "-", "\t"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(12)))) for i in range(60)]
    docs += [(None, None), (None, ""), (7, "again wort wort wort"), (7, "again wort wort wort"), (7, "wort"), (100, "w " * 5000), (None, "null id and some words")]
    target = [(i, "wort été 42 data") for i in range(3)] + [(9, None)]
    df = spark.createDataFrame([(i, t, 1, "r", 2.0) for i, t in docs], "doc_id long, text string, rank int, weight string, gain double").repartition(5)
    other = spark.createDataFrame(target, "item_id long, text string")
    rows = importance_resample(df, other, n, buckets, percent, least).collect()
    assert Counter(tuple(r) for r in rows) == _plain(docs, target, n, buckets, percent, least)


def test_words_leave_other_capitals_and_keep_what_is_no_ascii(spark):
    df = spark.createDataFrame([("AbÉ-ß_Ünï 3.5\u00a0x",), ("PLAIN Text",), (None,)], "text string")
    assert [r[0] for r in df.select(words(F.col("text"))).collect()] == [["abÉ", "ß", "Ünï", "3", "5\u00a0x"], ["plain", "text"], []]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b")], "doc_id long, text string")
    none = docs.limit(0)
    assert importance_resample(none, docs).collect() == []
    assert {(r.doc_id, r.rank) for r in importance_resample(docs, none, min_words=1, percent=50).collect()} in ({(1, 1), (2, None)}, {(1, None), (2, 1)})


def test_ranks_run_on_over_partitions(spark):
    rows = ranked(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit(1).alias("same")), F.desc("same"), F.asc("x"))
    assert all(r.place == r.x + 1 for r in rows.collect())


def test_buckets_are_bounded(spark):
    with pytest.raises(ValueError, match="buckets"):
        importance_resample(spark.range(1).selectExpr("id doc_id", "'a' text"), spark.range(1).selectExpr("'a' text"), buckets=1 << 21)


def test_one_word_in_every_text(spark):
    """A third of all n-grams in one bucket: sums are made before rows move."""
    docs = spark.range(300).selectExpr("id doc_id", "concat('same same same w', id) text")
    gains = gain_table(docs.select(words(F.col("text")).alias("words")), docs.limit(1).select(words(F.col("text")).alias("words")), 1, 100)
    assert gains.count() == 100
    assert importance_resample(docs, docs, min_words=1).where("rank is not null").count() == 30
