"""Importance resampling towards a target distribution by hashed n-grams.

All in built-in functions. Texts become arrays of n-grams, which are exploded
and hashed to buckets by crc32; counts of the buckets in the documents and in
the target give each bucket a gain, a table of at most MOST_BUCKETS rows that
is broadcast and joined to the exploded n-grams again. A document's weight is
the floored mean of its gains. Its score adds Gumbel noise from a hash of its
id, so the highest scores are a draw without replacement. For their ranks the
scores are sorted over all partitions, and each row's place in its partition
is added to the rows of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Fixed values of the query's contract.
N, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, "2024"
#: What stands between words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bound of the broadcast gain table (16 bytes a row).
MOST_BUCKETS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Row number in a partition, in an id of monotonically_increasing_id().
_IN_PARTITION = 33


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and what isn't ASCII, with A-Z lower-cased
    first; none for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # splitting takes half the time of extracting; it leaves an empty text at either end
    return F.coalesce(F.array_remove(F.split(lowered, APART), ""), F.array().cast("array<string>"))


def n_grams(own: Column, n: int) -> Column:
    """All runs of 1 to ``n`` words of an array, joined by one space."""
    of = lambda k: F.transform(F.when(F.size(own) >= k, F.sequence(F.lit(1), F.size(own) - (k - 1))), lambda i: F.array_join(F.slice(own, i, k), " "))
    runs = [of(k) for k in range(2, n + 1)]
    return F.concat(own, *[F.coalesce(r, F.array().cast("array<string>")) for r in runs]) if runs else own


def _exploded(df: DataFrame, n: int, buckets: int, *keep: str) -> DataFrame:
    """A row for each n-gram of ``df`` (words, ...) with its place (at) and
    bucket; one row with nulls where there is none."""
    rows = df.select(*keep, F.posexplode_outer(n_grams(F.col("words"), n)).alias("at", "gram"))
    return rows.select(*keep, "at", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gain_table(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): 1000 times the logarithm of how much more often the
    target than the documents has n-grams of the bucket, with one added to
    each count; floored. docs and target: (words)."""
    counts = [x.transform(_exploded, n, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(c)) for x, c in ((docs, "s"), (target, "t"))]
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = materialise(every.join(counts[0], "bucket", "left").join(counts[1], "bucket", "left").fillna(0), "buckets")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1).cast("double") * float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * float(all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with place, their position from 1 in ``order`` over all
    partitions; rows that ``order`` leaves equal have either's place."""
    at = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    at = at.withColumns({"part": F.shiftright("at", _IN_PARTITION), "place": F.col("at").bitwiseAND((1 << _IN_PARTITION) - 1) + 1}).drop("at")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    offsets = at.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return at.join(F.broadcast(offsets), "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def importance_resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``
    (doc_id, text) against ``target`` (text), all long.

    n_features: n-grams of 1 to ``n`` words, repeats counted. weight: floored
    mean of their gains, 0 without any. score: weight and the noise of the
    doc_id. rank: from 1 for the floor(percent * N / 100) highest scores among
    the N rows of at least ``min_words`` words, ties to the smaller doc_id;
    null for others.

    Null and empty texts have no words. A null doc_id has the noise of the
    text "null" and comes after all ids where scores tie. Rows that repeat a
    doc_id are rows of their own and share its noise; where all else ties too,
    their ranks go by fewer features, then by smaller weight, and rows that
    repeat the whole text take ranks in either order. Without documents the
    result is empty, without target the gains follow the documents alone.
    Other columns are ignored. More buckets than MOST_BUCKETS are an error.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(text).alias("words"))
    gains = gain_table(own.select("words"), target.select(words(text).alias("words")), n, buckets)
    # keyed by what a row holds, so a task that runs again gives the same rows;
    # rows that repeat id and text are counted and told apart by number
    rows = own.withColumn("n_words", F.size("words")).transform(_exploded, n, buckets, "doc_id", "text_hash", "n_words")
    sums = rows.join(F.broadcast(gains), "bucket", "left").groupBy("doc_id", "text_hash").agg(
        F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies"), F.max("n_words").alias("n_words"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum")
    )
    each = sums.select("doc_id", "n_words", F.expr("n div copies").alias("n_features"), F.expr("sum div copies").alias("sum"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    weight = F.expr("if(n_features = 0, 0, (sum - pmod(sum, n_features)) div n_features)").cast("long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = materialise(each.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    placed = ranked(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("copy"))
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank")
    columns = ("doc_id", "n_features", "weight", "score")
    return placed.select(*columns, rank).union(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))


RESAMPLE_ORACLE = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
tok AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, doc_id, unnest(w) AS w FROM tok),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, tbl[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM f), crc),
cnt AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 't') AS t FROM f JOIN hashed USING (w) GROUP BY bucket),
tot AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM cnt),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g FROM cnt, tot),
summed AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM f JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM documents d LEFT JOIN summed ON d.doc_id = summed.doc_id),
placed AS (
  SELECT doc_id, n_features, weight, weight + noise AS score,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
"""
