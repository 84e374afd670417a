"""Token mappings: collection, resolution, eviction and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, mask_token


def mappings(values: DataFrame) -> DataFrame:
    """Distinct (database, token, category, value) of (database, category,
    value)."""
    return values.select("database", mask_token(F.col("category"), F.col("value"), F.col("database")).alias("token"), "category", "value").distinct()


def tokens_in(texts: DataFrame) -> DataFrame:
    """Distinct (doc_id, token) of (doc_id, text)."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1)))
    return texts.select("doc_id", F.explode(found).alias("token"))


#: Tokens that one text may have resolved.
MAX_RESOLVED = 1000


def resolve(texts: DataFrame, known: DataFrame, now: str | None = None, most: int = MAX_RESOLVED) -> DataFrame:
    """(doc_id, ok, text): texts with all their tokens replaced by values; a
    text with an unknown token, or more than ``most``, isn't ok and stays as
    it is. Where both have a database, tokens resolve in the text's own only;
    ``now`` leaves out entries (expires_at) that have expired. Needs one
    shuffle of the tokens, none of the mapping where it is small."""
    scoped = "database" in texts.columns and "database" in known.columns
    keys = ["token", "database"] if scoped else ["token"]
    if now is not None:
        known = known.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
    found = tokens_in(texts)
    if scoped:
        found = found.join(texts.select("doc_id", "database"), "doc_id")
    each = found.join(known.select(*keys, "value").distinct(), keys, "left")
    per = each.groupBy("doc_id").agg((F.bool_and(F.col("value").isNotNull()) & (F.count("*") <= most)).alias("ok"), F.collect_list(F.struct("token", "value")).alias("pairs"))
    out = texts.join(per, "doc_id", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    text = F.aggregate(F.coalesce("pairs", F.expr("cast(array() as array<struct<token:string,value:string>>)")), F.col("text"), lambda t, p: F.replace(t, p["token"], p["value"]))
    return out.select("doc_id", "ok", F.when(F.col("ok"), text).otherwise(F.col("text")).alias("text"))


def expanded(entries: DataFrame, passes: int = 8) -> DataFrame:
    """Entries (batch, token, value) with the tokens of their own batch in the
    values as values again, so one look-up gives the original."""
    ids = entries.select(F.struct("batch", "token").alias("doc_id"), "batch", F.col("value").alias("text"))
    return reveal(ids, entries.select("batch", "token", "value"), passes).select("doc_id.batch", "doc_id.token", F.col("text").alias("value"))


def published(store: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """The token store (database, token, value, batches, expires_at) after the
    entries ``new`` of a call: an entry that is there and hasn't expired gets
    the new batches too and the later expiry, an expired one is replaced."""
    live = store.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
    both = live.select("database", "token", "value", "batches", "expires_at").unionByName(new.select("database", "token", "value", "batches", "expires_at"))
    merged = both.groupBy("database", "token").agg(F.min("value").alias("value"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("batches")))).alias("batches"), F.max("expires_at").alias("expires_at"))
    untouched = store.where(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz")).join(new.select("database", "token"), ["database", "token"], "left_anti")
    return merged.unionByName(untouched.select(*merged.columns))


def admitted(entries: DataFrame, batch: str, limit: int) -> DataFrame:
    """Entries (database, token, batches, used) that stay when each database
    holds ``limit`` at most: those of ``batch`` first, then the most recently
    used, ties by token. A batch that alone is above the limit is refused as a
    whole: its entries go, the others compete for the places."""
    own = F.array_contains("batches", batch)
    n = F.count_if(own).over(Window.partitionBy("database"))
    kept = entries.withColumns({"__own": own, "__n": n}).where(~F.col("__own") | (F.col("__n") <= limit))
    w = Window.partitionBy("database").orderBy(F.col("__own").desc(), F.col("used").desc(), F.col("token").desc())
    return kept.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= limit).drop("__own", "__n", "__place")


def purged(state: DataFrame, database: str) -> DataFrame:
    """What is left of a state table without all rows of one database."""
    return state.where(~F.col("database").eqNullSafe(F.lit(database)))


def evicted(entries: DataFrame, limit: int) -> DataFrame:
    """The least recently used entries (database, token, used) above ``limit``
    of each database; ties go by token."""
    w = Window.partitionBy("database").orderBy(F.col("used").desc(), F.col("token").desc())
    return entries.withColumn("place", F.row_number().over(w)).where(F.col("place") > limit).select("database", "token", "used")


def expired(entries: DataFrame, now: str, limit: int) -> DataFrame:
    """The oldest ``limit`` entries (token, expires_at) that have expired."""
    return entries.where(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz")).orderBy("expires_at", "token").limit(limit)


def reveal(texts: DataFrame, known: DataFrame, passes: int = 8) -> DataFrame:
    """(doc_id, text) with tokens of the document's batch replaced, tokens in
    the values too, ``passes`` deep; tokens of other batches stay.

    texts: (doc_id, batch, text); known: (batch, token, value). Each pass cuts
    the texts at their tokens and joins these with the batch's own on equal
    keys, so a text meets its own tokens only, however many the batch has. Of
    several values of a token the least counts.
    """
    own = known.where("batch is not null and value is not null").groupBy(F.col("batch").alias("__batch"), F.col("token").alias("__token")).agg(F.min("value").alias("__value"))
    between = F.split("piece", TOKEN, -1)
    found = F.array_append(F.regexp_extract_all("piece", F.lit(f"({TOKEN})"), F.lit(1)), F.lit(""))
    cut = F.flatten(F.zip_with(between, found, lambda a, b: F.array(a, b)))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "batch", F.expr("cast(array() as array<int>)").alias("at"), F.col("text").alias("piece"))
    for _ in range(passes):
        each = rows.select("row", "doc_id", "batch", "at", F.posexplode_outer(cut).alias("i", "piece")).where("i is null or i = 0 or piece <> ''").withColumn("at", F.array_append("at", F.col("i")))
        # what is no token has a key of its own, so that it is dealt out evenly
        key = F.when(F.col("i") % 2 == 1, F.col("piece")).otherwise(F.xxhash64("row", "at").cast("string"))
        met = each.withColumn("key", key).join(own, (F.col("batch") == F.col("__batch")) & (F.col("key") == F.col("__token")), "left")
        rows = met.select("row", "doc_id", "batch", "at", F.coalesce("__value", "piece").alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.when(F.count("piece") > 0, whole).alias("text")).select("doc_id", "text")


def touched(entries: DataFrame, reads: DataFrame) -> DataFrame:
    """Entries (database, token, created) with ``used``: their last read
    (database, token, at), or their creation if that is later."""
    last = reads.groupBy("database", "token").agg(F.max("at").alias("__read"))
    return entries.join(last, ["database", "token"], "left").select("database", "token", F.greatest("created", "__read").alias("used"))
