"""History and queue tables: idempotent writes, upserts, limits, backoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_writes(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return calls.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: the state after all upserts."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def write_status(incoming: DataFrame, stored: DataFrame, key: str, payload: str) -> DataFrame:
    """inserted, existing (an identical replay) or conflict for each row."""
    s = stored.select(F.col(key).alias("__k"), F.col(payload).alias("__p"), F.lit(True).alias("__there"))
    met = incoming.join(s, incoming[key] == F.col("__k"), "left")
    status = F.when(F.col("__there").isNull(), "inserted").when(F.col(payload).eqNullSafe(F.col("__p")), "existing").otherwise("conflict")
    return met.select(key, status.alias("status"))


def registered_tools(calls: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` unknown tools by first sight with their denials.

    calls: (tool, ts); names outside the alphabet are left out.
    """
    ok = calls.where(F.col("tool").rlike(r"^[A-Za-z0-9_.:-]{1,128}$"))
    seen = ok.groupBy("tool").agg(F.count("*").alias("denied_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return seen.orderBy("first_seen", "tool").limit(cap)


def rate_limited(attempts: DataFrame, per_minute: int = 5, per_hour: int = 20) -> DataFrame:
    """(event_id, in_minute, in_hour, allowed): attempts of the key in the
    window that ends with each, itself and denied ones included.

    A key's attempts are counted for each instant and dealt out by the hour,
    each hour with the one before it. A window's count is how many have come
    by its end less those before its start, two running sums of that part.
    """
    hour = 3600 * 1_000_000
    keyed = attempts.select("event_id", F.col("key").alias("__key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("__s"))
    counts = keyed.groupBy("__key", "__s").agg(F.count("*").alias("__n"))
    own = ((F.col("__s") - F.pmod(F.col("__s"), F.lit(hour))) / hour).cast("long")
    point = lambda part, at, n, what: F.struct(part.alias("part"), at.alias("at"), n.cast("long").alias("n"), F.lit(what).alias("what"))
    n, s, none = F.col("__n"), F.col("__s"), F.lit(0)
    # 0 and 1 ask what has come before a window, 2 is the instant, 3 the same for the next hour
    points = counts.select("__key", "__s", "__n", F.inline(F.array(point(own, s - 60 * 1_000_000, none, 0), point(own, s - hour, none, 1), point(own, s, n, 2), point(own + 1, s, n, 3))))
    so_far = F.sum("n").over(Window.partitionBy("__key", "part").orderBy("at", F.col("what") >= 2).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    of = lambda what: F.max(F.when(F.col("what") == what, F.col("so_far")))
    summed = points.withColumn("so_far", so_far).where("what < 3").groupBy("__key", "part", "__s").agg(of(2).alias("by"), of(0).alias("minute"), of(1).alias("hour"), F.max("__n").alias("__n"))
    # attempts without a time are one instant, with no other in their window
    within = lambda c: F.when(F.col("__s").isNull(), F.col("__n")).otherwise(F.col("by") - F.col(c))
    per = summed.select(F.col("__key").alias("__k"), F.col("__s").alias("__t"), within("minute").alias("in_minute"), within("hour").alias("in_hour"))
    out = keyed.join(per, F.col("__key").eqNullSafe(F.col("__k")) & F.col("__s").eqNullSafe(F.col("__t")))
    return out.select("event_id", "in_minute", "in_hour", ((F.col("in_minute") <= per_minute) & (F.col("in_hour") <= per_hour)).alias("allowed"))


def retry_delay(attempt: Column, base: int, cap: int, jitter: Column | float = 0.0) -> Column:
    """Seconds to wait after the n-th failure: doubled each time, capped."""
    jitter = F.lit(jitter) if isinstance(jitter, float) else jitter
    plain = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(20))), F.lit(float(cap)))
    return F.greatest(F.lit(1), F.round(plain * (1 + jitter)).cast("long")).cast("long")


def bounded_cleanup(rows: DataFrame, expires: str, now: str, limit: int, key: str) -> DataFrame:
    """What stays after the ``limit`` oldest expired rows are deleted."""
    gone = rows.where(F.col(expires) <= F.lit(now).cast("timestamp_ntz")).orderBy(expires, key).limit(limit).select(key)
    return rows.join(gone, key, "left_anti")


def patched(current: DataFrame, patch: DataFrame, key: str, columns: list[str], cleared: str | None = None) -> DataFrame:
    """Rows with the patch's values where it has any; ``cleared`` names a
    column of the patch, an array of the columns that become null."""
    empty = F.expr("cast(array() as array<string>)")
    p = patch.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns], F.coalesce(F.col(cleared), empty).alias("__null") if cleared else empty.alias("__null"))
    met = current.join(p, current[key] == F.col("__k"), "left")
    return met.select(key, *[F.when(~F.coalesce(F.array_contains("__null", c), F.lit(False)), F.coalesce(f"__{c}", current[c])).alias(c) for c in columns])


def valid_sessions(events: DataFrame, idle_s: int, absolute_s: int) -> DataFrame:
    """(event_id, session_no, valid) of a user's events (event_id, user_id,
    ts): a session ends when idle and at its absolute age."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lag(F.unix_seconds(F.col("ts").cast("timestamp"))).over(w)
    started = events.withColumn("__new", F.coalesce((gap > idle_s).cast("int"), F.lit(1)))
    numbered = started.withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id", "session_no"))
    return numbered.select("event_id", F.col("session_no").cast("long").alias("session_no"), (F.unix_seconds(F.col("ts").cast("timestamp")) - first <= absolute_s).alias("valid"))


#: Codes that a terminal record may have, by scope.
VERIFIED = ("ACTION_REQUIRED", "TOOL_PENDING_REVIEW", "MASK_TOKEN_INVALID", "SERVICE_NOT_READY", "SERVICE_WARMING_UP", "POLICY_INVALID", "RESULT_LIMIT_EXCEEDED", "MASKING_TIMEOUT", "MASKING_FAILED", "HISTORY_UNAVAILABLE")
UNVERIFIED = ("DATABASE_IDENTITY_UNVERIFIED", "SERVICE_NOT_READY")


def code_allowed(scope: Column, code: Column) -> Column:
    """Whether a terminal record of the scope may have the code."""
    return F.when(scope == "verified", code.isin(*VERIFIED)).otherwise(code.isin(*UNVERIFIED))
