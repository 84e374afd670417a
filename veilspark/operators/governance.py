"""Versions of a policy: differences, confirmations and dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import action_rank


def rule_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(selector, pattern, change, class) between two sets of rules
    (selector, pattern, action, category, priority)."""
    keys = ["selector", "pattern"]
    b = before.select(*keys, F.col("action").alias("b_action"), F.col("category").alias("b_category"), F.col("priority").alias("b_priority"))
    a = after.select(*keys, F.col("action").alias("a_action"), F.col("category").alias("a_category"), F.col("priority").alias("a_priority"))
    met = b.join(a, keys, "full_outer")
    rb, ra = action_rank(F.col("b_action")), action_rank(F.col("a_action"))
    change = (
        F.when(F.col("b_action").isNull(), "added").when(F.col("a_action").isNull(), "removed").when(F.col("b_action") != F.col("a_action"), "action")
        .when(~F.col("b_category").eqNullSafe(F.col("a_category")), "category").when(F.col("b_priority") != F.col("a_priority"), "priority").otherwise("same")
    )
    # keeping a value open weakens a policy, whether the rule is new or not
    kind = (
        F.when(F.col("b_action").isNull(), F.when(F.col("a_action") == "keep", "weakening").otherwise("strengthening"))
        .when(F.col("a_action").isNull(), F.when(F.col("b_action") == "keep", "strengthening").otherwise("weakening"))
        .when(ra > rb, "strengthening").when(ra < rb, "weakening").otherwise("neutral")
    )
    return met.select(*keys, change.alias("change"), kind.alias("class")).where("change <> 'same'")


def source_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_path, change, class) of dictionary sources (source_path,
    allowed: array of values that the source is filtered to; null: all)."""
    b, a = before.select("source_path", F.col("allowed").alias("b"), F.lit(True).alias("in_b")), after.select("source_path", F.col("allowed").alias("a"), F.lit(True).alias("in_a"))
    met = b.join(a, "source_path", "full_outer")
    all_b, all_a = F.col("b").isNull(), F.col("a").isNull()
    more = all_a | (~all_b & (F.size(F.array_except("b", "a")) == 0))
    less = all_b | (~all_a & (F.size(F.array_except("a", "b")) == 0))
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(more & less, "same").when(more, "widened").when(less, "narrowed").otherwise("changed")
    out = met.select("source_path", change.alias("change")).where("change <> 'same'")
    return out.withColumn("class", F.when(F.col("change").isin("added", "widened"), "strengthening").otherwise("weakening"))


def tool_diff(live: DataFrame, wanted: DataFrame, imported: bool = False) -> DataFrame:
    """(tool, before, after, class) of (tool, mode); unknown tools are
    denied, and only what lifts masking or denial is a weakening. What comes
    from an imported file is all there is: tools that it doesn't name lose
    their entry (after is null), which weakens nothing."""
    rank = lambda c: F.when(c == "no-mask", 0).when(c == "data-mask", 1).otherwise(2)
    met = wanted.select("tool", F.col("mode").alias("after")).join(live.select("tool", F.col("mode").alias("before")), "tool", "left")
    met = met.withColumn("before", F.coalesce("before", F.lit("deny-pending-review"))).where("before <> after")
    kind = F.when(rank(F.col("after")) < rank(F.col("before")), "weakening").otherwise("strengthening")
    changed = met.select("tool", "before", "after", kind.alias("class"))
    if not imported:
        return changed
    gone = live.join(wanted.select("tool"), "tool", "left_anti")
    return changed.unionByName(gone.select("tool", F.col("mode").alias("before"), F.lit(None).cast("string").alias("after"), F.lit("neutral").alias("class")))


def unconfirmed(changes: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Weakenings that nobody confirmed, and confirmations of what is gone."""
    weak = changes.where("class = 'weakening'").select("change_id")
    missing = weak.join(confirmed, "change_id", "left_anti").withColumn("problem", F.lit("missing"))
    stale = confirmed.join(changes, "change_id", "left_anti").select("change_id").withColumn("problem", F.lit("stale"))
    return missing.unionByName(stale)


def grants_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, database, what): grants to revoke and to give."""
    revoke = current.join(wanted, ["user_id", "database"], "left_anti").withColumn("what", F.lit("revoke"))
    return revoke.unionByName(wanted.join(current, ["user_id", "database"], "left_anti").withColumn("what", F.lit("grant")))


def absorbed(removed: DataFrame, kept: DataFrame) -> DataFrame:
    """(selector, pattern, by): the strictest remaining rule that covers each
    removed one; null where it leaves a gap."""
    from ..functions.text import covers

    k = kept.select(F.col("selector").alias("k_selector"), F.col("pattern").alias("by"), action_rank(F.col("action")).alias("k_rank"))
    r = removed.select("selector", "pattern", action_rank(F.col("action")).alias("rank"))
    met = r.join(k, (F.col("selector") == F.col("k_selector")) & (F.col("k_rank") >= F.col("rank")) & covers(F.col("by"), F.col("pattern")), "left")
    return met.groupBy("selector", "pattern").agg(F.max_by("by", F.struct("k_rank", "by")).alias("by"))


def pair_changes(removed: list[dict], added: list[dict]) -> list[tuple[dict, dict, str]]:
    """Removed and added rules of one selector and action that are one rule
    widened or narrowed; each takes part in one pair, first come first served.

    Pairing is sequential by nature; both lists are a policy's few rules.
    """

    def covers_text(a: str, b: str) -> bool:
        if a in (b, "*"):
            return True
        part = lambda p: p[1:-1].lower() if len(p) > 2 and p[0] == p[-1] == "*" else None
        return part(a) is not None and b != "*" and part(a) in (part(b) or b.lower())

    out, taken = [], set()
    for r in removed:
        for k, a in enumerate(added):
            if k in taken or (r["selector"], r["action"]) != (a["selector"], a["action"]) or r["selector"] == "regex":
                continue
            how = "widened" if covers_text(a["pattern"], r["pattern"]) else "narrowed" if covers_text(r["pattern"], a["pattern"]) else None
            if how:
                taken.add(k)
                out.append((r, a, how))
                break
    return out


def activated(before: DataFrame, wanted: DataFrame, declined: DataFrame) -> DataFrame:
    """The rules (selector, pattern, action, category, priority) that go live:
    those of ``wanted``, but for the identities in ``declined`` (selector,
    pattern), which stay as they were ``before`` or don't appear."""
    keys = ["selector", "pattern"]
    no = declined.select(*keys).distinct()
    return wanted.join(no, keys, "left_anti").unionByName(before.join(no, keys, "left_semi"))


def rolled_back(versions: DataFrame, to: int) -> DataFrame:
    """The rows of version ``to`` as a new draft: (version, ...) one above the
    highest there is."""
    highest = versions.agg((F.max("version") + 1).alias("__next"))
    rows = versions.where(F.col("version") == to).crossJoin(F.broadcast(highest))
    return rows.withColumn("version", F.col("__next")).drop("__next")


#: Dictionary sources that a policy may have at most.
MAX_SOURCES = 100


def warnings(rules: DataFrame, sources: DataFrame, tools: DataFrame, manifest: DataFrame, known_tools: DataFrame, max_sources: int = MAX_SOURCES, hints: DataFrame | None = None, sizes: DataFrame | None = None, large: int = 100_000) -> DataFrame:
    """(code, subject) of what a policy's author should look at: paths that
    the manifest doesn't have (or that there is none, of which nothing else
    is said about paths), tools never seen, too many sources, secret rules,
    and regular expressions that keep (they have no effect). ``hints``:
    (expected, database), names of the database that differ are a mismatch;
    ``sizes``: (source_path, pulled, estimated) counts of values, of which the
    larger makes a source large from ``large`` on."""
    from .policy import missing_paths

    paths = missing_paths(rules, manifest).select(F.lit("PATH_NOT_IN_MANIFEST").alias("code"), F.col("pattern").alias("subject"))
    paths = paths.union(sources.join(manifest.select("source_path"), "source_path", "left_anti").select(F.lit("PATH_NOT_IN_MANIFEST"), "source_path")).distinct()
    unseen = tools.join(known_tools.select("tool"), "tool", "left_anti").select(F.lit("TOOL_NOT_SEEN"), "tool")
    many = sources.agg(F.count("*").alias("n")).where(F.col("n") > max_sources).select(F.lit("DICTIONARY_LIMIT"), F.col("n").cast("string"))
    secret = rules.where("action = 'secret'").select(F.lit("SECRET_ACTIVATION_BLOCKED"), "pattern")
    idle = rules.where("selector = 'regex' and action = 'keep'").select(F.lit("REGEX_KEEP_NO_EFFECT"), "pattern")
    none = manifest.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("MANIFEST_UNAVAILABLE"), F.lit(""))
    paths = paths.join(F.broadcast(manifest.limit(1).select(F.lit(True).alias("__any"))), F.lit(True), "left_semi")
    out = paths.union(none).union(unseen).union(many).union(secret).union(idle)
    if hints is not None:
        out = out.union(hints.where(~F.lower("expected").eqNullSafe(F.lower("database"))).select(F.lit("MISMATCH"), "expected"))
    if sizes is not None:
        out = out.union(sizes.where(F.greatest("pulled", "estimated") >= large).select(F.lit("SOURCE_LARGE"), "source_path"))
    return out
