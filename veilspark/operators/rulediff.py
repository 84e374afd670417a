"""What two versions of a policy's rules differ in, rule by rule.

Rules of one selector and pattern are one identity, whose strictest enabled
rule counts. Identities that are there before and after go through a table of
transitions; a removed and an added one of which one covers the other are one
rule that was widened or narrowed; a removed one that another covers, and a
kept one that was covered before, change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import action_rank
from ..session import shuffled, written
from .patterns import coverings

RULE = ("selector", "pattern", "action", "category", "priority")
#: Columns that rules may have besides, and what stands for those that haven't.
_MORE = {"enabled": "true", "reason": "cast(null as string)", "tests": "cast(null as string)"}
#: Kinds and classes of an action's change, none where a rule is missing.
TRANSITIONS = {
    ("none", "keep"): ("KEEP_ADDED", "weakening"), ("none", "mask"): ("MASK_ADDED", "strengthening"), ("none", "secret"): ("SECRET_ADDED", "strengthening"), ("mask", "none"): ("MASK_REMOVED", "weakening"),
    ("secret", "none"): ("SECRET_REMOVED", "weakening"), ("secret", "mask"): ("SECRET_TO_MASK", "weakening"), ("mask", "keep"): ("MASK_TO_KEEP", "weakening"), ("secret", "keep"): ("SECRET_TO_KEEP", "weakening"),
    ("mask", "secret"): ("MASK_TO_SECRET", "strengthening"), ("keep", "none"): ("KEEP_REMOVED", "strengthening"), ("keep", "mask"): ("KEEP_TO_MASK", "strengthening"), ("keep", "secret"): ("KEEP_TO_SECRET", "strengthening"),
}


def rule_key(selector: Column, pattern: Column) -> Column:
    """What tells rules apart: regular expressions as they are, others in any case."""
    return F.when(selector == "regex", pattern).otherwise(F.lower(pattern))


def effective(rules: DataFrame) -> DataFrame:
    """(selector, key, pattern, action, category, priority, enabled, reason,
    tests): of each identity its strictest enabled rule, of equally strict ones
    that of the highest priority; of one without enabled rules any, disabled."""
    own = rules.select(*RULE, *[F.col(c) if c in rules.columns else F.expr(e).alias(c) for c, e in _MORE.items()]).withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    w = Window.partitionBy("selector", "key").orderBy(F.desc("enabled"), action_rank(F.col("action")).desc(), F.desc("priority"), "pattern", "category")
    return own.withColumn("key", rule_key(F.col("selector"), F.col("pattern"))).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def paired(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(r_key, a_key, selector, action, widened) one to one: each removed rule
    (selector, key, pattern, action), in order, with the first added one of
    the same selector and action that strictly covers it or that it covers.

    All candidates are found by coverings(). Then the pairs go that are each
    other's first choice, with all other candidates of both, and so on until
    none are left, which gives what going through the rules in order gives.
    """
    keys = ("selector", "action")
    r, a = removed.where("selector <> 'regex'"), added.where("selector <> 'regex'")
    side = lambda df, prefix, column: df.select(*keys, F.col("key").alias(f"{prefix}_key"), F.col("pattern").alias(column))
    wider = coverings(side(a, "a", "pattern"), side(r, "r", "narrow"), *keys).select(*keys, "r_key", "a_key", F.lit(True).alias("widened"))
    narrower = coverings(side(r, "r", "pattern"), side(a, "a", "narrow"), *keys).select(*keys, "r_key", "a_key", F.lit(False).alias("widened"))
    open_ = written(wider.unionByName(narrower).groupBy(*keys, "r_key", "a_key").agg(F.max("widened").alias("widened"), F.count("*").alias("ways")).where("ways = 1").drop("ways"), "candidates")
    out = None
    while open_.limit(1).count():
        first = lambda of, by: F.row_number().over(Window.partitionBy(*keys, of).orderBy(F.col(by).cast("binary")))
        chosen = written(open_.withColumns({"__r": first("r_key", "a_key"), "__a": first("a_key", "r_key")}).where("__r = 1 and __a = 1").drop("__r", "__a"), "pairs")
        out = chosen if out is None else out.unionByName(chosen)
        open_ = written(open_.join(shuffled(chosen.select(*keys, "r_key")), [*keys, "r_key"], "left_anti").join(shuffled(chosen.select(*keys, "a_key")), [*keys, "a_key"], "left_anti"), "candidates")
    return open_ if out is None else out


def _transition(before: Column, after: Column, at: int) -> Column:
    out = F.lit(None).cast("string")
    for (b, a), what in TRANSITIONS.items():
        out = F.when((before == b) & (after == a), what[at]).otherwise(out)
    return out


def rule_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(selector, subject, kind, class, b_pattern, a_pattern) between two sets
    of rules (RULE, and enabled, reason, tests where they have them).

    subject: the key of the rule there is afterwards, or of the one that is
    gone, or of the one that covers it. Regular expressions that keep have no
    effect, so their changes are neutral (REGEX_KEEP).
    """
    b, a = (effective(df) for df in (before, after))
    named = lambda df, p: df.select("selector", "key", *[F.col(c).alias(f"{p}_{c}") for c in ("pattern", "action", "category", "priority", "enabled", "reason", "tests")])
    met = written(named(b, "b").join(shuffled(named(a, "a")), ["selector", "key"], "full_outer"), "identities")
    on = lambda p: F.when(F.coalesce(F.col(f"{p}_enabled"), F.lit(False)), F.col(f"{p}_action")).otherwise("none")
    met = met.withColumns({"b": on("b"), "a": on("a")})
    same = lambda c: F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    both = F.col("b_pattern").isNotNull() & F.col("a_pattern").isNotNull()
    detail = F.when(F.col("selector").isin("regex"), F.when(~same("tests"), "TESTS_CHANGED").when(~same("reason") | ~same("category") | ~same("priority") | ~same("enabled"), "REASON_CHANGED")).otherwise(
        F.when((F.col("a") != "none") & ~same("category") & (F.col("selector") != "dictionary"), "CATEGORY_CHANGED").when((F.col("a") != "none") & ~same("priority"), "PRIORITY_CHANGED").when(~same("reason") | ~same("tests") | ~same("pattern") | ((F.col("a") == "none") & ~(same("category") & same("priority") & same("action"))), "REASON_CHANGED")
    )
    regex = F.col("selector") == "regex"
    keeps = regex & ((F.col("b") == "keep") | (F.col("a") == "keep"))
    kind = (
        F.when(keeps, F.when((F.col("b") != F.col("a")) | (both & detail.isNotNull()), "REGEX_KEEP")).when(regex & (F.col("a") == "none") & (F.col("b") != "none"), "REGEX_REMOVED")
        .when(F.col("b") != F.col("a"), _transition(F.col("b"), F.col("a"), 0)).when(both, detail)
    )
    class_ = F.when(keeps | (F.col("b") == F.col("a")), "neutral").otherwise(_transition(F.col("b"), F.col("a"), 1))
    alone = ~regex & ((F.col("b") == "none") != (F.col("a") == "none"))
    single = met.where(~alone).select("selector", F.col("key").alias("subject"), kind.alias("kind"), class_.alias("class"), "b_pattern", "a_pattern").where("kind is not null")

    side = lambda df, p: df.select("selector", "key", F.col(f"{p}_pattern").alias("pattern"), F.col(p).alias("action"))
    removed, added = side(met.where(alone & (F.col("a") == "none")), "b"), side(met.where(alone & (F.col("b") == "none")), "a")
    pairs = paired(removed, added)
    named_pairs = pairs.join(shuffled(removed.select("selector", "action", F.col("key").alias("r_key"), F.col("pattern").alias("b_pattern"))), ["selector", "action", "r_key"]).join(shuffled(added.select("selector", "action", F.col("key").alias("a_key"), F.col("pattern").alias("a_pattern"))), ["selector", "action", "a_key"])
    keep = F.col("action") == "keep"
    kind = F.concat(F.when(keep, "KEEP_").otherwise("PATTERN_"), F.when(F.col("widened"), "WIDENED").otherwise("NARROWED"))
    changed = named_pairs.select("selector", F.col("a_key").alias("subject"), kind.alias("kind"), F.when(keep == F.col("widened"), "weakening").otherwise("strengthening").alias("class"), "b_pattern", "a_pattern")

    gone = written(removed.join(shuffled(pairs.select("selector", F.col("r_key").alias("key"))), ["selector", "key"], "left_anti"), "gone")
    new = written(added.join(shuffled(pairs.select("selector", F.col("a_key").alias("key"))), ["selector", "key"], "left_anti"), "new")
    # from the identities, which are a table, not from the rules once more
    live = lambda p: met.where(F.col(f"{p}_enabled") & ~regex).select("selector", "key", *[F.col(f"{p}_{c}").alias(c) for c in ("pattern", "action", "priority")])
    rank = lambda c: action_rank(F.col(c))
    over = coverings(live("a").select("selector", "pattern", F.col("key").alias("by"), F.col("action").alias("by_action"), "priority"), gone.where("action <> 'keep'").select("selector", "key", F.col("pattern").alias("narrow"), "action"), "selector").where(rank("by_action") >= rank("action"))
    absorbed = over.groupBy("selector", "key").agg(F.max_by(F.struct("by", "pattern"), F.struct(rank("by_action"), "priority", "by")).alias("x"))
    under = coverings(live("b").where("action = 'keep'").select("selector", "pattern", F.col("key").alias("by")), new.where("action = 'keep'").select("selector", "key", F.col("pattern").alias("narrow")), "selector")
    known = under.groupBy("selector", "key").agg(F.min(F.struct("by", "pattern")).alias("x"))
    none = F.lit("none")
    was = gone.join(shuffled(absorbed), ["selector", "key"], "left").select("selector", F.coalesce("x.by", "key").alias("subject"), F.when(F.col("x").isNotNull(), "PATTERN_REPLACED").otherwise(_transition(F.col("action"), none, 0)).alias("kind"), F.when(F.col("x").isNotNull(), "neutral").otherwise(_transition(F.col("action"), none, 1)).alias("class"), F.col("pattern").alias("b_pattern"), F.col("x.pattern").alias("a_pattern"))
    is_ = new.join(shuffled(known), ["selector", "key"], "left").select("selector", F.coalesce("x.by", "key").alias("subject"), F.when(F.col("x").isNotNull(), "PATTERN_REPLACED").otherwise(_transition(none, F.col("action"), 0)).alias("kind"), F.when(F.col("x").isNotNull(), "neutral").otherwise(_transition(none, F.col("action"), 1)).alias("class"), F.col("x.pattern").alias("b_pattern"), F.col("pattern").alias("a_pattern"))
    return single.unionByName(changed).unionByName(was).unionByName(is_)
