"""Drafts, activation, snapshots, dry runs and what runs on a schedule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import canonical_json
from ..functions.setup import SCHEMA
from ..functions.text import REMOVED
from ..session import numbered, written
from . import governance, mapping, masking, rulediff
from .cascade import Policy
from .cascade import cascade as through
from .ledger import retry_delay

RULE = ("selector", "pattern", "action", "category", "priority")


# --- content of a version -----------------------------------------------------


def digest_of(rows: DataFrame, name: str = "content_hash") -> DataFrame:
    """One row, ``name``: a digest of all rows of a table, repeated ones
    included, that doesn't depend on their order; of no rows that of nothing.

    A tree of two levels: digests of rows are put in order and hashed within
    each of 4096 ranges, and the ranges' digests again, so no task holds more
    than a range's digests and equal hashes mean equal rows.
    """
    each = rows.select(F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in sorted(rows.columns)])), 256).alias("d"))
    ranges = each.groupBy(F.substring("d", 1, 3).alias("r")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    return ranges.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), ""), 256)).alias(name))


def rules_hash(rules: DataFrame) -> DataFrame:
    """One row, content_hash, of rules (RULE)."""
    return digest_of(rules.select(*RULE))


def content_hash(version: dict[str, DataFrame]) -> DataFrame:
    """One row, content_hash, of all that a version has: rules, sources, tools
    and whatever else, by name."""
    parts = [digest_of(df, "d").select(F.lit(name).alias("part"), "d") for name, df in sorted(version.items())]
    return digest_of(reduce(DataFrame.union, parts))


def change_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix`` and 16 hex digits of a digest of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256), 1, 16))


def compute_diff(before: dict[str, DataFrame], after: dict[str, DataFrame], manifest: DataFrame, known_tools: DataFrame) -> DataFrame:
    """(place, area, subject, change, class, id) of all differences between
    two versions and the warnings about the second, in one fixed order.

    Versions have rules (RULE), sources (source_path, allowed) and tools
    (tool, mode). Areas come in the order rules, dictionary, tools, warnings;
    in an area weakenings come first, then subjects in order. Rules are told
    apart, paired and absorbed by rulediff.rule_changes().
    """
    rules = rulediff.rule_changes(before["rules"], after["rules"]).select(F.lit(1).alias("n"), F.lit("rules").alias("area"), F.concat_ws(":", "selector", "subject").alias("subject"), F.col("kind").alias("change"), "class")
    sources = governance.source_diff(before["sources"], after["sources"]).select(F.lit(2).alias("n"), F.lit("dictionary").alias("area"), F.col("source_path").alias("subject"), "change", "class")
    tools = governance.tool_diff(before["tools"], after["tools"]).select(F.lit(3).alias("n"), F.lit("tools").alias("area"), F.col("tool").alias("subject"), F.concat_ws(">", "before", "after").alias("change"), "class")
    notes = governance.warnings(after["rules"], after["sources"].select("source_path"), after["tools"], manifest, known_tools).select(F.lit(4).alias("n"), F.lit("warnings").alias("area"), "subject", F.col("code").alias("change"), F.lit("warning").alias("class"))
    both = reduce(DataFrame.unionByName, (rules, sources, tools, notes)).withColumn("id", F.when(F.col("area") == "warnings", change_id("w_", "change", "subject")).otherwise(change_id("c_", "area", "subject", "change")))
    weak = F.when(F.col("class") == "weakening", 0).otherwise(1)
    return numbered(both.withColumn("__weak", weak), "place", "n", "__weak", "subject", "change").drop("n", "__weak")


# --- drafts and activation ----------------------------------------------------


def put_draft(versions: DataFrame, draft: DataFrame, expected: DataFrame) -> DataFrame:
    """(ok, version, selector, ...): the versions (version, status, RULE) after
    the draft's rules are replaced by ``draft`` (RULE), if the hash that the
    author has seen (``expected``: content_hash) is that of the present draft.

    Without a draft a new one gets the highest version and one; a hash of
    another content changes nothing and ok is false.
    """
    now = versions.where("status = 'draft'")
    met = rules_hash(now).withColumnRenamed("content_hash", "__now").crossJoin(expected.select(F.col("content_hash").alias("__seen")))
    number = versions.agg(F.coalesce(F.max(F.when(F.col("status") == "draft", F.col("version"))), F.max("version") + 1, F.lit(1)).alias("__v"))
    state = met.crossJoin(number).select((F.col("__now") == F.col("__seen")).alias("ok"), "__v")
    old = versions.crossJoin(F.broadcast(state)).where("not ok or status <> 'draft'").drop("__v")
    new = draft.crossJoin(F.broadcast(state)).where("ok").select(F.col("__v").cast("int").alias("version"), F.lit("draft").alias("status"), *RULE, "ok")
    return old.unionByName(new).select("ok", "version", "status", *RULE)


def activation(live: DataFrame, draft: DataFrame, seen: DataFrame, confirmed: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(problems, rules): what forbids that ``draft`` goes live, and the rules
    that go live if nothing does.

    seen: content_hash of the draft that was confirmed; confirmed: change_id
    of the weakenings that were; accepted: (selector, pattern) of the
    strengthenings that are taken over, others stay as they are. Problems:
    the draft has changed (CONTENT_CHANGED), confirmations missing or of
    changes that are gone, and secret rules among the result.
    """
    changes = governance.rule_diff(live, draft).withColumn("change_id", change_id("c_", "selector", "pattern", "change"))
    stale = rules_hash(draft).join(seen, "content_hash", "left_anti").select(F.lit("CONTENT_CHANGED").alias("problem"), F.col("content_hash").alias("subject"))
    open_ = governance.unconfirmed(changes.select("change_id", "class"), confirmed).select(F.concat(F.lit("CONFIRMATION_"), F.upper("problem")), "change_id")
    declined = changes.where("class = 'strengthening'").select("selector", "pattern").join(accepted, ["selector", "pattern"], "left_anti")
    rules = governance.activated(live.select(*RULE), draft.select(*RULE), declined)
    secret = rules.where("action = 'secret'").select(F.lit("SECRET_ACTIVATION_BLOCKED"), "pattern")
    return stale.union(open_).union(secret), rules


def swapped(current: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots (database, version, fingerprint, manifest_items, ready) after
    ``new`` ones (database, version, ready): the dictionary and the manifest
    are inherited, a database is ready only if it was; one without a snapshot
    gets one that isn't."""
    n = new.select("database", F.col("version").alias("__version"), F.col("ready").alias("__ready"), F.lit(True).alias("__new"))
    met = current.join(n, "database", "full_outer")
    ready = F.when(F.col("__new").isNull(), F.col("ready")).otherwise(F.coalesce("ready", F.lit(False)) & F.coalesce("__ready", F.lit(False)))
    return met.select("database", F.coalesce("__version", "version").alias("version"), "fingerprint", "manifest_items", ready.alias("ready"))


# --- dry runs -----------------------------------------------------------------


def dry_run(cells: DataFrame, known: DataFrame, evidence: DataFrame, live: Policy, candidate: Policy) -> DataFrame:
    """(doc_id, ptr, before, after, change, reason) of stored result cells
    (doc_id, ptr, field, value, and kind if they have it) under two whole
    policies, each with its own rules, dictionary and patterns.

    Tokens are resolved first (known: token, value); cells with a token that
    isn't known any more, and those from which a secret was removed when they
    were stored, are unevaluable. Every other cell goes through both cascades
    one after the other, and its status (secret, masked, open) is compared;
    tokens that the run makes are never stored. reason: the code of the first
    reason that the candidate gives.
    """
    kind = F.col("kind") if "kind" in cells.columns else F.lit("string")
    ids = cells.withColumn("__cell", F.struct("doc_id", "ptr"))
    plain = mapping.resolve(ids.select(F.col("__cell").alias("doc_id"), F.col("value").alias("text")), known)
    back = plain.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.ptr").alias("ptr"), "ok", "text")
    stored = F.coalesce(F.contains("value", F.lit(REMOVED)), F.lit(False))
    ready = cells.select("doc_id", "ptr", "field", kind.alias("kind"), stored.alias("gone")).join(back, ["doc_id", "ptr"]).withColumn("ok", F.col("ok") & ~F.col("gone")).drop("gone")
    # both cascades ask for their cells several times: these are tables
    ready = written(ready, "cells")
    usable = ready.where("ok").select("doc_id", "ptr", "field", "kind", F.col("text").alias("value"), F.struct("field", "kind", F.col("text").alias("value")).alias("__cell"))
    status = F.coalesce(masking.cell_status(F.col("value")), F.lit("open"))
    first = written(through(usable, evidence, live, ("__cell",)).select("doc_id", "ptr", "__cell.*", status.alias("before")), "first")
    both = through(first, evidence, candidate, ("before",)).select("doc_id", "ptr", "before", status.alias("after"), F.get("reasons", F.lit(0))["code"].alias("reason"))
    change = F.when(F.col("before") == F.col("after"), "same").when(F.col("after") == "open", "became_open").when(F.col("before") == "open", F.concat(F.lit("became_"), F.col("after"))).otherwise("changed")
    none = F.lit(None).cast("string")
    lost = ready.where("not ok").select("doc_id", "ptr", none.alias("before"), none.alias("after"), F.lit("unevaluable").alias("change"), none.alias("reason"))
    return both.select("doc_id", "ptr", "before", "after", change.alias("change"), "reason").unionByName(lost)


def dry_run_totals(grid: DataFrame) -> DataFrame:
    """One row: cells, became_masked, became_secret, became_open, changed and unevaluable."""
    count = lambda *what: F.count_if(F.col("change").isin(*what))
    return grid.agg(F.count("*").alias("cells"), count("became_masked").alias("became_masked"), count("became_secret").alias("became_secret"), count("became_open").alias("became_open"), count("changed").alias("changed"), count("unevaluable").alias("unevaluable"))


# --- sessions, queue, maintenance ---------------------------------------------


def live_sessions(sessions: DataFrame, users: DataFrame, now: str, idle_s: int = 1800, absolute_s: int = 28800) -> DataFrame:
    """(session_id, user_id, valid, until) of sessions (session_id, user_id,
    epoch, created, last_seen, revoked) of users (user_id, active, epoch): a
    session is valid if it isn't revoked, its user is active and of the same
    epoch, and neither the idle nor the absolute time is over; until is the
    earlier end."""
    u = users.select("user_id", "active", F.col("epoch").alias("__epoch"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    until = F.least(seconds("last_seen") + idle_s, seconds("created") + absolute_s)
    ok = ~F.col("revoked") & F.col("active") & (F.col("epoch") == F.col("__epoch")) & (until > F.unix_seconds(F.lit(now).cast("timestamp")))
    return sessions.join(u, "user_id").select("session_id", "user_id", ok.alias("valid"), until.alias("until"))


def user_capabilities(capabilities: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """(user_id, login, latest, open): of users (user_id, login) the last
    expiry of their activation capabilities (user_id, created, expires, used)
    and whether one can still be used."""
    usable = ~F.col("used") & (F.col("expires") > F.lit(now).cast("timestamp_ntz"))
    own = capabilities.join(users, "user_id")
    return own.groupBy("user_id", "login").agg(F.max("expires").alias("latest"), F.max("created").alias("last_created"), F.bool_or(usable).alias("open"))


def refresh_queue(outcomes: DataFrame, base_s: int = 30, cap_s: int = 3600, most: int = 8) -> DataFrame:
    """(database, attempts, state, next_attempt) after all outcomes (database,
    ts, seq, outcome) of refreshes, in order of ts and seq.

    A success empties the queue's entry, as does an invalid answer (state
    dropped); transient failures count up, with the next attempt after a
    doubled wait, until ``most`` of them need attention.
    """
    w = Window.partitionBy("database").orderBy("ts", "seq")
    closed = F.sum(F.when(F.col("outcome") != "transient", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = outcomes.withColumn("__run", closed)
    last = runs.groupBy("database", "__run").agg(F.count_if(F.col("outcome") == "transient").alias("attempts"), F.max("ts").alias("last"), F.max(F.when(F.col("outcome") != "transient", F.col("outcome"))).alias("opened"))
    newest = last.groupBy("database").agg(F.max_by(F.struct("attempts", "last", "opened"), "__run").alias("x")).select("database", "x.*")
    attempts = F.least(F.col("attempts"), F.lit(most)).cast("long")
    state = F.when(attempts >= most, "needs_attention").when(attempts > 0, "pending").when(F.col("opened") == "invalid", "dropped").otherwise("idle")
    wait = retry_delay(attempts, base_s, cap_s)
    return newest.select("database", attempts.alias("attempts"), state.alias("state"), F.when((attempts > 0) & (attempts < most), F.unix_seconds(F.col("last").cast("timestamp")) + wait).alias("next_attempt"))


def latest_manifests(manifests: DataFrame, most_items: int = 100_000, most_bytes: int = 8 << 20) -> DataFrame:
    """The newest manifest items (database, loaded, source_path, field_name,
    ...) of each database, but for databases whose newest manifest has too
    many items or bytes: they keep the newest one that hasn't."""
    size = F.octet_length("source_path") + F.octet_length("field_name")
    fits = manifests.groupBy("database", "loaded").agg(F.count("*").alias("n"), F.sum(size).alias("b")).where((F.col("n") <= most_items) & (F.col("b") <= most_bytes))
    newest = fits.groupBy("database").agg(F.max("loaded").alias("loaded"))
    return manifests.join(newest, ["database", "loaded"], "left_semi")


def maintained(tables: dict[str, tuple[DataFrame, str, str]], now: str, limits: dict[str, int]) -> DataFrame:
    """(name, key) of the rows that a maintenance run deletes: of each table
    (rows, expiry, key) the oldest expired ones up to its limit."""
    out = []
    for name, (rows, expires, key) in tables.items():
        gone = rows.where(F.col(expires) <= F.lit(now).cast("timestamp_ntz")).orderBy(expires, key).limit(limits[name])
        out.append(gone.select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key")))
    return reduce(DataFrame.union, out)


# --- setup files --------------------------------------------------------------


def exported(rules: DataFrame, sources: DataFrame, tools: DataFrame, reason: str = "exported") -> DataFrame:
    """One row, file: a policy's setup file as canonical JSON, without ids, with
    a placeholder for reasons. A policy is small by its own bounds."""
    part = lambda df, item, *order: df.agg(F.sort_array(F.collect_list(F.struct(*order, item.alias("__item")))).alias("x")).select(F.transform("x", lambda s: s["__item"]).alias("x"))
    why = F.lit(reason).alias("reason")
    r = part(rules, F.struct(*RULE[2:4], "priority", why, "selector", F.col("pattern").alias("value")), "selector", "pattern").withColumnRenamed("x", "rules")
    s = part(sources, F.struct("category", why, "source_path"), "source_path").withColumnRenamed("x", "sources")
    t = part(tools, F.struct("mode", why, "tool"), "tool").withColumnRenamed("x", "tools")
    return r.crossJoin(s).crossJoin(t).select(canonical_json(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), "rules", F.struct("sources").alias("dictionary"), "tools"))).alias("file"))


def imports(files: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """(name, sha256, accepted, problem) of setup files (name, body): whether
    each is a JSON object within the bound; its content is checked by
    functions.setup.problems on the driver."""
    value = F.try_parse_json("body")
    problem = F.when(F.octet_length("body") > most_bytes, "too large").when(value.isNull(), "not JSON").when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "not an object")
    return files.select("name", F.sha2("body", 256).alias("sha256"), problem.isNull().alias("accepted"), problem.alias("problem"))


def denials(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(call_id, tool, title, status): records of the calls (call_id, tool, ts,
    title) that preflight refuses, one a call with its first title: pending
    review of unknown tools, denied for those whose mode (tool, mode) says so."""
    w = Window.partitionBy("call_id").orderBy("ts", "title")
    first = calls.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    met = first.join(tools, "tool", "left").where("mode is null or mode = 'deny-pending-review'")
    return met.select("call_id", "tool", "title", F.when(F.col("mode").isNull(), "pending review").otherwise("denied").alias("status"))


def appended(journal: DataFrame, entries: DataFrame, key: str = "entry_id") -> DataFrame:
    """The journal with new entries; an entry that is there stays as it is, so
    a job that runs again adds nothing twice."""
    return journal.unionByName(entries.dropDuplicates([key]).join(journal.select(key), key, "left_anti").select(*journal.columns))


def revoke_events(grants: DataFrame, database: str, at: str) -> DataFrame:
    """(action, database, user_id, at): what the audit keeps of the grants
    (user_id, database) that go with a database, one for each user."""
    own = grants.where(F.col("database").eqNullSafe(F.lit(database))).select("database", "user_id").distinct()
    return own.select(F.lit("access.revoke").alias("action"), "database", "user_id", F.lit(at).cast("timestamp_ntz").alias("at"))


def cascade(tables: dict[str, DataFrame], database: str, audit: str = "audit", grants: str | None = None, at: str | None = None) -> dict[str, DataFrame]:
    """All tables without one database's rows; the audit table keeps its own,
    and gets revoke_events() of the table ``grants``, which go as well."""
    out = {name: df if name == audit else mapping.purged(df, database) for name, df in tables.items()}
    if grants is not None:
        out[audit] = out[audit].unionByName(revoke_events(tables[grants], database, at), allowMissingColumns=True)
    return out
