"""Writes with their outcome, scopes, sources and literals of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import DISPLAY_KEYS
from ..functions.text import REMOVED, compact_secret_name, cut_assignments, cut_secret_values, secret_name, wildcard_match
from .masking import is_person_field

#: Seconds that a record without a database is kept.
UNSCOPED_S = 86_400
MAX_SELECTORS, MAX_FOUND, MAX_REASONS, MAX_CANDIDATES = 100, 200, 256, 10_000


# --- writes -------------------------------------------------------------------


def history_insert(incoming: DataFrame, history: DataFrame, unscoped: DataFrame) -> DataFrame:
    """(call_id, database, status) of new records (call_id, database): conflict
    where the call is in the ledger of unscoped records or another database's
    history, existing where it is in its own, else inserted."""
    known = history.select("call_id", F.col("database").alias("__database")).groupBy("call_id").agg(F.collect_set("__database").alias("__in"))
    other = unscoped.select("call_id").distinct().withColumn("__unscoped", F.lit(True))
    met = incoming.join(known, "call_id", "left").join(other, "call_id", "left")
    own = F.size("__in") == 1
    status = F.when(F.col("__unscoped"), "conflict").when(F.col("__in").isNull(), "inserted").when(own & F.array_contains("__in", F.col("database")), "existing").otherwise("conflict")
    return met.select("call_id", "database", status.alias("status"))


def unscoped_insert(incoming: DataFrame, ledger: DataFrame, now: str) -> DataFrame:
    """(correlation, tool, code, status) of records without a database: those
    whose key is in the ledger (correlation, tool, code, at) since less than
    UNSCOPED_S are existing, the others inserted."""
    keys = ["correlation", "tool", "code"]
    fresh = ledger.where(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp")) < UNSCOPED_S).select(*keys).distinct().withColumn("__there", F.lit(True))
    return incoming.select(*keys).distinct().join(fresh, keys, "left").select(*keys, F.when(F.col("__there"), "existing").otherwise("inserted").alias("status"))


def tools_set(tools: DataFrame, changes: DataFrame) -> DataFrame:
    """Tools (tool, mode, auto_added, denied_count) after their modes are set
    by hand (tool, mode): counters stay, new ones start at 0."""
    c = changes.select("tool", F.col("mode").alias("__mode"))
    met = tools.join(c, "tool", "full_outer")
    return met.select("tool", F.coalesce("__mode", "mode").alias("mode"), (F.col("__mode").isNull() & F.col("auto_added")).alias("auto_added"), F.coalesce("denied_count", F.lit(0).cast("long")).alias("denied_count"))


def tools_denied(tools: DataFrame, calls: DataFrame, cap: int = 500) -> DataFrame:
    """Tools after denied calls (tool, ts): unknown tools are added, the first
    ``cap`` by first sight, counters of those still to be reviewed go up."""
    seen = calls.groupBy("tool").agg(F.count("*").alias("__n"), F.min("ts").alias("__first"))
    met = tools.join(seen, "tool", "left")
    known = met.select("tool", "mode", "auto_added", (F.col("denied_count") + F.when(F.col("mode") == "deny-pending-review", F.coalesce("__n", F.lit(0))).otherwise(0)).cast("long").alias("denied_count"))
    new = seen.join(tools, "tool", "left_anti").orderBy("__first", "tool").limit(cap)
    return known.unionByName(new.select("tool", F.lit("deny-pending-review").alias("mode"), F.lit(True).alias("auto_added"), F.col("__n").alias("denied_count")))


def intents_set(intents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Refresh intents (database, reason, attempts, state) after new ones
    (database, reason), which start again without attempts."""
    new = wanted.select("database", "reason", F.lit(0).cast("long").alias("attempts"), F.lit("pending").alias("state"))
    return intents.join(wanted.select("database"), "database", "left_anti").select(*new.columns).unionByName(new)


def call_contexts(writes: DataFrame, ttl_s: int, now: str) -> DataFrame:
    """(call_id, title, had_tokens) of contexts (call_id, at, title,
    had_tokens) that haven't expired: the first write of a call stays, its
    flag is set by any write."""
    first = writes.groupBy("call_id").agg(F.min_by("title", F.struct("at", "title")).alias("title"), F.min("at").alias("at"), F.bool_or("had_tokens").alias("had_tokens"))
    alive = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp")) < ttl_s
    return first.where(alive).select("call_id", "title", "had_tokens")


# --- scopes and sources -------------------------------------------------------


def visible(rows: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, rows' columns): what users (user_id, role) see of rows with a
    database: a super-admin all, others what is granted (user_id, database),
    without a grant nothing."""
    everything = users.where("role = 'super-admin'").select("user_id").crossJoin(rows)
    granted = users.where("role <> 'super-admin'").select("user_id").join(grants.distinct(), "user_id").join(rows, "database")
    return everything.select("user_id", *rows.columns).unionByName(granted.select("user_id", *rows.columns))


def listed_secrets(manifest: DataFrame) -> DataFrame:
    """(__path): lower-case paths of the manifest's items (source_path,
    field_name, password_mode) with a password or a secret name."""
    own = F.coalesce("password_mode", F.lit(False)) | secret_name(F.col("field_name")) | compact_secret_name(F.col("field_name"))
    return manifest.where(own).select(F.lower("source_path").alias("__path")).distinct()


def secret_sources(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_path, secret) of result sources (source_path, secret_cut): cut
    by the source, a secret name in the path, or the path of a manifest item
    (source_path, field_name, password_mode) with a password or a secret name."""
    listed = listed_secrets(manifest).withColumn("__listed", F.lit(True))
    met = sources.join(listed, F.lower("source_path") == F.col("__path"), "left")
    secret = F.coalesce("secret_cut", F.lit(False)) | secret_name(F.col("source_path")) | compact_secret_name(F.col("source_path")) | F.coalesce("__listed", F.lit(False))
    return met.select("source_path", secret.alias("secret"))


#: Fixed value: a path's last part that names persons as a whole.
FULL_NAME = "наименованиеполное"


def person_source(path: Column) -> Column:
    """Whether the last part of a path names persons."""
    last = F.element_at(F.split(path, r"\."), -1)
    return F.coalesce(is_person_field(last) | (F.lower(last) == FULL_NAME), F.lit(False))


def planned_selectors(mode: str, explicit: DataFrame, expandable: DataFrame, rules: DataFrame, most: int = MAX_SELECTORS) -> DataFrame:
    """(source_path, problem): what a pull asks for, in order. ``part``: the
    explicit sources; ``all``: the manifest's expandable ones (source_path)
    that a mask rule (selector, pattern, action) for paths matches. More than
    ``most`` of them are one row with a problem."""
    paths = explicit.select("source_path").distinct()
    if mode == "all":
        allow = rules.where("selector = 'source_path' and action = 'mask'").select("pattern").distinct()
        paths = expandable.select("source_path").distinct().join(allow, wildcard_match(F.col("pattern"), F.col("source_path")), "left_semi")
    counted = paths.agg(F.count("*").alias("__n"))
    fits = paths.crossJoin(F.broadcast(counted)).where(F.col("__n") <= most).select("source_path", F.lit(None).cast("string").alias("problem"))
    return fits.unionByName(counted.where(F.col("__n") > most).select(F.lit(None).cast("string").alias("source_path"), F.lit("too many sources").alias("problem"))).orderBy("source_path")


def found_metadata(manifest: DataFrame, text: str, most: int = MAX_FOUND) -> DataFrame:
    """(source_path, field_name, truncated): the first ``most`` items whose path
    or name contains ``text`` in any case, and whether there are more."""
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    top = manifest.where(has("source_path") | has("field_name")).select("source_path", "field_name").orderBy("source_path", "field_name").limit(most + 1)
    w = Window.orderBy("source_path", "field_name")
    placed = top.withColumns({"__place": F.row_number().over(w), "truncated": F.count("*").over(Window.partitionBy(F.lit(1))) > most})
    return placed.where(F.col("__place") <= most).drop("__place")


# --- literals -----------------------------------------------------------------


def cut_arguments(cells: DataFrame) -> DataFrame:
    """(doc_id, ptr, value) of call arguments (doc_id, ptr, field, value): values
    under secret names go whole, compact names too; in others the shapes of
    secrets and assignments to secret names go."""
    named = secret_name(F.col("field")) | compact_secret_name(F.col("field"))
    cut = F.when(F.col("value").isNotNull() & F.coalesce(named, F.lit(False)), REMOVED).otherwise(cut_assignments(cut_secret_values(F.col("value"))))
    return cells.select("doc_id", "ptr", cut.alias("value"))


def person_texts(cells: DataFrame) -> DataFrame:
    """(doc_id, texts, ok): persons' names of each document (cells: doc_id,
    field, json): strings under person fields and the display texts of
    objects; other arrays and objects there are an error."""
    value = F.try_parse_json("json")
    kind = F.schema_of_variant(value)
    shown = F.coalesce(*[F.try_variant_get(value, f"$['{k}']", "string") for k in DISPLAY_KEYS])
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("OBJECT"), shown)
    bad = kind.startswith("ARRAY") | (kind.startswith("OBJECT") & shown.isNull())
    own = cells.where(is_person_field(F.col("field"))).select("doc_id", text.alias("text"), F.coalesce(bad, F.lit(False)).alias("bad"))
    return own.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.nullif("text", F.lit("")))).alias("texts"), (~F.bool_or("bad")).alias("ok"))


def secret_texts(cells: DataFrame) -> DataFrame:
    """(doc_id, texts, ok): texts under secret fields (cells: doc_id, field,
    kind, value); a number or boolean there is an error."""
    own = cells.where(secret_name(F.col("field")) & (F.col("kind") != "null"))
    return own.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when((F.col("kind") == "string") & (F.col("value") != ""), F.col("value")))).alias("texts"), F.bool_and(F.col("kind") == "string").alias("ok"))


def recorded_reasons(reasons: DataFrame, most: int = MAX_REASONS) -> DataFrame:
    """(doc_id, ptr, reason, idx) of reasons (doc_id, pos, ptr, reason): the
    place of each reason in its document's table by first sight, null for
    those beyond ``most`` of them, which are counted but not listed."""
    first = reasons.groupBy("doc_id", "reason").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "reason")) - 1
    index = first.select("doc_id", "reason", F.when(place < most, place).alias("idx"))
    return reasons.select("doc_id", "ptr", "reason").distinct().join(index, ["doc_id", "reason"]).select("doc_id", "ptr", "reason", "idx")


def candidates_ok(candidates: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """(call_id, tokens, ok): distinct tokens of each call's candidates
    (call_id, token) and whether they are few enough."""
    return candidates.groupBy("call_id").agg(F.countDistinct("token").alias("tokens")).withColumn("ok", F.col("tokens") <= most)


def table_block(cells: DataFrame, schema: DataFrame) -> DataFrame:
    """(place, id, type, masked): columns of a report's table from its cells
    (row, field, kind, value) and the schema (pos, id): the schema's in its
    order, then others in order without regard to case. type: the one kind of
    its values, mixed, or null; masked: a value holds a token or a cut."""
    kinds = cells.groupBy(F.col("field").alias("id")).agg(F.collect_set(F.when(F.col("kind") != "null", F.col("kind"))).alias("k"), F.bool_or(F.coalesce(F.contains("value", F.lit("[MASK:v1:")) | F.contains("value", F.lit(REMOVED)), F.lit(False))).alias("masked"))
    met = schema.select("pos", "id").join(kinds, "id", "full_outer")
    kind = F.when(F.coalesce(F.size("k"), F.lit(0)) <= 0, "null").when(F.size("k") == 1, F.element_at("k", 1)).otherwise("mixed")
    place = F.row_number().over(Window.orderBy(F.col("pos").asc_nulls_last(), F.translate("id", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "id"))
    return met.select(place.alias("place"), "id", kind.alias("type"), F.coalesce("masked", F.lit(False)).alias("masked"))


def capped_detail(detail: DataFrame, most: int = 20_000) -> DataFrame:
    """(doc_id, reason, n, listed): cells of each reason of a document's detail
    (doc_id, row, col, reason), all counted, the first ``most`` cells listed."""
    cells = detail.distinct()
    placed = cells.withColumn("__place", F.row_number().over(Window.partitionBy("doc_id").orderBy("row", "col", "reason")))
    return placed.groupBy("doc_id", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("__place") <= most).alias("listed"))


def uuid_text(text: Column) -> Column:
    """A UUID in lower case with dashes, from text with or without dashes, in
    braces or as a URN; null for anything else."""
    bare = F.lower(F.regexp_replace(F.trim(text), r"(?i)^(?:urn:uuid:|\{)?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$", "$1-$2-$3-$4-$5"))
    return F.when(bare.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), bare)


def csv_line(columns: list[str]) -> Column:
    """A row as a CSV line: ``;`` between cells, quotes where a cell needs them."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[;"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat(F.concat_ws(";", *map(cell, columns)), F.lit("\r\n"))
