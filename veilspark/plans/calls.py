"""Queries over calls: envelopes, pages, results and their records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import governance, ledger, mapping, report
from ..sources import pages
from .masking import token_sql
from .registry import inline, over, query, table, values

_BODIES = over("orders", "o_orderkey", "id, body", [(1, '{"structured_content":{"success":true,"a":1},"content":[{"type":"text","text":"{}"}]}'), (2, '{"content":[{"type":"text","text":"{^"success^":false}"}]}'), (3, '{"success":true}'), (4, '{"content":[{"type":"json","json":{"success":true}}]}'), (5, "{bad")], id="o_orderkey")
#: A circumflex stands for the backslash, which the engines' literals read differently.
_ENVELOPES = f"(SELECT id, replace(body, '^', chr(92)) AS body FROM {_BODIES})"


@query(f"""
SELECT id, CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.structured_content.success'), json_extract_string(body, '$.content[0].json.success'), json_extract_string(json_extract_string(body, '$.content[0].text'), '$.success'), json_extract_string(body, '$.success')) END AS success FROM {_ENVELOPES}
""")
def envelope_unwrap(spark, sf_dir):
    get = lambda p: F.get_json_object("body", p)
    inner = F.get_json_object(get("$.content[0].text"), "$.success")
    return inline(spark, _ENVELOPES, sf_dir).select("id", F.coalesce(get("$.structured_content.success"), get("$.content[0].json.success"), inner, get("$.success")).alias("success"))


_PAGES = values("selector, page, success, next_cursor, final_chunk", [("*", 1, True, "c1", False), ("*", 2, True, None, True), ("a", 1, True, "c", True), ("b", 1, True, None, False), ("c", 1, False, None, True)])


@query(f"SELECT selector, count(*) AS pages, bool_and(success AND ((next_cursor IS NOT NULL) <> final_chunk)) AND count(*) FILTER (WHERE final_chunk) = 1 AS complete FROM {_PAGES} GROUP BY 1")
def feed_page_protocol(spark, sf_dir):
    return pages.complete_pulls(inline(spark, _PAGES))


_CODES = over("orders", "o_orderkey", "scope, code", [(s, c) for s in ("verified", "unverified") for c in ("ACTION_REQUIRED", "SERVICE_NOT_READY", "DATABASE_IDENTITY_UNVERIFIED", "OTHER", "MASKING_FAILED")])


@query(f"SELECT scope, code, CASE scope WHEN 'verified' THEN code IN {ledger.VERIFIED} ELSE code IN {ledger.UNVERIFIED} END AS allowed FROM {_CODES}")
def terminal_codes(spark, sf_dir):
    return inline(spark, _CODES, sf_dir).select("scope", "code", ledger.code_allowed(F.col("scope"), F.col("code")).alias("allowed"))


_RAW = over("customer", "c_custkey", "raw", [("Client name",), ("имя",), ("",), ("a" * 40,), ("x-1_y",)], raw="v.raw || c_mktsegment")


@query(f"SELECT raw, coalesce(nullif(left(upper(regexp_replace(raw, '[^A-Za-z0-9_]', '', 'g')), 32), ''), 'DATA') AS category FROM {_RAW}")
def category_names(spark, sf_dir):
    return inline(spark, _RAW, sf_dir).select("raw", X.category(F.col("raw")).alias("category"))


@query("SELECT event_id, '/' || replace(replace(event_type || '~/' || user_id::VARCHAR, '~', '~0'), '/', '~1') AS ptr FROM events")
def pointer_escape(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/"), X.pointer_escape(F.concat("event_type", F.lit("~/"), F.col("user_id").cast("string")))).alias("ptr"))


_IDS = over("customer", "c_custkey", "id", [("ras:1",), ("gen:2",), ("other",), ("550e8400-e29b-41d4-a716-446655440000",), ("",)])


@query(f"SELECT id, CASE WHEN starts_with(id, 'ras:') THEN 'ras' WHEN starts_with(id, 'gen:') THEN 'generated' END AS source, regexp_full_match(id, '[A-Za-z0-9_.:-]{{1,128}}') AS valid, regexp_full_match(id, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') AS is_uuid FROM {_IDS}")
def identifier_checks(spark, sf_dir):
    c = F.col("id")
    return inline(spark, _IDS, sf_dir).select("id", F.when(c.startswith("ras:"), "ras").when(c.startswith("gen:"), "generated").alias("source"), c.rlike(r"^[A-Za-z0-9_.:-]{1,128}$").alias("valid"), c.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("is_uuid"))


@query("SELECT c_nationkey, count(*) AS n, CASE WHEN count(*) * 1000 >= 1000000 THEN '~' || round(count(*) / 1000.0, 1)::DOUBLE::VARCHAR || ' mln' WHEN count(*) * 1000 >= 1000 THEN '~' || count(*)::VARCHAR || ' k' ELSE '~0' END AS label FROM customer GROUP BY 1")
def count_labels(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.select("c_nationkey", "n", report.count_label(F.col("n") * 1000).alias("label"))


@query("SELECT user_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 THEN 'active' ELSE 'failed' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE event_type = 'purchase'")
def generation_commit(spark, sf_dir):
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id")
    state = F.when(F.row_number().over(w.orderBy(F.desc("event_id"))) == 1, "active").otherwise("failed")
    return e.select("*", state.alias("state"), F.row_number().over(w.orderBy("event_id")).cast("long").alias("version"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE 'result withheld' END AS text, CASE WHEN role = 'user' THEN '' ELSE 'failure' END AS reason FROM conversations")
def neutral_failure(spark, sf_dir):
    ok = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(ok, F.col("text")).otherwise("result withheld").alias("text"), F.when(ok, "").otherwise("failure").alias("reason"))


@query("SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'none' ELSE 'returned' END AS audit FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def history_with_audit(spark, sf_dir):
    audit = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    met = table(spark, sf_dir, "orders").join(audit, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderstatus") == "F"), "left")
    return met.select("o_orderkey", F.when(F.col("l_orderkey").isNull(), "none").otherwise("returned").alias("audit"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'from ' || s_name || ' via ' || s_name ELSE 'token of another batch' END AS text FROM supplier")
def batch_reveal(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("batch", F.col("s_suppkey") % 2)
    inner = X.mask_token(F.lit("NAME"), F.col("s_name"))
    outer = X.mask_token(F.lit("PATH"), F.concat(F.lit("via "), inner))
    known = s.where("batch = 0").select("batch", F.explode(F.array(F.struct(inner.alias("token"), F.col("s_name").alias("value")), F.struct(outer.alias("token"), F.concat(F.lit("via "), inner).alias("value")))).alias("p")).select("batch", "p.token", "p.value")
    texts = s.select(F.col("s_suppkey").alias("doc_id"), "batch", F.concat(F.lit("from "), inner, F.lit(" "), outer).alias("text"))
    out = mapping.reveal(texts, known, 3).withColumnRenamed("doc_id", "s_suppkey")
    return out.select("s_suppkey", F.when(F.col("text").rlike(X.TOKEN), "token of another batch").otherwise(F.col("text")).alias("text"))


_REMOVED = values("selector, pattern, action", [("name", "client_name", "mask"), ("name", "x", "mask"), ("type", "*", "keep"), ("name", "secret_name", "secret")])
_KEPT = values("selector, pattern, action", [("name", "*name*", "mask"), ("name", "*client*", "secret"), ("source_path", "*", "mask")])


@query("SELECT * FROM (VALUES ('name', 'client_name', '*client*'), ('name', 'x', NULL), ('type', '*', NULL), ('name', 'secret_name', NULL)) AS v(selector, pattern, \"by\")")
def rule_absorption(spark, sf_dir):
    return governance.absorbed(inline(spark, _REMOVED), inline(spark, _KEPT))


_SCHEMA = values("pos, id", [(1, "b"), (2, "a")])
_ROWKEYS = values("id", [("a",), ("Z",), ("c",), ("b",), ("D",), ("c",)])


@query("SELECT * FROM (VALUES ('b', 1), ('a', 2), ('c', 3), ('D', 4), ('Z', 5)) AS v(id, place)")
def report_column_order(spark, sf_dir):
    return report.report_columns(inline(spark, _SCHEMA), inline(spark, _ROWKEYS))


_CELLTYPES = over("orders", "o_orderkey", "id, sourceless, cell", [(1, "count", "5"), (2, "count", '"5"'), (3, "literal", '"x"'), (4, "literal", "[1]"), (5, "value", '{"_objectRef":true,"presentation":"A"}'), (6, "literal", '{"_objectRef":true}'), (7, "composite", '{"a":1}'), (8, "parameter", "null")], id="o_orderkey")


@query(f"""
SELECT id, CASE sourceless WHEN 'count' THEN json_type(cell) IN ('UBIGINT', 'BIGINT', 'DOUBLE') ELSE json_type(cell) NOT IN ('ARRAY', 'OBJECT') OR (sourceless IN ('value', 'composite') AND coalesce(json_extract_string(cell, '$._objectRef') = 'true', FALSE)) END AS ok FROM {_CELLTYPES}
""")
def sourceless_cells(spark, sf_dir):
    first = F.substring("cell", 1, 1)
    container = first.isin("[", "{")
    ref = F.coalesce(F.get_json_object("cell", "$._objectRef") == "true", F.lit(False))
    ok = F.when(F.col("sourceless") == "count", F.col("cell").rlike(r"^-?\d")).otherwise(~container | (F.col("sourceless").isin("value", "composite") & ref))
    return inline(spark, _CELLTYPES, sf_dir).select("id", ok.alias("ok"))


@query(f"SELECT event_id, {token_sql(chr(39) + 'UNVERIFIED_NUMBER' + chr(39), 'event_id::VARCHAR')} AS token FROM events")
def unverified_columns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.mask_token(F.lit("UNVERIFIED_NUMBER"), F.col("event_id").cast("string")).alias("token"))


@query("SELECT event_id, ts + least(3600, 600 + user_id % 5 * 1000)::INT * INTERVAL 1 SECOND AS expires_at FROM events")
def effective_lifetime(spark, sf_dir):
    life = F.least(F.lit(3600), 600 + F.col("user_id") % 5 * 1000)
    return table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.make_dt_interval(secs=life.cast("decimal(18,6)"))).alias("expires_at"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) > 9000")
def mapping_global_eviction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    keep = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(9000).select("event_id")
    return e.join(keep, "event_id", "left_anti").select("event_id")


@query("SELECT conv_id, min(turn) AS first_turn, bool_or(contains(text, 'token')) AS had_tokens FROM conversations GROUP BY 1")
def call_contexts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.bool_or(F.contains("text", F.lit("token"))).alias("had_tokens"))


@query("SELECT n_regionkey, count(*) AS n, count(*) >= 5 AS may_remove FROM nation GROUP BY 1")
def active_admin_guard(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).withColumn("may_remove", F.col("n") >= 5)


@query("SELECT c_custkey, CASE WHEN length(trim(c_name)) <= 128 THEN lower(trim(c_name)) END AS login FROM customer")
def login_names(spark, sf_dir):
    name = F.trim("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.length(name) <= 128, F.lower(name)).alias("login"))


@query("SELECT user_id, event_type, count(*) AS n, (sum(value) / count(*))::DOUBLE > 50 AS heavy FROM (SELECT user_id, event_type, round(value)::BIGINT AS value FROM events) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 3")
def top_tools_per_caller(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.sum(F.round("value").cast("long")) / F.count("*") > 50).alias("heavy"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return g.withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")


@query("SELECT o_orderkey, max_by(l_linenumber, l_shipdate::VARCHAR || lpad(l_linenumber::VARCHAR, 4, '0')) AS last_line FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1")
def latest_version_per_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    last = ledger.latest_wins(lines.join(open_, "o_orderkey", "left_semi"), "o_orderkey", ["l_shipdate", "l_linenumber"])
    return last.select("o_orderkey", F.col("l_linenumber").alias("last_line"))
