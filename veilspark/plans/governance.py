"""Queries over ledgers, queues, versions, reports and grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks, governance, ledger, masking, report
from ..streaming import state
from .masking import _MANIFEST, token_sql
from .registry import inline, over, per, query, table, values


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1")
def history_ledger_first_write(spark, sf_dir):
    return ledger.first_writes(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"])


@query("SELECT user_id, event_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest_wins(spark, sf_dir):
    return ledger.latest_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", ["ts", "event_id"])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'inserted' WHEN event_id % 5 = 0 THEN 'conflict' ELSE 'existing' END AS status FROM events")
def terminal_conflict(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = e.where("event_id % 3 <> 0").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("other")).otherwise(F.col("event_type")).alias("event_type"))
    return ledger.write_status(e.select("event_id", "event_type"), stored, "event_id", "event_type")


@query("SELECT event_type AS tool, count(*) AS denied_count, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE regexp_full_match(event_type, '[A-Za-z0-9_.:-]{1,128}') GROUP BY 1 ORDER BY 3, 1 LIMIT 500")
def tool_auto_registration(spark, sf_dir):
    return ledger.registered_tools(table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), "ts"), 500)


@query("""
SELECT event_id, m AS in_minute, h AS in_hour, m <= 5 AND h <= 20 AS allowed FROM (
 SELECT event_id, count(*) OVER (PARTITION BY user_id % 3 ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS m,
        count(*) OVER (PARTITION BY user_id % 3 ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS h FROM events)
""")
def rate_limit_window(spark, sf_dir):
    return ledger.rate_limited(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("key"), "ts"))


@query("SELECT user_id, event_id, n AS attempt, greatest(1, round(least(60 * pow(2.0, least(n - 1, 20)), 3600.0)))::BIGINT AS delay_s, CASE WHEN n >= 8 THEN 'needs_attention' ELSE 'retrying' END AS state FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'purchase')")
def refresh_backoff_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'purchase'")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.select("user_id", "event_id", n.cast("long").alias("attempt"))
    return e.select("*", ledger.retry_delay(F.col("attempt"), 60, 3600).alias("delay_s"), F.when(F.col("attempt") >= 8, "needs_attention").otherwise("retrying").alias("state"))


@query("SELECT event_id, ts FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-05 00:00:00' ORDER BY ts, event_id LIMIT 50)")
def ttl_bounded_cleanup(spark, sf_dir):
    return ledger.bounded_cleanup(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "2024-01-05 00:00:00", 50, "event_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_name ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def partial_update(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    patch = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("new "), "s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 3 == 0, 1).alias("s_nationkey"))
    return ledger.patched(s, patch, "s_suppkey", ["s_name", "s_nationkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, coalesce(max(c_custkey), 0) + 1 AS next_version FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def next_version(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.max("c_custkey").alias("m"))
    return table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", (F.coalesce("m", F.lit(0)) + 1).alias("next_version"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def history_top_recent(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 500 ORDER BY 1 DESC LIMIT 20")
def journal_keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey < 500").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(20)


@query("""
SELECT n_nationkey, n_name, coalesce(n, 0)::BIGINT AS customers, coalesce(s, 0)::BIGINT AS suppliers, CASE WHEN coalesce(s, 0) > 5 THEN 'needs_attention' WHEN coalesce(s, 0) > 0 THEN 'retrying' ELSE 'idle' END AS state
FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON b.k = n_nationkey
""")
def database_summary(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("ck")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("sk")).agg(F.count("*").alias("s"))
    met = table(spark, sf_dir, "nation").join(a, F.col("ck") == F.col("n_nationkey"), "left").join(b, F.col("sk") == F.col("n_nationkey"), "left")
    s = F.coalesce("s", F.lit(0))
    return met.select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("customers"), s.alias("suppliers"), F.when(s > 5, "needs_attention").when(s > 0, "retrying").otherwise("idle").alias("state"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def startup_intents_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(orders, "c_custkey", "left_anti").select("c_custkey")


@query(f"SELECT split_part(r, '.', 1) AS segment, count(*) AS fields, sum(password_mode::INT)::BIGINT AS passwords, bool_or(contains(r, '.')) AS deeper FROM (SELECT substr(source_path, 9) AS r, password_mode FROM {_MANIFEST} WHERE starts_with(source_path, 'Catalog.')) GROUP BY 1")
def metadata_tree_rollup(spark, sf_dir):
    return report.tree_level(inline(spark, _MANIFEST, sf_dir), "Catalog.")


@query(f"SELECT source_path, field_name FROM {_MANIFEST} WHERE contains(lower(source_path), 'person') OR contains(lower(field_name), 'person') ORDER BY 1 LIMIT 201")
def metadata_search(spark, sf_dir):
    m = inline(spark, _MANIFEST, sf_dir).select("source_path", "field_name")
    return m.where(report.contains_text(["source_path", "field_name"], "person")).orderBy("source_path").limit(201)


_CELLS = over("orders", "o_orderkey", "field, value", [("a", "1"), ("a", "2.5"), ("b", "x"), ("b", "1"), ("c", None), ("d", "true"), ("d", "false"), ("e", "2024"), ("e", None)], field="v.field || (o_custkey % 5)::STRING")


@query(f"""
SELECT field, CASE WHEN count(k) = 0 THEN 'null' WHEN count(DISTINCT k) = 1 THEN max(k) ELSE 'mixed' END AS type FROM (
 SELECT field, CASE WHEN value IS NULL THEN NULL WHEN regexp_full_match(value, '-?\\d+(\\.\\d+)?') THEN 'number' WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS k FROM {_CELLS}) GROUP BY 1
""")
def report_column_types(spark, sf_dir):
    return report.column_types(inline(spark, _CELLS, sf_dir))


_REASONS = "(SELECT event_id % 50 AS doc_id, '/' || (user_id % 4)::VARCHAR AS ptr, event_type AS reason, event_id AS pos FROM events)"


def _reasons(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("doc_id"), F.concat(F.lit("/"), (F.col("user_id") % 4).cast("string")).alias("ptr"), F.col("event_type").alias("reason"), F.col("event_id").alias("pos"))


@query(f"SELECT doc_id, ptr, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM {_REASONS} GROUP BY 1, 2")
def reason_cells(spark, sf_dir):
    return report.reason_cells(_reasons(spark, sf_dir))


@query(f"SELECT reason, count(DISTINCT (doc_id, ptr)) AS cells FROM {_REASONS} GROUP BY 1")
def mask_detail_counts(spark, sf_dir):
    return _reasons(spark, sf_dir).select("reason", "doc_id", "ptr").distinct().groupBy("reason").agg(F.count("*").alias("cells"))


@query(f"SELECT reason, (row_number() OVER (ORDER BY min(pos), reason) - 1)::INT AS idx FROM {_REASONS} GROUP BY reason")
def reason_first_occurrence(spark, sf_dir):
    return report.reason_index(_reasons(spark, sf_dir))


@query("""
WITH p AS (SELECT o_orderkey AS doc_id, '/orders/' || (o_custkey % 5)::VARCHAR || '/' || (o_custkey % 3)::VARCHAR || '/x' AS ptr FROM orders),
k AS (SELECT o_orderkey AS doc_id, unnest(['/orders', '/orders/1', '/orders/2/0', '/orders/3/1/x', '/ord', '/orders/10']) AS known, unnest(range(6)) AS cell FROM orders WHERE o_orderkey % 7 <> 0)
SELECT p.doc_id, p.ptr, max_by(cell, length(known)) AS cell FROM p LEFT JOIN k ON k.doc_id = p.doc_id AND (ptr = known OR starts_with(ptr, known || '/')) GROUP BY 1, 2
""")
def nearest_ancestor(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pointers = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("/orders/"), F.col("o_custkey") % 5, F.lit("/"), F.col("o_custkey") % 3, F.lit("/x")).alias("ptr"))
    known = ("/orders", "/orders/1", "/orders/2/0", "/orders/3/1/x", "/ord", "/orders/10")
    entries = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("ptr"), F.lit(i).cast("long").alias("cell")) for i, k in enumerate(known)])))
    return blocks.nearest(pointers, entries, "doc_id")


_MASKED = f"CASE WHEN c_nationkey % 3 = 0 THEN {token_sql(chr(39) + 'NAME' + chr(39), 'c_name')} ELSE c_name END"


@query(f"""
SELECT a, b, count(*) AS cells FROM (
 SELECT CASE WHEN c_nationkey % 3 = 0 THEN 'masked' ELSE 'open' END AS a, CASE WHEN c_nationkey % 5 = 0 THEN 'secret' WHEN c_nationkey % 2 = 0 THEN 'masked' ELSE 'open' END AS b FROM customer) WHERE a <> b GROUP BY 1, 2
""")
def dry_run_status_change(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    token = X.mask_token(F.lit("NAME"), F.col("c_name"))
    active = F.when(F.col("c_nationkey") % 3 == 0, token).otherwise(F.col("c_name"))
    candidate = F.when(F.col("c_nationkey") % 5 == 0, F.lit(X.REMOVED)).when(F.col("c_nationkey") % 2 == 0, token).otherwise(F.col("c_name"))
    both = c.select(masking.cell_status(active).alias("a"), masking.cell_status(candidate).alias("b"))
    return both.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("cells"))


@query("SELECT event_type, (list_sort(list(value)))[(count(*) // 2 + 1)::INT] AS upper_median, max(value) AS slowest, arg_max(event_id, (value, -event_id)) AS slowest_id, count(*) FILTER (WHERE value > 50) AS over_budget FROM events GROUP BY 1")
def dry_run_timing(spark, sf_dir):
    return report.timing(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value", 50)


_BEFORE = "(SELECT 'name' AS selector, 'p' || p_partkey::STRING AS pattern, CASE p_partkey % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'secret' ELSE 'mask' END AS action, p_brand AS category, p_size % 3 AS priority FROM part WHERE p_partkey % 4 <> 0)"
_AFTER = "(SELECT 'name' AS selector, 'p' || p_partkey::STRING AS pattern, CASE p_partkey % 3 WHEN 0 THEN 'keep' ELSE 'mask' END AS action, CASE WHEN p_partkey % 11 = 0 THEN 'X' ELSE p_brand END AS category, p_size % 4 AS priority FROM part WHERE p_partkey % 4 <> 1)"
_DIFF = f"""
SELECT selector, pattern, change, CASE WHEN change = 'added' THEN CASE WHEN y = 'keep' THEN 'weakening' ELSE 'strengthening' END WHEN change = 'removed' THEN CASE WHEN x = 'keep' THEN 'strengthening' ELSE 'weakening' END WHEN ry > rx THEN 'strengthening' WHEN ry < rx THEN 'weakening' ELSE 'neutral' END AS class
FROM (SELECT coalesce(b.selector, a.selector) AS selector, coalesce(b.pattern, a.pattern) AS pattern, b.action AS x, a.action AS y,
  CASE b.action WHEN 'secret' THEN 3 WHEN 'mask' THEN 2 ELSE 1 END AS rx, CASE a.action WHEN 'secret' THEN 3 WHEN 'mask' THEN 2 ELSE 1 END AS ry,
  CASE WHEN b.action IS NULL THEN 'added' WHEN a.action IS NULL THEN 'removed' WHEN a.action <> b.action THEN 'action' WHEN a.category <> b.category THEN 'category' WHEN a.priority <> b.priority THEN 'priority' ELSE 'same' END AS change
 FROM {_BEFORE} b FULL JOIN {_AFTER} a ON a.selector = b.selector AND a.pattern = b.pattern) WHERE change <> 'same'
"""


@query(_DIFF)
def setup_diff_rules(spark, sf_dir):
    return governance.rule_diff(inline(spark, _BEFORE, sf_dir), inline(spark, _AFTER, sf_dir))


@query(f"SELECT class, count(*) AS n FROM ({_DIFF}) GROUP BY 1")
def diff_counts(spark, sf_dir):
    return setup_diff_rules(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


_OLD = "(SELECT s_nationkey AS n, list(DISTINCT s_suppkey % 4) AS v FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)"
_NEW = "(SELECT s_nationkey AS n, list(DISTINCT s_suppkey % 4) AS v FROM supplier WHERE s_suppkey % 3 <> 1 GROUP BY 1)"


@query(f"""
SELECT source_path, change, CASE WHEN change IN ('added', 'widened') THEN 'strengthening' ELSE 'weakening' END AS class FROM (
 SELECT 'n' || coalesce(b.n, a.n)::VARCHAR AS source_path, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' WHEN list_has_all(a.v, b.v) AND list_has_all(b.v, a.v) THEN 'same' WHEN list_has_all(a.v, b.v) THEN 'widened' WHEN list_has_all(b.v, a.v) THEN 'narrowed' ELSE 'changed' END AS change
 FROM {_OLD} b FULL JOIN {_NEW} a ON a.n = b.n) WHERE change <> 'same'
""")
def setup_diff_sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("source_path", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    sets = lambda d: d.groupBy("source_path").agg(F.collect_set(F.col("s_suppkey") % 4).alias("allowed"))
    return governance.source_diff(sets(s.where("s_suppkey % 2 = 0")), sets(s.where("s_suppkey % 3 <> 1")))


_LIVE = "(SELECT 't' || o_orderkey::STRING AS tool, CASE o_custkey % 3 WHEN 0 THEN 'data-mask' WHEN 1 THEN 'no-mask' ELSE 'deny-pending-review' END AS mode FROM orders WHERE o_orderkey % 5 <> 0)"
_WANTED = "(SELECT 't' || o_orderkey::STRING AS tool, CASE o_custkey % 4 WHEN 0 THEN 'data-mask' WHEN 1 THEN 'no-mask' ELSE 'deny-pending-review' END AS mode FROM orders WHERE o_orderkey % 7 <> 0)"


@query(f"""
SELECT tool, before, after, CASE WHEN rank_after < rank_before THEN 'weakening' ELSE 'strengthening' END AS class FROM (
 SELECT w.tool, coalesce(l.mode, 'deny-pending-review') AS before, w.mode AS after, CASE coalesce(l.mode, 'deny-pending-review') WHEN 'no-mask' THEN 0 WHEN 'data-mask' THEN 1 ELSE 2 END AS rank_before, CASE w.mode WHEN 'no-mask' THEN 0 WHEN 'data-mask' THEN 1 ELSE 2 END AS rank_after FROM {_WANTED} w LEFT JOIN {_LIVE} l USING (tool)) WHERE before <> after
""")
def setup_diff_tools(spark, sf_dir):
    return governance.tool_diff(inline(spark, _LIVE, sf_dir), inline(spark, _WANTED, sf_dir))


_CHANGES = "(SELECT 'c_' || substr(sha256(n_name), 1, 16) AS change_id, CASE WHEN n_nationkey % 2 = 0 THEN 'weakening' ELSE 'neutral' END AS class FROM nation WHERE n_nationkey < 20)"
_CONFIRMED = "(SELECT 'c_' || substr(sha256(n_name), 1, 16) AS change_id FROM nation WHERE n_nationkey % 3 = 0)"


@query(f"SELECT change_id, 'missing' AS problem FROM {_CHANGES} WHERE class = 'weakening' AND change_id NOT IN (SELECT change_id FROM {_CONFIRMED}) UNION ALL SELECT change_id, 'stale' FROM {_CONFIRMED} WHERE change_id NOT IN (SELECT change_id FROM {_CHANGES})")
def activation_missing_confirmations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("change_id", F.concat(F.lit("c_"), F.substring(F.sha2("n_name", 256), 1, 16)))
    changes = n.where("n_nationkey < 20").select("change_id", F.when(F.col("n_nationkey") % 2 == 0, "weakening").otherwise("neutral").alias("class"))
    return governance.unconfirmed(changes, n.where("n_nationkey % 3 = 0").select("change_id"))


@query("""
WITH a AS (SELECT c_custkey AS user_id, c_nationkey AS database FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 5 <> 0)
SELECT *, 'revoke' AS what FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'grant' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def access_grant_revoke(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("database"))
    return governance.grants_diff(c.where("user_id % 3 <> 0"), c.where("user_id % 5 <> 0"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def scope_filter(spark, sf_dir):
    granted = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(granted, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def viewer_grants_cross(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_name")))


@query("""
WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 1800 THEN 0 ELSE 1 END AS new FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts, ts AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g)
SELECT event_id, session_no, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id, session_no) <= 28800 AS valid FROM n
""")
def session_validity(spark, sf_dir):
    return ledger.valid_sessions(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 1800, 28800)


_ERRORS = over("orders", "o_orderkey", "id, message", [(1, "QUERY_PARSE_ERROR {(3, 14)}: unexpected"), (2, "fine"), (3, "{(1,2)} {(3,4)}")], id="o_orderkey", message="v.message || o_orderstatus")


@query(f"SELECT id, regexp_extract(message, '\\{{(\\(\\d+,\\s*\\d+\\))\\}}', 1) AS position FROM {_ERRORS}")
def parse_error_strip(spark, sf_dir):
    return inline(spark, _ERRORS, sf_dir).select("id", F.regexp_extract("message", r"\{(\(\d+,\s*\d+\))\}", 1).alias("position"))


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) > 40 THEN substr(trim(text), 1, 40) || '…' ELSE trim(text) END AS title FROM conversations")
def call_title(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", report.call_title(F.col("text"), 40).alias("title"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000.5 AND o_totalprice <= 90000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 100")
def grid_view_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").where(report.range_filter(F.col("o_totalprice"), "1000,5..90000"))
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(100)


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 1000")
def grid_range_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").where(report.range_filter(F.col("p_retailprice"), "..1000"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'a1') OR contains(lower(p_type), 'st')")
def grid_global_search(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").where(report.contains_text(["p_name", "p_type"], "St") | report.contains_text(["p_name"], "a1"))


_GRID = values("col, value", [("d", "2024-01-01"), ("d", "2024-02-03T10:00:00Z"), ("s", "abc"), ("s", "2024-01-01"), ("n", None), ("t", "2024-13"), ("d2", "2024-01-01 10:00")])


@query(f"SELECT col, CASE WHEN count(k) = 0 THEN 'string' WHEN count(DISTINCT k) = 1 THEN max(k) ELSE 'string' END AS type FROM (SELECT col, CASE WHEN value IS NOT NULL THEN CASE WHEN regexp_matches(value, '{report.ISO_DATE}') THEN 'date' ELSE 'string' END END AS k FROM {_GRID}) GROUP BY 1")
def grid_column_types(spark, sf_dir):
    return report.grid_types(inline(spark, _GRID))


@query("SELECT c_custkey, sha256('{\"acctbal\":' || (c_acctbal * 100)::BIGINT::VARCHAR || ',\"name\":\"' || c_name || '\"}') AS hash FROM customer")
def content_hash(spark, sf_dir):
    content = F.to_json(F.struct((F.col("c_acctbal") * 100).cast("decimal(20,0)").cast("long").alias("acctbal"), F.col("c_name").alias("name")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(content, 256).alias("hash"))


_CALLS = per("orders", "o_orderkey", "call_id", 4, "call_id, col, sources, lineage, sourceless", values("call_id, col, sources, lineage, sourceless", [(1, "a", "p,q", "q,p", None), (1, "b", "", "", "count"), (2, "a", "p", "p,q", None), (3, "a", "", "", None), (4, "a", "p", "p", None), (4, "a", "p", "p", None)]))


@query(f"SELECT call_id, bool_and(ok) AND count(*) = count(DISTINCT col) AS valid FROM (SELECT call_id, col, CASE WHEN sources = '' THEN coalesce(sourceless IN ('count', 'literal', 'parameter', 'value', 'composite'), FALSE) ELSE list_sort(string_split(sources, ',')) = list_sort(string_split(lineage, ',')) END AS ok FROM {_CALLS}) GROUP BY 1")
def lineage_valid(spark, sf_dir):
    same = F.sort_array(F.split("sources", ",")) == F.sort_array(F.split("lineage", ","))
    ok = F.when(F.col("sources") == "", F.coalesce(F.col("sourceless").isin("count", "literal", "parameter", "value", "composite"), F.lit(False))).otherwise(same)
    return inline(spark, _CALLS, sf_dir).withColumn("ok", ok).groupBy("call_id").agg((F.bool_and("ok") & (F.count("*") == F.countDistinct("col"))).alias("valid"))


@query("SELECT user_id AS database, user_id::VARCHAR AS value, event_type, count(*) AS uses FROM events GROUP BY 1, 2, 3")
def token_use_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("database"), F.col("user_id").cast("string").alias("value"), "event_type").agg(F.count("*").alias("uses"))


@query(f"""
WITH u AS (SELECT user_id, event_type, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
l AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM u)
SELECT user_id AS database, {token_sql('upper(event_type)', 'user_id::VARCHAR')} AS token, min(ts) AS created, max(ts) + INTERVAL 1 HOUR AS expires, count(*) AS uses FROM l GROUP BY user_id, event_type, life
""")
def streaming_token_store(spark, sf_dir):
    lives = state.drained(state.token_store(state.event_stream(spark, sf_dir)), "token_store", "complete")
    return lives.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created", "expires")})


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_tumbling_counts(spark, sf_dir):
    counted = state.drained(state.tumbling_counts(state.event_stream(spark, sf_dir)), "tumbling_counts", "complete")
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
