"""Queries over writes, scopes, sources, literals and report details."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as names
from ..functions import text as X
from ..operators import access, dictionary, governance, lineage, masking, report
from .masking import replace_sql
from .registry import inline, over, per, query, table, values


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""
WITH i AS (SELECT event_id::VARCHAR AS call_id, 'd' || (user_id % 3)::VARCHAR AS database FROM events WHERE event_id % 2 = 0),
h AS (SELECT event_id::VARCHAR AS call_id, 'd' || (user_id % 4)::VARCHAR AS database FROM events WHERE event_id % 3 = 0)
SELECT i.call_id AS call_id, i.database AS database, CASE WHEN i.call_id::BIGINT % 5 = 0 THEN 'conflict' WHEN h.call_id IS NULL THEN 'inserted' WHEN h.database = i.database THEN 'existing' ELSE 'conflict' END AS status FROM i LEFT JOIN h ON h.call_id = i.call_id
""")
def history_insert_status(spark, sf_dir):
    rows = lambda n, m: _events(spark, sf_dir).where(f"event_id % {n} = 0").select(F.col("event_id").cast("string").alias("call_id"), F.concat(F.lit("d"), (F.col("user_id") % m).cast("string")).alias("database"))
    return access.history_insert(rows(2, 3), rows(3, 4), rows(5, 1))


@query("""
SELECT DISTINCT i.user_id AS correlation, i.event_type AS tool, 'C' AS code, CASE WHEN EXISTS (SELECT 1 FROM events l WHERE l.user_id = i.user_id AND l.event_type = i.event_type AND l.event_id % 2 = 1 AND epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(l.ts)) < 86400) THEN 'existing' ELSE 'inserted' END AS status FROM events i WHERE i.event_id % 2 = 0
""")
def unscoped_insert_status(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("correlation"), F.col("event_type").alias("tool"), F.lit("C").alias("code"), F.col("ts").alias("at"), "event_id")
    return access.unscoped_insert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "2024-01-20 00:00:00")


_TOOLS = values("tool, mode, auto_added, denied_count", [("click", "deny-pending-review", True, 5), ("view", "data-mask", True, 7), ("ping", "no-mask", False, 0)])
_SET = values("tool, mode", [("click", "data-mask"), ("other", "no-mask")])


@query("SELECT tool, mode, auto_added, denied_count::BIGINT AS denied_count FROM (VALUES ('click', 'data-mask', FALSE, 5), ('view', 'data-mask', TRUE, 7), ('ping', 'no-mask', FALSE, 0), ('other', 'no-mask', FALSE, 0)) AS v(tool, mode, auto_added, denied_count)")
def tool_modes_set(spark, sf_dir):
    return access.tools_set(inline(spark, _TOOLS).withColumn("denied_count", F.col("denied_count").cast("long")), inline(spark, _SET))


@query(f"""
SELECT t.tool AS tool, mode, auto_added, (denied_count + CASE WHEN mode = 'deny-pending-review' THEN (SELECT count(*) FROM events e WHERE e.event_type = t.tool) ELSE 0 END)::BIGINT AS denied_count FROM {_TOOLS} t
UNION ALL SELECT event_type, 'deny-pending-review', TRUE, n FROM (SELECT event_type, count(*) AS n, min(ts) AS first FROM events WHERE event_type NOT IN ('click', 'view', 'ping') GROUP BY 1 ORDER BY first, event_type LIMIT 2)
""")
def tools_after_denials(spark, sf_dir):
    calls = _events(spark, sf_dir).select(F.col("event_type").alias("tool"), "ts")
    return access.tools_denied(inline(spark, _TOOLS).withColumn("denied_count", F.col("denied_count").cast("long")), calls, 2)


_INTENTS = values("database, reason, attempts, state", [("a", "start", 3, "pending"), ("b", "manual", 8, "needs_attention"), ("c", "start", 0, "pending")])


@query("SELECT database, reason, attempts::BIGINT AS attempts, state FROM (VALUES ('a', 'start', 3, 'pending'), ('b', 'again', 0, 'pending'), ('c', 'start', 0, 'pending'), ('d', 'again', 0, 'pending')) AS v(database, reason, attempts, state)")
def refresh_intents_set(spark, sf_dir):
    return access.intents_set(inline(spark, _INTENTS).withColumn("attempts", F.col("attempts").cast("long")), inline(spark, values("database, reason", [("b", "again"), ("d", "again")])))


@query("SELECT call_id, title, had_tokens FROM (SELECT event_id % 900 AS call_id, arg_min(event_type, (ts, event_type)) AS title, min(ts) AS began, bool_or(event_id % 7 = 0) AS had_tokens FROM events GROUP BY 1) WHERE epoch(TIMESTAMP '2024-01-12 00:00:00') - floor(epoch(began)) < 864000")
def call_contexts_alive(spark, sf_dir):
    writes = _events(spark, sf_dir).select((F.col("event_id") % 900).alias("call_id"), F.col("ts").alias("at"), F.col("event_type").alias("title"), (F.col("event_id") % 7 == 0).alias("had_tokens"))
    return access.call_contexts(writes, 864_000, "2024-01-12 00:00:00")


_ROLES = values("user_id, role", [(1, "super-admin"), (2, "admin"), (3, "viewer"), (4, "viewer")])
_GRANTS = values("user_id, database", [(2, "d0"), (2, "d1"), (2, "d1"), (3, "d2"), (9, "d0")])


@query("SELECT u AS user_id, 'd' || (s_suppkey % 4)::VARCHAR AS database, s_suppkey FROM supplier, (VALUES (1), (2), (3), (4)) AS v(u) WHERE u = 1 OR u = 2 AND s_suppkey % 4 IN (0, 1) OR u = 3 AND s_suppkey % 4 = 2")
def visible_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), (F.col("s_suppkey") % 4).cast("string")).alias("database"), "s_suppkey")
    return access.visible(rows, inline(spark, _ROLES), inline(spark, _GRANTS))


_CUTS = values("source_path, secret_cut", [("Catalog.A.Name", None), ("Catalog.A.Name2", True), ("Catalog.B.api_key", False), ("catalog.c.pin", False), ("Catalog.D.UserPassword", None), ("Catalog.E.X", False)])
_ITEMS = values("source_path, field_name, password_mode", [("Catalog.C.Pin", "Pin", True), ("Catalog.E.X", "userToken", False), ("Catalog.A.Name", "Name", False)])


@query("SELECT * FROM (VALUES ('Catalog.A.Name', FALSE), ('Catalog.A.Name2', TRUE), ('Catalog.B.api_key', TRUE), ('catalog.c.pin', TRUE), ('Catalog.D.UserPassword', TRUE), ('Catalog.E.X', TRUE)) AS v(source_path, secret)")
def secret_sources(spark, sf_dir):
    return access.secret_sources(inline(spark, _CUTS), inline(spark, _ITEMS))


_PATHS = over("customer", "c_custkey", "path, person", [("Catalog.Person.Full_Name", True), ("Catalog.Person_Name.Age", False), ("Catalog.X.ФИО", True), ("Справочник.Сотрудники.Контрагент", True), ("a", False), ("fio", False)], path="'Catalog.' || c_mktsegment || '.' || v.path")


@query(f"SELECT path, person FROM {_PATHS}")
def person_sources(spark, sf_dir):
    return inline(spark, _PATHS, sf_dir).select("path", access.person_source(F.col("path")).alias("person"))


_ALLOW = values("selector, pattern, action", [("source_path", "*#1*", "mask"), ("source_path", "*#2*", "keep"), ("name", "*", "mask")])


@query("SELECT DISTINCT 'Catalog.' || p_brand AS source_path, NULL::VARCHAR AS problem FROM part WHERE contains(p_brand, '#1') ORDER BY 1")
def selectors_planned(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.concat(F.lit("Catalog."), "p_brand").alias("source_path"))
    return access.planned_selectors("all", brands, brands, inline(spark, _ALLOW))


@query("SELECT NULL::VARCHAR AS source_path, 'too many sources' AS problem")
def selectors_too_many(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("Catalog."), F.col("p_partkey").cast("string")).alias("source_path"))
    return access.planned_selectors("part", names, names, inline(spark, _ALLOW))


@query("SELECT source_path, field_name, (SELECT count(*) > 50 FROM part WHERE contains(lower(p_type), 'a') OR contains(lower(p_name), 'a')) AS truncated FROM (SELECT p_type AS source_path, p_name AS field_name FROM part) WHERE contains(lower(source_path), 'a') OR contains(lower(field_name), 'a') ORDER BY 1, 2 LIMIT 50")
def metadata_found(spark, sf_dir):
    return access.found_metadata(table(spark, sf_dir, "part").select(F.col("p_type").alias("source_path"), F.col("p_name").alias("field_name")), "A", 50)


_ARGS = per("orders", "o_orderkey", "doc_id", 2, "doc_id, ptr, field, value", values("doc_id, ptr, field, value", [(1, "/userPassword", "userPassword", "x"), (1, "/q", "q", "token: abc, next"), (1, "/n", "n", "bearer abcdefgh12"), (2, "/q", "q", "SELECT 1"), (2, "/api-key", "api-key", None), (2, "/r", "r", "password = 'a b' and c")]))


@query(f"SELECT o_orderkey AS doc_id, ptr, value FROM (VALUES (1, '/userPassword', '{X.REMOVED}'), (1, '/q', '{X.REMOVED}, next'), (1, '/n', '{X.REMOVED}'), (2, '/q', 'SELECT 1'), (2, '/api-key', NULL), (2, '/r', '{X.REMOVED} and c')) AS v(id, ptr, value) JOIN orders ON id = 1 + o_orderkey % 2")
def argument_cut(spark, sf_dir):
    return access.cut_arguments(inline(spark, _ARGS, sf_dir))


_PEOPLE = per("orders", "o_orderkey", "doc_id", 5, "doc_id, field, json", values("doc_id, field, json", [(1, "full_name", '"Ann"'), (1, "фио", '{"presentation":"Bo","x":1}'), (1, "note", '["x"]'), (2, "fio_x", '"no"'), (2, "person_name", "[1]"), (3, "full_name", '{"x":1}'), (4, "full_name", "null"), (4, "employee.name", '""'), (5, "full_name", '{"name":"Cy"}')]))


@query("SELECT o_orderkey AS doc_id, texts, ok FROM (VALUES (1, 'Ann,Bo', TRUE), (2, '', FALSE), (3, '', FALSE), (4, '', TRUE), (5, 'Cy', TRUE)) AS v(id, texts, ok) JOIN orders ON id = 1 + o_orderkey % 5")
def person_texts(spark, sf_dir):
    return access.person_texts(inline(spark, _PEOPLE, sf_dir)).withColumn("texts", F.array_join("texts", ","))


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS texts, event_id % 3 <> 0 AS ok FROM events")
def secret_texts(spark, sf_dir):
    e = _events(spark, sf_dir)
    body = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_id").alias("api_key")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("api_key"), F.lit("x").alias("note"))))
    return access.secret_texts(masking.walk_json(e.select(F.col("event_id").alias("doc_id"), body.alias("json")))).withColumn("texts", F.array_join("texts", ","))


@query("""
WITH r AS (SELECT user_id % 20 AS doc_id, event_id AS pos, '/' || (event_id % 50)::VARCHAR AS ptr, 'r' || (event_id % 7)::VARCHAR AS reason FROM events),
f AS (SELECT doc_id, reason, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos), reason) - 1 AS place FROM r GROUP BY 1, 2)
SELECT DISTINCT r.doc_id AS doc_id, ptr, r.reason AS reason, CASE WHEN place < 4 THEN place END::INT AS idx FROM r JOIN f ON f.doc_id = r.doc_id AND f.reason = r.reason
""")
def recorded_reasons(spark, sf_dir):
    r = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("doc_id"), F.col("event_id").alias("pos"), F.concat(F.lit("/"), (F.col("event_id") % 50).cast("string")).alias("ptr"), F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string")).alias("reason"))
    return access.recorded_reasons(r, 4)


@query("SELECT user_id AS call_id, count(DISTINCT event_id % 30) AS tokens, count(DISTINCT event_id % 30) <= 5 AS ok FROM events GROUP BY 1")
def candidate_bounds(spark, sf_dir):
    return access.candidates_ok(_events(spark, sf_dir).select(F.col("user_id").alias("call_id"), (F.col("event_id") % 30).alias("token")), 5)


_BLOCK = values('"row", field, kind, value', [(1, "b", "number", "1"), (1, "A", "string", "x [MASK:v1:A:0]"), (2, "b", "null", None), (2, "z", "boolean", "true"), (3, "z", "string", "y"), (3, "Extra", "null", None), (1, "c", "string", "[SECRET_REMOVED]")])
_ORDER = values("pos, id", [(1, "b"), (2, "A"), (3, "none")])


@query("SELECT place::INT AS place, id, type, masked FROM (VALUES (1, 'b', 'number', FALSE), (2, 'A', 'string', TRUE), (3, 'none', 'null', FALSE), (4, 'c', 'string', TRUE), (5, 'Extra', 'null', FALSE), (6, 'z', 'mixed', FALSE)) AS v(place, id, type, masked)")
def report_block(spark, sf_dir):
    return access.table_block(inline(spark, _BLOCK.replace('"row"', "r")).withColumnRenamed("r", "row"), inline(spark, _ORDER))


@query("""
WITH d AS (SELECT DISTINCT user_id % 10 AS doc_id, event_id % 40 AS r, event_id % 5 AS c, event_type AS reason FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r, c, reason) AS place FROM d)
SELECT doc_id, reason, count(*) AS n, count(*) FILTER (WHERE place <= 15) AS listed FROM p GROUP BY 1, 2
""")
def mask_detail_capped(spark, sf_dir):
    d = _events(spark, sf_dir).select((F.col("user_id") % 10).alias("doc_id"), (F.col("event_id") % 40).alias("row"), (F.col("event_id") % 5).alias("col"), F.col("event_type").alias("reason"))
    return access.capped_detail(d, 15)


_IDS = over("customer", "c_custkey", "id, raw, uuid", [
    (1, "2B1F0A52-94A4-4C55-9F0E-0D3C1F9C1A11", "2b1f0a52-94a4-4c55-9f0e-0d3c1f9c1a11"), (2, "2b1f0a5294a44c559f0e0d3c1f9c1a11", "2b1f0a52-94a4-4c55-9f0e-0d3c1f9c1a11"),
    (3, "{2b1f0a52-94a4-4c55-9f0e-0d3c1f9c1a11}", "2b1f0a52-94a4-4c55-9f0e-0d3c1f9c1a11"), (4, "2b1f0a5294a4", None), (5, None, None), (6, "urn:uuid:2b1f0a52-94a4-4c55-9f0e-0d3c1f9c1a11", "2b1f0a52-94a4-4c55-9f0e-0d3c1f9c1a11"), (7, "zb1f0a52-94a4-4c55-9f0e-0d3c1f9c1a11", None),
])


@query(f"SELECT id, uuid FROM {_IDS}")
def uuid_texts(spark, sf_dir):
    return inline(spark, _IDS, sf_dir).select("id", access.uuid_text(F.col("raw")).alias("uuid"))


@query("""
SELECT doc_id, doc_id::VARCHAR || ';' || CASE WHEN regexp_matches(coalesce(text, ''), '[;"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END || ';' || coalesce(lang, '') || chr(13) || chr(10) AS line FROM documents
""")
def grid_csv_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", access.csv_line(["doc_id", "text", "lang"]).alias("line"))


_LINED = per("orders", "o_orderkey", "call_id", 12, "call_id, n, strict, valid", values("call_id, n, strict, valid", [(1, 2, False, True), (2, None, False, False), (3, 0, False, True), (4, 1, False, False), (5, 1, True, True), (6, 1, False, False), (7, 1, False, False), (8, 1, False, False), (9, 1, False, False), (10, 1, False, True), (11, 1, False, False), (12, 1, False, False)]))
_COLS = per("orders", "o_orderkey", "call_id", 12, "call_id, name, extra, sources, sourceless, unverified, types", values("call_id, name, extra, sources, sourceless, unverified, types", [
    (1, "a", None, "p,q", None, None, None), (1, "b", None, "", "count", None, None), (2, "a", None, "p", None, None, None), (4, "a", None, "p,q", None, None, None), (5, "u", None, "zz", None, True, "string"), (6, "u", None, "", None, True, "string"),
    (7, "a", "other", "p", None, None, None), (8, "a", None, "p", None, None, None), (8, "a", None, "p", None, None, None), (9, "b", None, "", "count", None, None), (10, "b", None, "", "literal", None, None), (11, "a", None, "p", "count", None, None), (12, "a", None, "p", None, None, None),
]))
_SAID = per("orders", "o_orderkey", "call_id", 12, "call_id, name, source_path, extra", values("call_id, name, source_path, extra", [(1, "a", "p", None), (1, "a", "q", None), (1, "a", "q", None), (4, "a", "p", None), (5, "u", "any", None), (7, "a", "p", None), (8, "a", "p", None), (11, "a", "p", None), (12, "a", "p", None)]))
_SHOWN = per("orders", "o_orderkey", "call_id", 12, "call_id, name, kind", values("call_id, name, kind", [(1, "a", "string"), (1, "a", "object"), (1, "b", "number"), (4, "a", "string"), (5, "u", "array"), (6, "u", "string"), (7, "a", "string"), (8, "a", "string"), (9, "b", "string"), (10, "b", "string"), (11, "a", "string"), (12, "a", "string"), (12, "z", "string")]))


@query(f"SELECT call_id, valid FROM {_LINED}")
def lineage_calls(spark, sf_dir):
    split = lambda c: F.when(F.col(c) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(c, ","))
    keys = F.filter(F.array(F.lit("name"), F.col("extra")), lambda k: k.isNotNull())
    columns = inline(spark, _COLS, sf_dir).withColumn("keys", keys).withColumn("sources", split("sources")).withColumn("output_types", split("types"))
    said = inline(spark, _SAID, sf_dir).withColumn("keys", keys)
    return lineage.valid_calls(inline(spark, _LINED, sf_dir).select("call_id", F.col("n").alias("rows"), "strict"), columns, said, inline(spark, _SHOWN, sf_dir))


@query(f"SELECT doc_id, {replace_sql('text', '[0-9]{16}', chr(39) + 'CARD' + chr(39))} AS masked FROM documents")
def sql_mask_text(spark, sf_dir):
    names.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("sql_mask_text_documents")
    return spark.sql("SELECT doc_id, mask_text('db', 'card', '[0-9]{16}', text) AS masked FROM sql_mask_text_documents")


@query("SELECT 'u' || user_id::VARCHAR AS database, CASE WHEN user_id % 4 = 0 THEN 'disabled' WHEN user_id % 3 = 0 THEN 'pending' WHEN user_id % 2 = 0 THEN 'ready' ELSE 'empty' END AS state FROM (SELECT DISTINCT user_id FROM events)")
def database_refresh_state(spark, sf_dir):
    u = _events(spark, sf_dir).select("user_id").distinct().withColumn("database", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    databases = u.select("database", F.when(F.col("user_id") % 4 == 0, "disabled").otherwise("enabled").alias("mode"))
    return report.refresh_state(databases, u.where("user_id % 3 = 0").select("database", F.lit("pending").alias("state")), u.select("database", F.when(F.col("user_id") % 2 == 0, "active").otherwise("failed").alias("status")))


@query("SELECT p_partkey, v FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' ELSE (p_size * 10)::VARCHAR || '.5' END AS v FROM part) ORDER BY coalesce(v, '') = '' DESC, try_cast(nullif(v, '') AS DOUBLE) DESC NULLS LAST, v DESC NULLS LAST, p_partkey LIMIT 300")
def grid_typed_sort(spark, sf_dir):
    v = F.when(F.col("p_partkey") % 9 == 0, None).when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat((F.col("p_size") * 10).cast("string"), F.lit(".5")))
    p = table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).withColumn("v2", F.nullif(F.col("v"), F.lit("")))
    empty, _, _ = report.typed_order(F.col("v"), "number", True)
    return p.orderBy(empty, F.col("v2").cast("double").desc(), F.col("v").desc(), "p_partkey").limit(300).select("p_partkey", "v")


_COUNTS = values("source_path, pulled, estimated", [("Catalog.A", 10, 200_000), ("Catalog.B", 150_000, None), ("Catalog.C", 99_999, 5)])


@query("SELECT * FROM (VALUES ('MANIFEST_UNAVAILABLE', ''), ('MISMATCH', 'main'), ('SOURCE_LARGE', 'Catalog.A'), ('SOURCE_LARGE', 'Catalog.B'), ('TOOL_NOT_SEEN', 'drop')) AS v(code, subject)")
def setup_warnings_sizes(spark, sf_dir):
    rules = inline(spark, values("selector, pattern, action", [("source_path", "Catalog.Gone", "mask")]))
    tools, none = inline(spark, values("tool", [("drop",)])), inline(spark, values("source_path", [("x",)])).where("false")
    hints = inline(spark, values("expected, database", [("main", "other"), ("Same", "same")]))
    return governance.warnings(rules, inline(spark, _COUNTS).select("source_path"), tools, none, tools.where("false"), hints=hints, sizes=inline(spark, _COUNTS))


@query("SELECT source_path, greatest(n, est)::BIGINT AS \"values\", greatest(1, ceil(greatest(n, est) / 20000.0))::BIGINT AS load_s, (b * 2 + greatest(n, est) * 48)::BIGINT AS memory_bytes FROM (SELECT 'Catalog.' || p_brand AS source_path, count(*) AS n, sum(strlen(p_type)) AS b, max(p_size) * 1000 AS est FROM part GROUP BY 1) WHERE greatest(n, est) >= 40000")
def sources_large_estimated(spark, sf_dir):
    feed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("Catalog."), "p_brand").alias("source_path"), F.lit("K").alias("category"), F.col("p_type").alias("value"), "p_size")
    guesses = feed.groupBy("source_path").agg((F.max("p_size") * 1000).cast("long").alias("estimated"))
    return dictionary.large_sources(dictionary.source_stats(feed).join(guesses, "source_path"), 40_000)
