"""Queries over whole results, live policies, SQL functions and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as names
from ..functions import text as X
from ..operators import dictionary, governance, mapping, masking, policy, report, result
from ..streaming import state
from .masking import EMAIL, replace_sql, token_sql
from .registry import inline, over, per, query, table, values

_PEOPLE = per("orders", "o_orderkey", "doc_id", 4, "doc_id, field, value", values("doc_id, field, value", [
    (1, "full_name", "Ann Lee"), (1, "note", "Ann Lee met Ann, then Lee"), (1, "фио", "Ann"), (2, "note", "Ann Lee"), (2, "employee_name", ""), (3, "person_name", None), (3, "memo", None), (4, "fio", "Bo"), (4, "Full Name", "Bo Bo"), (4, "t", "Bo Bo Bo"),
]))
_IS_PERSON = f"regexp_matches(field, '(?i){X.PERSON_NAME}')"


def _cells(df):
    return df.withColumn("ptr", F.concat(F.lit("/"), X.pointer_escape(F.col("field")))).select("doc_id", "ptr", "field", "value")


@query(f"""
WITH c AS (SELECT * FROM {_PEOPLE}), l AS (SELECT doc_id, list_sort(list(DISTINCT {{'n': -strlen(value), 'x': value}})) AS v FROM c WHERE {_IS_PERSON} AND value <> '' GROUP BY 1)
SELECT c.doc_id, '/' || field AS ptr, field, CASE WHEN {_IS_PERSON} AND value <> '' THEN {token_sql("'FIO'", 'value')}
  WHEN v IS NULL OR value IS NULL THEN value ELSE list_reduce(list_prepend(value, list_transform(v, lambda s: s.x)), lambda t, x: replace(t, x, {token_sql("'FIO'", 'x')})) END AS value
FROM c LEFT JOIN l ON l.doc_id = c.doc_id
""")
def document_person_literals(spark, sf_dir):
    return result.mask_person_literals(_cells(inline(spark, _PEOPLE, sf_dir)))


@query(f"""
SELECT c_custkey AS doc_id, '/' || field AS ptr, field, CASE field WHEN 'password' THEN '{X.REMOVED}' ELSE 'user {X.REMOVED} in ' || c_mktsegment END AS value
FROM (SELECT *, unnest(['password', 'note']) AS field FROM customer)
""")
def document_secret_literals(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("password"), F.concat(F.lit("user "), "c_name", F.lit(" in "), "c_mktsegment").alias("note"))
    return result.cut_secrets(masking.unpivot(c, "c_custkey", ["password", "note"]))


_SCHEMA = values("name, type, unverified", [("Client", "string", None), ("Segment", "string", None), ("Api_Key", "string", None), ("full_name", "string", None), ("Note", "string", None), ("Extra", "string", True), ("Cut", "string", None)])
_LINEAGE = values("column, source_path, source_type, secret_cut", [("client", "Catalog.customer.c_name", "string", False), ("segment", "Catalog.customer.c_mktsegment", "string", False), ("note", "Catalog.customer.note", "string", None), ("cut", "Catalog.customer.key", "string", True)])
_LIVE = values("pos, selector, pattern, action, category, priority", [(1, "source_path", "*c_name", "mask", "CLIENT", 1), (2, "name", "client", "mask", "NAME", 9), (3, "source_path", "Catalog.customer.c_name", "mask", "CLIENT", 2), (4, "name", "segment", "keep", "SEG", 1)])
_FIELDS = ("Client", "Segment", "Api_Key", "full_name", "Note", "Extra", "Cut")
_VALUES = {"BUILDING": "SEG", "BUILD": "VERB", "MACHINERY": "SEG"}
_SEGMENT = "|".join(sorted(_VALUES, key=lambda v: (-len(v), v)))
_SEGMENT_KIND = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VALUES.items()) + " END"
_NOTE = replace_sql(f"replace(value, c_name, {token_sql(chr(39) + 'FIO' + chr(39), 'c_name')})", _SEGMENT, _SEGMENT_KIND)


@query(f"""
SELECT doc_id, '/' || field AS ptr, CASE field WHEN 'Client' THEN {token_sql("'CLIENT'", "value")} WHEN 'Api_Key' THEN '{X.REMOVED}' WHEN 'Cut' THEN '{X.REMOVED}'
  WHEN 'full_name' THEN {token_sql("'FIO'", 'value')} WHEN 'Extra' THEN {token_sql("'UNVERIFIED_STRING'", 'value')} WHEN 'Segment' THEN {replace_sql('value', _SEGMENT, _SEGMENT_KIND)} ELSE {replace_sql('n', EMAIL, "'EMAIL'")} END AS value,
  CASE field WHEN 'Client' THEN 'rule:mask' WHEN 'Api_Key' THEN 'secret:name' WHEN 'Cut' THEN 'secret:name' WHEN 'full_name' THEN 'person:field' WHEN 'Extra' THEN 'unverified' WHEN 'Segment' THEN CASE WHEN regexp_matches(value, '{_SEGMENT}') THEN 'text' END ELSE 'text' END AS reason
FROM (SELECT doc_id, field, value, c_name, {_NOTE} AS n FROM (
  SELECT c_custkey AS doc_id, c_name, unnest({list(_FIELDS)}) AS field, unnest([c_name || '!', c_mktsegment, 'k', c_name, c_name || ' in ' || c_mktsegment || ' at u' || c_custkey::VARCHAR || '@example.org, {X.REMOVED}', c_mktsegment, 'x']) AS value FROM customer))
""")
def protect_result(spark, sf_dir):
    """What the source of Cut hides is removed from the note as well."""
    c = table(spark, sf_dir, "customer")
    note = F.concat("c_name", F.lit(" in "), "c_mktsegment", F.lit(" at u"), F.col("c_custkey").cast("string"), F.lit("@example.org, pin-"), F.col("c_custkey").cast("string"))
    shown = c.select("c_custkey", F.concat("c_name", F.lit("!")).alias("Client"), F.col("c_mktsegment").alias("Segment"), F.lit("key k").alias("Api_Key"), F.col("c_name").alias("full_name"), note.alias("Note"), F.col("c_mktsegment").alias("Extra"), F.concat(F.lit("pin-"), F.col("c_custkey").cast("string")).alias("Cut"))
    known = policy.evidence(inline(spark, _SCHEMA), inline(spark, _LINEAGE))
    return result.protect(masking.unpivot(shown, "c_custkey", list(_FIELDS)), known, inline(spark, _LIVE), _VALUES, [(EMAIL, "EMAIL")])


@query(f"SELECT c_custkey, {token_sql(chr(39) + 'NAME' + chr(39), 'c_name')} AS token, contains(lower(c_mktsegment), 'build') AS matches, CASE WHEN c_custkey % 2 = 0 THEN 'masked' ELSE 'open' END AS status FROM customer")
def sql_functions(spark, sf_dir):
    names.register(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("sql_functions_customer")
    return spark.sql("SELECT c_custkey, mask_token('db', 'name', c_name) AS token, wildcard_match('*Build*', c_mktsegment) AS matches, cell_status(IF(c_custkey % 2 = 0, mask_token('db', 'name', c_name), c_name)) AS status FROM sql_functions_customer")


_BEFORE = "(SELECT 'name' AS selector, 'p' || p_partkey::STRING AS pattern, CASE p_partkey % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'secret' ELSE 'mask' END AS action, p_brand AS category, p_size % 3 AS priority FROM part WHERE p_partkey % 4 <> 0)"
_WANTED = "(SELECT 'name' AS selector, 'p' || p_partkey::STRING AS pattern, CASE p_partkey % 3 WHEN 0 THEN 'keep' ELSE 'mask' END AS action, CASE WHEN p_partkey % 11 = 0 THEN 'X' ELSE p_brand END AS category, p_size % 4 AS priority FROM part WHERE p_partkey % 4 <> 1)"
_DECLINED = "(SELECT 'name' AS selector, 'p' || p_partkey::STRING AS pattern FROM part WHERE p_partkey % 6 = 0)"


@query(f"""
SELECT selector, pattern, action, category, priority FROM {_WANTED} w WHERE NOT EXISTS (SELECT 1 FROM {_DECLINED} d WHERE d.selector = w.selector AND d.pattern = w.pattern)
UNION ALL SELECT selector, pattern, action, category, priority FROM {_BEFORE} b WHERE EXISTS (SELECT 1 FROM {_DECLINED} d WHERE d.selector = b.selector AND d.pattern = b.pattern)
""")
def activation_result(spark, sf_dir):
    return governance.activated(inline(spark, _BEFORE, sf_dir), inline(spark, _WANTED, sf_dir), inline(spark, _DECLINED, sf_dir))


@query("SELECT (SELECT max(p_size) + 1 FROM part) AS version, p_partkey, p_name FROM part WHERE p_size = 3")
def rollback_draft(spark, sf_dir):
    return governance.rolled_back(table(spark, sf_dir, "part").select(F.col("p_size").alias("version"), "p_partkey", "p_name"), 3)


_RULES = values("selector, pattern, action", [("source_path", "Catalog.Person.Name", "mask"), ("source_path", "*Nowhere*", "mask"), ("name", "pin", "secret"), ("regex", "[0-9]+", "keep"), ("source_path", "Catalog.Gone", "keep")])
_SOURCES = values("source_path", [("Catalog.Person.Name",), ("Catalog.Lost",), ("Catalog.Gone",)])
_TOOLS = values("tool", [("query",), ("drop",)])
_SEEN = values("tool", [("query",), ("ping",)])
_PATHS = values("source_path", [("Catalog.Person.Name",), ("Catalog.Person.Age",)])


@query("SELECT * FROM (VALUES ('PATH_NOT_IN_MANIFEST', '*Nowhere*'), ('PATH_NOT_IN_MANIFEST', 'Catalog.Gone'), ('PATH_NOT_IN_MANIFEST', 'Catalog.Lost'), ('TOOL_NOT_SEEN', 'drop'), ('DICTIONARY_LIMIT', '3'), ('SECRET_ACTIVATION_BLOCKED', 'pin'), ('REGEX_KEEP_NO_EFFECT', '[0-9]+')) AS v(code, subject)")
def setup_warnings(spark, sf_dir):
    return governance.warnings(*(inline(spark, x) for x in (_RULES, _SOURCES, _TOOLS, _PATHS, _SEEN)), max_sources=2)


@query("SELECT p_partkey, p_name FROM part ORDER BY array_to_string(list_transform(list_zip(string_split_regex(lower(p_name), '[0-9]+'), list_append(list_transform(regexp_extract_all(lower(p_name), '[0-9]+'), lambda m: lpad(m, 20, '0')), '')), lambda z: z[1] || z[2]), '') NULLS LAST, p_partkey LIMIT 100")
def grid_natural_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy(report.natural_key(F.col("p_name")).asc_nulls_last(), "p_partkey").limit(100)


@query("SELECT doc_id, coalesce(doc_id::VARCHAR, '') || chr(9) || coalesce(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g'), '') || chr(9) || coalesce(lang, '') AS line FROM documents")
def grid_tsv_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", report.tsv_line(["doc_id", "text", "lang"]).alias("line"))


@query("""
SELECT 'u' || user_id::VARCHAR AS database, event_type AS token, greatest(min(ts), max(ts) FILTER (WHERE value > 50)) AS used FROM events GROUP BY 1, 2
""")
def mapping_read_refresh(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("database"), F.col("event_type").alias("token"), "ts", "value")
    return mapping.touched(e.groupBy("database", "token").agg(F.min("ts").alias("created")), e.where("value > 50").select("database", "token", F.col("ts").alias("at")))


_FEED = "(SELECT 'Catalog.' || p_brand AS source_path, count(*) AS n, sum(strlen(p_type))::BIGINT AS b FROM part GROUP BY 1)"


@query(f"""
SELECT sum(n)::BIGINT AS "values", sum(b)::BIGINT AS bytes, (sum(b) * 2 + sum(n) * 48)::BIGINT AS memory_bytes, (sum(b) // sum(n))::BIGINT AS mean_bytes,
 floor(100.0 * (SELECT sum(b) FROM (SELECT b FROM {_FEED} ORDER BY b DESC, source_path LIMIT 3)) / sum(b))::BIGINT AS top_percent FROM {_FEED}
""")
def dictionary_memory_estimate(spark, sf_dir):
    feed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("Catalog."), "p_brand").alias("source_path"), F.lit("K").alias("category"), F.col("p_type").alias("value"))
    return dictionary.memory_estimate(dictionary.source_stats(feed))


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' OR value < 10 ORDER BY ts, event_id LIMIT 100")
def due_intents(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error' or value < 10").select("event_id", "ts").orderBy("ts", "event_id").limit(100)


@query("SELECT event_id, ts, props FROM events WHERE props IS NOT NULL AND event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 50")
def dry_run_sample(spark, sf_dir):
    return table(spark, sf_dir, "events").where("props is not null and event_type <> 'view'").select("event_id", "ts", "props").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


_SCALARS = over("customer", "c_custkey", "id, call, identity, at, loaded", [
    (1, "2b1f0a52-94a4-4c55-9f0e-0d3c1f9c1a11", "ras:main", "2024-01-05T10:00:00Z", 10), (2, "2B1F0A5294A4", "gen:x", "2024-01-05T10:00:00+03:00", 700_000), (3, None, "other", "2024-13-05T10:00:00Z", 1_000_000), (4, "", None, "2024-01-05", 0),
])


@query("SELECT v.* FROM (VALUES (1, TRUE, 'ras', TRUE, 5), (2, FALSE, 'gen', TRUE, 7), (3, NULL, 'unknown', FALSE, 10), (4, FALSE, 'unknown', FALSE, 5)) AS v(id, is_call, source, is_time, warm_up_s) JOIN customer ON id = 1 + c_custkey % 4")
def scalar_checks(spark, sf_dir):
    prefix = F.split("identity", ":")[0]
    time = F.col("at").rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$") & F.try_to_timestamp("at").isNotNull()
    return inline(spark, _SCALARS, sf_dir).select(
        "id", F.col("call").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").alias("is_call"), F.when(prefix.isin("ras", "gen"), prefix).otherwise("unknown").alias("source"), time.alias("is_time"), F.greatest(F.expr("loaded div 100000"), F.lit(5)).cast("int").alias("warm_up_s"),
    )


@query("SELECT DISTINCT event_id % 500 AS call_id FROM events")
def streaming_idempotent_calls(spark, sf_dir):
    return state.drained(state.first_calls(state.event_stream(spark, sf_dir), "365 days"), "idempotent_calls")
