"""Queries over the whole cascade with its reasons, and dry runs of policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json
from ..functions import text as X
from ..operators import blocks, cascade, governance, lifecycle, masking, policy, report, routing
from ..streaming import ingest, state
from ..streaming.store import token_calls
from .masking import CARD, EMAIL, replace_sql, token_sql
from .registry import inline, query, table, values

_COLUMNS = values("name, type, unverified", [("text", "string", None), ("author", "string", None), ("pin", "string", None), ("n", "number", None), ("lang", "string(2)", None), ("extra", "string", True)])
_LINEAGE = values("column, source_path, source_type, secret_cut", [("Text", "Catalog.Doc.Text", "string", None), ("author", "Catalog.Doc.ФИО", "string", None), ("pin", "Catalog.Doc.Pin", "string", None), ("n", "Catalog.Doc.N", "number", None)])
_RULES = [
    (1, "source_path", "*doc.text*", "keep", "DOC", 1), (2, "name", "text", "mask", "NAME", 9), (3, "name", "n", "mask", "NUM", 1), (4, "type", "string(*", "mask", "X", 1), (5, "type", "*string(*", "mask", "LANG", 1),
    (6, "dictionary", "CON", "keep", "CON", 1), (7, "regex", EMAIL, "mask", "EMAIL", 1), (8, "regex", CARD, "keep", "CARD", 2),
]
_MANIFEST = values("source_path, field_name, password_mode", [("catalog.doc.pin", "Pin", True), ("Catalog.Doc.Text", "Text", False)])
_DICTIONARY = {"the": "ART", "license": "LIC", "and": "CON"}
_AUTHOR = "'Автор №' || doc_id::VARCHAR"
#: Written out again: what has the shape of a secret.
_SHAPE = r"(?i)(bearer\s+[a-z0-9._~+/=-]{8,}|authorization\s*[:=]\s*\S+|-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----)"
_DOCS = f"""
d AS MATERIALIZED (SELECT doc_id, lang, text, {_AUTHOR} AS author, 'pin-' || doc_id::VARCHAR AS pin FROM documents WHERE text IS NOT NULL),
cut AS MATERIALIZED (SELECT *, replace(text || ' by ' || author || ' with ' || pin, pin, '{X.REMOVED}') AS t0 FROM d),
one AS MATERIALIZED (SELECT *, regexp_matches(t0, '{_SHAPE}') AS shape, replace(regexp_replace(t0, '{_SHAPE}', '{X.REMOVED}', 'g'), author, {token_sql("'FIO'", 'author')}) AS t1 FROM cut),
two AS MATERIALIZED (SELECT *, {replace_sql('t1', 'license|the', "CASE m WHEN 'the' THEN 'ART' ELSE 'LIC' END")} AS t2 FROM one)"""


def document_cells(spark, sf_dir):
    """Six cells of each document: its text with its author and its pin, these
    two, a number, the language, and a field that nothing is known about."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    author, pin = F.concat(F.lit("Автор №"), "doc_id"), F.concat(F.lit("pin-"), "doc_id")
    cell = lambda f, v, kind="string": F.struct(F.lit(f"/{f}").alias("ptr"), F.lit(f).alias("field"), v.alias("value"), F.lit(kind).alias("kind"))
    text = F.concat("text", F.lit(" by "), author, F.lit(" with "), pin)
    return d.select("doc_id", F.inline(F.array(cell("text", text), cell("author", author), cell("pin", pin), cell("n", F.lit("5"), "number"), cell("lang", F.col("lang")), cell("extra", F.lit("true"), "boolean"))))


def _done(spark, sf_dir):
    own = cascade.Policy(spark.createDataFrame(_RULES, cascade.RULES), _DICTIONARY, inline(spark, _MANIFEST))
    return cascade.cascade(document_cells(spark, sf_dir), policy.evidence(inline(spark, _COLUMNS), inline(spark, _LINEAGE)), own)


@query(f"""
WITH {_DOCS},
c AS (SELECT *, unnest(['text', 'author', 'pin', 'n', 'lang', 'extra']) AS f FROM two)
SELECT doc_id, '/' || f AS ptr,
 CASE f WHEN 'text' THEN {replace_sql('t2', EMAIL, "'EMAIL'")} WHEN 'author' THEN {token_sql("'FIO'", 'author')} WHEN 'pin' THEN '{X.REMOVED}' WHEN 'n' THEN '5' WHEN 'lang' THEN {token_sql("'LANG'", 'lang')} ELSE {token_sql("'UNVERIFIED_BOOL'", "'true'")} END AS value,
 CASE f WHEN 'text' THEN 'text' WHEN 'author' THEN 'person:field' WHEN 'pin' THEN 'secret:name' WHEN 'n' THEN 'kept' WHEN 'lang' THEN CASE WHEN lang IS NULL THEN 'kept' ELSE 'rule:mask' END ELSE 'unverified' END AS why
FROM c
""")
def cascade_values(spark, sf_dir):
    """Persons and secrets by source, numbers untouched, secrets cut first."""
    return _done(spark, sf_dir).select("doc_id", "ptr", "value", "why")


@query(f"""
WITH {_DOCS},
c AS (
  SELECT doc_id, '/text' AS ptr, ['secret:literal', CASE WHEN shape THEN 'secret:value' END, 'mandatory:fio:source', 'source_path:doc:keep',
    CASE WHEN contains(t1, 'the') AND (NOT contains(t1, 'license') OR instr(t1, 'the') < instr(t1, 'license')) THEN 'dictionary:ART' WHEN contains(t1, 'license') THEN 'dictionary:LIC' END,
    CASE WHEN contains(t1, 'the') AND contains(t1, 'license') THEN CASE WHEN instr(t1, 'the') < instr(t1, 'license') THEN 'dictionary:LIC' ELSE 'dictionary:ART' END END,
    CASE WHEN contains(t1, 'and') THEN 'dictionary:CON' END, CASE WHEN regexp_matches(t2, '{EMAIL}') THEN 'regex:EMAIL' END, CASE WHEN regexp_matches({replace_sql('t2', EMAIL, "'EMAIL'")}, '{CARD}') THEN 'regex:CARD' END] AS codes FROM two
  UNION ALL SELECT doc_id, '/author', ['mandatory:fio:name'] FROM d UNION ALL SELECT doc_id, '/pin', ['secret:name'] FROM d
  UNION ALL SELECT doc_id, '/lang', ['type:lang:mask'] FROM d WHERE lang IS NOT NULL UNION ALL SELECT doc_id, '/extra', ['unverified:extra'] FROM d),
k AS (SELECT doc_id, ptr, list_filter(codes, lambda x: x IS NOT NULL) AS codes FROM c)
SELECT doc_id, ptr, unnest(range(1, len(codes) + 1))::INT AS place, unnest(codes) AS code FROM k
""")
def cascade_reasons(spark, sf_dir):
    """One row for each reason of each cell, in order of first sight."""
    return cascade.cell_reasons(_done(spark, sf_dir)).select("doc_id", "ptr", "place", "code")


@query(f"""
WITH {_DOCS},
f AS (SELECT doc_id, shape, contains(t1, 'the') AS art, contains(t1, 'license') AS lic, instr(t1, 'the') < instr(t1, 'license') AS art_first, contains(t1, 'and') AS con, regexp_matches(t2, '{EMAIL}') AS mail, regexp_matches({replace_sql('t2', EMAIL, "'EMAIL'")}, '{CARD}') AS card, lang IS NOT NULL AS lang FROM two),
c AS (SELECT doc_id, list_filter(['mandatory:fio:name', 'unverified:extra', CASE WHEN lang THEN 'type:lang:mask' END, 'secret:name', 'secret:literal', CASE WHEN shape THEN 'secret:value' END, 'mandatory:fio:source', 'source_path:doc:keep',
  CASE WHEN art AND (NOT lic OR art_first) THEN 'dictionary:ART' WHEN lic THEN 'dictionary:LIC' END, CASE WHEN art AND lic THEN CASE WHEN art_first THEN 'dictionary:LIC' ELSE 'dictionary:ART' END END,
  CASE WHEN con THEN 'dictionary:CON' END, CASE WHEN mail THEN 'regex:EMAIL' END, CASE WHEN card THEN 'regex:CARD' END], lambda x: x IS NOT NULL)[1:6] AS codes FROM f)
SELECT doc_id, unnest(range(len(codes)))::INT AS idx, unnest(codes) AS code FROM c
""")
def cascade_reason_table(spark, sf_dir):
    """Each document's table of reasons, six at most, by first sight."""
    entries, _ = cascade.reason_table(_done(spark, sf_dir), 6)
    return entries.select("doc_id", "idx", "code")


_NEW_RULES = [(*r[:3], "keep", *r[4:]) if r[0] == 5 else r for r in _RULES if r[0] != 7]


@query(f"""
WITH {_DOCS},
s AS (SELECT doc_id, contains(text, 'license') AS lic, contains(text, 'there') AS new_word, lang FROM two),
c AS (SELECT *, unnest(['text', 'note', 'mail', 'lang', 'old', 'gone']) AS f FROM s)
SELECT doc_id, '/' || f AS ptr,
 CASE f WHEN 'text' THEN 'masked' WHEN 'note' THEN CASE WHEN lic THEN 'masked' ELSE 'open' END WHEN 'mail' THEN 'masked' WHEN 'lang' THEN CASE WHEN lang IS NULL THEN 'open' ELSE 'masked' END WHEN 'old' THEN 'masked' END AS before,
 CASE f WHEN 'text' THEN 'masked' WHEN 'note' THEN CASE WHEN new_word THEN 'masked' ELSE 'open' END WHEN 'mail' THEN 'open' WHEN 'lang' THEN 'open' WHEN 'old' THEN 'masked' END AS after,
 CASE f WHEN 'text' THEN 'same' WHEN 'note' THEN CASE WHEN lic = new_word THEN 'same' WHEN lic THEN 'became_open' ELSE 'became_masked' END WHEN 'mail' THEN 'became_open' WHEN 'lang' THEN CASE WHEN lang IS NULL THEN 'same' ELSE 'became_open' END WHEN 'old' THEN 'same' ELSE 'unevaluable' END AS change,
 CASE f WHEN 'text' THEN 'mandatory:fio:text' WHEN 'note' THEN CASE WHEN new_word THEN 'dictionary:ADV' END WHEN 'lang' THEN CASE WHEN lang IS NOT NULL THEN 'type:lang:keep' END WHEN 'old' THEN 'mandatory:fio:name' END AS reason
FROM c
""")
def dry_run_policies(spark, sf_dir):
    """A candidate with another dictionary, without one pattern, and with a
    rule that keeps what was masked; nothing else differs."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    words = F.concat_ws(" ", F.when(F.contains("text", F.lit("license")), "license"), F.when(F.contains("text", F.lit("there")), "there"), F.lit("-"))
    name = X.mask_token(F.lit("FIO"), F.concat(F.lit("Автор "), "doc_id"))
    cell = lambda f, v: F.struct(F.lit(f"/{f}").alias("ptr"), F.lit(f).alias("field"), v.alias("value"))
    stored = d.select("doc_id", F.inline(F.array(cell("text", F.lit("Иванов Иван")), cell("note", words), cell("mail", F.concat(F.lit("u"), "doc_id", F.lit("@example.org"))), cell("lang", F.col("lang")), cell("old", name), cell("gone", F.lit(f"was {X.REMOVED}")))))
    known = d.select(name.alias("token"), F.concat(F.lit("Автор "), "doc_id").alias("value"))
    lineage = inline(spark, _LINEAGE).union(spark.createDataFrame([("old", "Catalog.Doc.ФИО", None, None)], "column string, source_path string, source_type string, secret_cut boolean"))
    live = cascade.Policy(spark.createDataFrame(_RULES, cascade.RULES), {"license": "LIC"})
    new = cascade.Policy(spark.createDataFrame(_NEW_RULES, cascade.RULES), {"there": "ADV"})
    return lifecycle.dry_run(stored, known, policy.evidence(inline(spark, _COLUMNS), lineage), live, new)


# --- reports ----------------------------------------------------------------------


def _results(spark, sf_dir):
    """A result of each document: a text, a table of two rows, and a table as
    structured content; and a result that is one text, for each tenth."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    rows = F.array(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("Text"))), F.to_json(F.struct(F.struct(F.col("source").alias("name"), F.array(F.lit(1), F.col("n_chars")).alias("x")).alias("extra"), F.col("doc_id").cast("string").alias("ID"))))
    body = F.concat(F.lit('{"content":[{"type":"text","text":'), F.substring(F.to_json(F.struct(F.col("lang").alias("v"))), F.lit(6), F.length(F.to_json(F.struct(F.col("lang").alias("v")))) - 6), F.lit('},{"type":"image"},{"type":"json","json":{"rows":['), F.array_join(rows, ","), F.lit(']}}],"structured_content":[{"n":'), F.col("n_chars").cast("string"), F.lit("}]}"))
    return d.select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.lit('{"data":[]}')).otherwise(body).alias("json"))


_RESULT_DOCS = "(SELECT doc_id, text, lang, source, n_chars, doc_id % 10 = 3 AS bare FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)"
_SCHEMA_OF = lambda results: results.select("doc_id", F.inline(F.array(F.struct(F.lit(1).alias("pos"), F.lit("text").alias("name")), F.struct(F.lit(2).alias("pos"), F.lit("Id").alias("name")))))


@query(f"""
WITH p AS (SELECT doc_id, unnest(['/content/0/text', '/content/0/type', '/content/1/type', '/content/2/type', '/content/2/json/rows/0/id', '/content/2/json/rows/0/Text', '/content/2/json/rows/1/extra/name', '/content/2/json/rows/1/extra/x/0', '/content/2/json/rows/1/extra/x/1', '/content/2/json/rows/1/ID', '/structured_content/0/n']) AS ptr,
 unnest([0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 2]) AS block, unnest([NULL, NULL, NULL, NULL, 0, 0, 1, 1, 1, 1, 0]) AS "row", unnest([NULL, NULL, NULL, NULL, 1, 0, 2, 2, 2, 1, 2]) AS col FROM {_RESULT_DOCS} WHERE NOT bare)
SELECT doc_id, ptr, block::INT AS block, "row"::INT AS "row", col::INT AS col FROM p
""")
def report_coordinates(spark, sf_dir):
    """Block, row and column of every leaf of a result."""
    results = _results(spark, sf_dir)
    return blocks.result_coordinates(masking.walk_json(results), results, _SCHEMA_OF(results))


@query(f"""
SELECT doc_id, unnest(CASE WHEN bare THEN [0] ELSE [0, 1, 2] END)::INT AS block, unnest(CASE WHEN bare THEN ['text'] ELSE ['text', 'table', 'table'] END) AS kind, unnest(CASE WHEN bare THEN ['{{"data":[]}}'] ELSE [lang, NULL, NULL] END) AS text FROM {_RESULT_DOCS}
""")
def report_blocks(spark, sf_dir):
    return blocks.result_blocks(_results(spark, sf_dir)).select("doc_id", "block", "kind", "text")


@query(f"""
SELECT doc_id, unnest([1, 1, 1, 2, 2, 2])::INT AS block, unnest([0, 1, 2, 0, 1, 2])::INT AS col, unnest(['Text', 'id', 'extra', 'text', 'Id', 'n']) AS id, unnest(['string', 'mixed', 'string', 'null', 'null', 'number']) AS type FROM {_RESULT_DOCS} WHERE NOT bare
""")
def report_table_columns(spark, sf_dir):
    results = _results(spark, sf_dir)
    return blocks.table_columns(blocks.table_cells(blocks.result_blocks(results)), _SCHEMA_OF(results)).select("doc_id", "block", "col", "id", "type")


@query(f"""
SELECT doc_id, unnest([1, 1, 1, 1, 2])::INT AS block, unnest([0, 0, 1, 1, 0])::INT AS "row", unnest(['Text', 'id', 'ID', 'extra', 'n']) AS key, unnest([text, doc_id::VARCHAR, doc_id::VARCHAR, source, n_chars::VARCHAR]) AS value FROM {_RESULT_DOCS} WHERE NOT bare
""")
def report_table_cells(spark, sf_dir):
    return blocks.table_cells(blocks.result_blocks(_results(spark, sf_dir))).select("doc_id", "block", "row", "key", "value")


# --- the token store as a stream ------------------------------------------------

_CALLS = "(SELECT 'd' || (user_id % 10)::VARCHAR AS database, ts AS tm, event_id AS seq, 'b' || event_id::VARCHAR AS batch, CASE WHEN event_id % 3 = 0 THEN 'resolve' ELSE 'publish' END AS kind, 't' || (event_id * 7919 % 37)::VARCHAR AS token, event_type AS value FROM events WHERE ts IS NOT NULL)"


def _calls(spark, sf_dir, where: str = "true"):
    e = state.event_stream(spark, sf_dir)
    kind = F.when(F.col("event_id") % 3 == 0, "resolve").otherwise("publish")
    token = F.concat(F.lit("t"), (F.col("event_id") * 7919 % 37).cast("string"))
    own = e.where("ts is not null").select(F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string")).alias("database"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("batch"), kind.alias("kind"), token.alias("token"), F.col("event_type").alias("value"))
    return own.where(where)


@query(f"""
WITH c AS (SELECT * FROM {_CALLS}), due AS (SELECT * FROM c WHERE epoch_ms(tm) <= (SELECT epoch_ms(max(tm)) FROM c) - 3600000),
p AS (SELECT *, lag(epoch_ms(tm)) OVER (PARTITION BY database, token ORDER BY epoch_ms(tm), seq) AS was FROM due WHERE kind = 'publish')
SELECT database, seq, CASE WHEN was IS NULL OR was + 86400000 <= epoch_ms(tm) THEN 'live again' ELSE 'reused' END AS status FROM p
UNION ALL SELECT r.database, r.seq, CASE WHEN EXISTS (SELECT 1 FROM due x WHERE x.kind = 'publish' AND x.database = r.database AND x.token = r.token AND (epoch_ms(x.tm), x.seq) < (epoch_ms(r.tm), r.seq) AND epoch_ms(x.tm) + 86400000 > epoch_ms(r.tm)) THEN 'resolved' ELSE 'unknown' END FROM due r WHERE r.kind = 'resolve'
""")
def streaming_token_reads(spark, sf_dir):
    """Tokens live for a day after they were last published; a token that is
    new and one that has expired both get a new life."""
    rows = state.drained(token_calls(_calls(spark, sf_dir), 1000, 86_400), "token_reads")
    return rows.select("database", "seq", F.when(F.col("status").isin("new", "replaced"), "live again").otherwise(F.col("status")).alias("status"))


@query(f"""
WITH c AS (SELECT database, epoch_ms(tm) AS tm, seq, token FROM {_CALLS} WHERE kind = 'publish'), due AS (SELECT *, row_number() OVER (PARTITION BY database ORDER BY tm, seq) AS n FROM c WHERE tm <= (SELECT max(tm) FROM c) - 3600000),
p AS (SELECT *, lag(n) OVER (PARTITION BY database, token ORDER BY n) AS was, lag(tm) OVER (PARTITION BY database, token ORDER BY n) AS was_at FROM due),
d AS (SELECT p.*, (SELECT count(DISTINCT x.token) FROM due x WHERE x.database = p.database AND x.n > p.was AND x.n < p.n) AS between_ FROM p)
SELECT database, seq, CASE WHEN was IS NOT NULL AND between_ < 8 AND was_at + 864000000 > tm THEN 'reused' ELSE 'new' END AS status FROM d
""")
def streaming_token_eviction(spark, sf_dir):
    """Eight tokens a database: one is still there if fewer than eight others
    were published since, which is what least recently used means."""
    rows = state.drained(token_calls(_calls(spark, sf_dir, "kind = 'publish'"), 8, 864_000), "token_eviction").where("status <> 'evicted'")
    return rows.select("database", "seq", F.when(F.col("status") == "replaced", "new").otherwise(F.col("status")).alias("status"))


# --- ingestion --------------------------------------------------------------------


def _ingested(spark, sf_dir):
    e = state.event_stream(spark, sf_dir)
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    calls = e.select(text("c", F.col("event_id") % 700).alias("call_id"), text("d", F.col("user_id") % 3).alias("database"), F.col("event_type").alias("tool"), text("x", F.col("event_id") % 2).alias("code"), F.when(F.col("event_id") % 3 == 0, "finalize").otherwise("terminal").alias("kind"), F.col("event_id").alias("seq"))
    job = ingest.Ingestion(spark, ingest.TABLES)
    job.run(calls)
    return job


_INGEST = "(SELECT 'c' || (event_id % 700)::VARCHAR AS call_id, 'd' || (user_id % 3)::VARCHAR AS database, event_type AS tool, 'x' || (event_id % 2)::VARCHAR AS code, CASE WHEN event_id % 3 = 0 THEN 'finalize' ELSE 'terminal' END AS kind, event_id AS seq FROM events)"


@query(f"SELECT call_id, database, tool, seq FROM {_INGEST} WHERE kind = 'finalize' QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY seq) = 1")
def streaming_ingested_history(spark, sf_dir):
    return _ingested(spark, sf_dir).read("history")


@query(f"""
WITH t AS (SELECT *, first_value(seq) OVER w AS s, first_value(tool) OVER w AS t, first_value(code) OVER w AS c FROM {_INGEST} WHERE kind = 'terminal' WINDOW w AS (PARTITION BY call_id ORDER BY seq))
SELECT call_id, tool, code, seq, CASE WHEN s = seq THEN 'inserted' WHEN t = tool AND c = code THEN 'existing' ELSE 'conflict' END AS status FROM t
""")
def streaming_ingested_terminals(spark, sf_dir):
    return _ingested(spark, sf_dir).read("terminals")


# --- answers, tools, deletion, lists ----------------------------------------------


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN '{"a":' || o_custkey::VARCHAR || ',"success":true}' WHEN 1 THEN '{"k":' || o_custkey::VARCHAR || '}' WHEN 2 THEN '{"t":' || o_custkey::VARCHAR || '}' WHEN 4 THEN '{"success":false,"x":' || o_custkey::VARCHAR || '}' END AS body FROM orders
""")
def envelope_bodies(spark, sf_dir):
    """Structured content, JSON and text items, text that is no JSON, a bare
    answer, one that says nothing, and bad JSON."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    answers = F.array(
        F.concat(F.lit('{"structured_content":{"success":true,"a":'), k, F.lit('},"content":[{"type":"text","text":"{}"}]}')), F.concat(F.lit('{"structured_content":1,"content":[{"type":"json","json":{"k":'), k, F.lit("}}]}")),
        F.concat(F.lit('{"content":[{"type":"text","text":"{\\"t\\":'), k, F.lit('}"}]}')), F.lit('{"content":[{"type":"text","text":"no"}],"success":true}'), F.concat(F.lit('{"x":'), k, F.lit(',"success":false}')), F.lit('{"content":[]}'), F.lit("{bad"),
    )
    return o.select(F.col("o_orderkey").alias("id"), json.envelope_body(F.get(answers, (F.col("o_orderkey") % 7).cast("int"))).alias("body"))


@query("""
WITH l AS (SELECT 't' || o_orderkey::VARCHAR AS tool, o_custkey % 2 AS m FROM orders WHERE o_orderkey % 3 <> 0), w AS (SELECT 't' || o_orderkey::VARCHAR AS tool, o_custkey % 3 AS m FROM orders WHERE o_orderkey % 5 <> 0)
SELECT tool, before, after, CASE WHEN after IS NULL THEN 'neutral' WHEN after = 'no-mask' OR before = 'deny-pending-review' THEN 'weakening' ELSE 'strengthening' END AS class FROM (
 SELECT coalesce(w.tool, l.tool) AS tool, coalesce(CASE l.m WHEN 0 THEN 'no-mask' WHEN 1 THEN 'data-mask' END, 'deny-pending-review') AS before, CASE w.m WHEN 0 THEN 'no-mask' WHEN 1 THEN 'data-mask' WHEN 2 THEN 'deny-pending-review' END AS after FROM w FULL JOIN l ON l.tool = w.tool) WHERE after IS NULL OR before <> after
""")
def tool_removals(spark, sf_dir):
    """An imported file names all tools; the others lose their entries."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tool")
    live = o.where("o_orderkey % 3 <> 0").select(name, F.when(F.col("o_custkey") % 2 == 0, "no-mask").otherwise("data-mask").alias("mode"))
    wanted = o.where("o_orderkey % 5 <> 0").select(name, F.when(F.col("o_custkey") % 3 == 0, "no-mask").when(F.col("o_custkey") % 3 == 1, "data-mask").otherwise("deny-pending-review").alias("mode"))
    return governance.tool_diff(live, wanted, imported=True)


@query("""
SELECT 'audit' AS name, action, database, user_id FROM (SELECT 'call' AS action, 'd' || (c_nationkey % 4)::VARCHAR AS database, c_custkey AS user_id FROM customer UNION ALL SELECT 'access.revoke', 'd1', c_custkey FROM customer WHERE c_nationkey % 4 = 1)
UNION ALL SELECT 'grants', NULL, 'd' || (c_nationkey % 4)::VARCHAR, c_custkey FROM customer WHERE c_nationkey % 4 <> 1
""")
def cascade_revokes(spark, sf_dir):
    """A database that goes takes its grants, each of which leaves an event."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), (F.col("c_nationkey") % 4).cast("string")).alias("database"), F.col("c_custkey").alias("user_id"))
    left = lifecycle.cascade({"audit": c.select(F.lit("call").alias("action"), "database", "user_id"), "grants": c}, "d1", grants="grants", at="2024-03-01 00:00:00")
    none = F.lit(None).cast("string")
    return left["audit"].select(F.lit("audit").alias("name"), "action", "database", "user_id").unionByName(left["grants"].select(F.lit("grants").alias("name"), none.alias("action"), "database", "user_id"))


@query("SELECT (row_number() OVER (ORDER BY label, database))::INT AS place, database, label FROM (SELECT 'd' || c_custkey::VARCHAR AS database, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'd' || c_custkey::VARCHAR) AS label FROM customer WHERE c_acctbal > 0)")
def databases_by_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return report.databases_by_label(c.select(F.concat(F.lit("d"), "c_custkey").alias("database"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("label")))


# --- dictionaries beyond the driver -----------------------------------------------

_ITEM_KIND = "'C' || (length(b.text) % 4)::VARCHAR"


@query(f"SELECT d.doc_id, (instr(d.text, b.text) - 1)::INT AS first, b.text AS value, {_ITEM_KIND} AS category FROM documents d JOIN (SELECT DISTINCT text FROM benchmark WHERE text <> '') b ON contains(d.text, b.text)")
def routed_dictionary_hits(spark, sf_dir):
    """The benchmark's texts as a dictionary that is never on the driver; the
    first place of each value in each document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("text").alias("value"), F.concat(F.lit("C"), (F.length("text") % 4).cast("string")).alias("category"))
    found = routing.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), items, 1 << 14)
    return found.groupBy("doc_id", "value", "category").agg(F.min("start").alias("first")).select("doc_id", "first", "value", "category")
