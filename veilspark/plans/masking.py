"""Queries over masking kernels, policies, dictionaries and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters
from ..functions import text as X
from ..operators import dictionary, mapping, masking, policy
from .registry import inline, over, per, query, table, values

#: HMAC pads of the test key, for the SQL form.
_INNER, _OUTER = (bytes(b ^ p for b in X.KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))


def token_sql(kind: str, value: str, database: str = "'db'") -> str:
    """DuckDB text of functions.text.mask_token for a clean category."""
    message = f"encode({database} || chr(31) || {kind} || chr(31) || {value})"
    digest = f"sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || {message})))"
    return f"('[MASK:v1:' || {kind} || ':' || translate(to_base64(from_hex(substr({digest}, 1, 48))), '+/', '-_') || ']')"


def replace_sql(text: str, pattern: str, kind: str) -> str:
    """DuckDB text of functions.text.replace_matches with tokens."""
    p = "(" + pattern.replace("'", "''") + ")"
    pieces = f"list_transform(list_zip(string_split_regex({text}, '{p}'), list_append(list_transform(regexp_extract_all({text}, '{p}', 1), lambda m: {token_sql(kind, 'm')}), '')), lambda z: z[1] || z[2])"
    return f"array_to_string({pieces}, '')"


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
CARD = r"[0-9]{16}"


@query(f"SELECT doc_id, {replace_sql('t2', CARD, chr(39) + 'CARD' + chr(39))} AS masked FROM (SELECT doc_id, {replace_sql('t1', PHONE, chr(39) + 'PHONE' + chr(39))} AS t2 FROM (SELECT doc_id, {replace_sql('text', EMAIL, chr(39) + 'EMAIL' + chr(39))} AS t1 FROM documents))")
def mask_documents_regex(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("masked"))
    for pattern, kind, holds in ((EMAIL, "EMAIL", "@"), (PHONE, "PHONE", "+1 ("), (CARD, "CARD", None)):
        # one projection a rule: an expression of all would repeat its parts
        docs = docs.withColumn("masked", X.mask_matches(F.col("masked"), pattern, kind, holds))
    return docs


@query(f"SELECT c_custkey, upper(c_mktsegment) AS category, {token_sql('upper(c_mktsegment)', 'c_name')} AS token, TRUE AS valid FROM customer")
def mask_token_grammar(spark, sf_dir):
    token = X.mask_token(F.col("c_mktsegment"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.category(F.col("c_mktsegment")).alias("category"), token.alias("token"), token.rlike(f"^{X.TOKEN}$").alias("valid"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i){X.SECRET_VALUE}', '{X.REMOVED}', 'g'), '(?i){X.SECRET_ASSIGNMENT.replace(chr(39), chr(39) * 2)}', '{X.REMOVED}', 'g') AS text FROM documents")
def secret_assignment_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cut_assignments(X.cut_secret_values(F.col("text"))).alias("text"))


_NAMES = over("customer", "c_custkey", "name", [(n,) for n in ("password", "user_password", "userPassword", "api-key", "apiKey", "Токен", "мой_токен", "секретарь", "ключ", "ключица", "access.token", "refresh_key", "key", "Authorization", "monkey", "токенизация", "Пароль_2", "пароли", "secret", "secretary")])
_MARKERS = " OR ".join(f"contains(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '{m}')" for m in X.COMPACT_MARKERS)


@query(f"SELECT name, regexp_matches(name, '(?i){X.SECRET_NAME}') AS bounded, ({_MARKERS}) AS compact FROM {_NAMES}")
def secret_field_names(spark, sf_dir):
    return inline(spark, _NAMES, sf_dir).select("name", X.secret_name(F.col("name")).alias("bounded"), X.compact_secret_name(F.col("name")).alias("compact"))


@query("SELECT event_id AS doc_id, '/' || k AS ptr, k AS field, 'number' AS kind, props::JSON ->> k AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_walk_leaves(spark, sf_dir):
    return masking.walk_json(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json")))


_RULES = values("pos, selector, pattern, action, category, priority", [
    (1, "name", "*name*", "mask", "NAME", 1), (2, "name", "c_name", "keep", "NAME", 9), (3, "name", "*bal*", "mask", "MONEY", 5), (4, "source_path", "Catalog.customer.*", "keep", "X", 1),
    (5, "source_path", "*customer.c_name*", "mask", "CLIENT", 2), (6, "type", "*", "keep", "ANY", 0), (7, "name", "*acct*", "mask", "ACCOUNT", 5), (8, "name", "c_phone", "secret", "PHONE", 1),
])
_FIELDS = values("field, selector, value", [
    (f, s, v)
    for f, path, kind in (("c_custkey", "Catalog.customer.c_custkey", "bigint"), ("c_name", "Catalog.customer.c_name", "string"), ("c_acctbal", "Catalog.customer.c_acctbal", "double"), ("c_mktsegment", "Catalog.customer.c_mktsegment", "string"), ("s_name", "Catalog.supplier.s_name", "string"), ("c_phone", "Catalog.customer.c_phone", "string"))
    for s, v in (("name", f), ("source_path", path), ("type", kind))
])
_MATCH = "(lower(pattern) = '*' OR (length(pattern) > 1 AND starts_with(pattern, '*') AND ends_with(pattern, '*') AND contains(lower(value), substr(lower(pattern), 2, length(pattern) - 2))) OR lower(pattern) = lower(value))"
_RANK = "CASE action WHEN 'secret' THEN 3 WHEN 'mask' THEN 2 ELSE 1 END"
_STRONGEST = f"SELECT field, f.selector AS selector, pos, action, category FROM {_FIELDS} f JOIN {_RULES} r ON f.selector = r.selector AND {_MATCH} QUALIFY row_number() OVER (PARTITION BY field, f.selector ORDER BY {_RANK} DESC, priority DESC, pos DESC) = 1"


@query(_STRONGEST)
def strongest_rule_per_field(spark, sf_dir):
    return policy.strongest_rules(inline(spark, _FIELDS), inline(spark, _RULES))


_STRUCTURAL = f"SELECT field, arg_min(action, o) AS action, arg_min(category, o) AS category FROM (SELECT *, CASE WHEN action = 'secret' THEN 0 WHEN selector = 'source_path' THEN 1 WHEN selector = 'name' THEN 2 ELSE 3 END AS o FROM ({_STRONGEST})) GROUP BY field"


@query(_STRUCTURAL)
def structural_decision(spark, sf_dir):
    return policy.structural_action(policy.strongest_rules(inline(spark, _FIELDS), inline(spark, _RULES)))


@query(f"""
SELECT c_custkey AS doc_id, '/' || field AS ptr, field,
       CASE WHEN action = 'mask' THEN {token_sql('category', 'value')} ELSE value END AS value
FROM (SELECT c_custkey, unnest(['c_name', 'c_mktsegment']) AS field, unnest([c_name, c_mktsegment]) AS value FROM customer) c LEFT JOIN ({_STRUCTURAL}) d USING (field)
""")
def structural_mask_customer(spark, sf_dir):
    decided = policy.structural_action(policy.strongest_rules(inline(spark, _FIELDS), inline(spark, _RULES)))
    cells = masking.unpivot(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"]).join(F.broadcast(decided), "field", "left")
    return cells.select("doc_id", "ptr", "field", masking.mask_cell(F.col("field"), F.col("value"), F.col("action"), F.col("category")).alias("value"))


@query(f"""
SELECT p_partkey AS doc_id, '/' || field AS ptr,
       CASE WHEN field = 'access_key' THEN '{X.REMOVED}' WHEN field = 'note' THEN '{X.REMOVED}' WHEN field = 'full_name' THEN {token_sql("'FIO'", 'value')} ELSE {replace_sql('value', '[0-9]+', "'NUM'")} END AS value
FROM (SELECT p_partkey, unnest(['access_key', 'full_name', 'p_type', 'note']) AS field, unnest([p_name, p_name, p_brand, 'bearer abcdefgh123' || p_size::VARCHAR]) AS value FROM part)
""")
def mask_cells_unpivot(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("access_key"), F.col("p_name").alias("full_name"), F.col("p_brand").alias("p_type"), F.concat(F.lit("bearer abcdefgh123"), F.col("p_size").cast("string")).alias("note"))
    cells = masking.unpivot(part, "p_partkey", ["access_key", "full_name", "p_type", "note"])
    none = F.lit(None).cast("string")
    return cells.select("doc_id", "ptr", masking.mask_cell(F.col("field"), F.col("value"), none, none, [("[0-9]+", "NUM", "mask")]).alias("value"))


_TWO_OR_THREE_NAMES = r"[А-ЯЁ][а-яё]{2,}(?:\s+[А-ЯЁ][а-яё]{2,}){1,2}"
_PERSONS = over("customer", "c_custkey", "id, text", [(1, "Договор: Иванов Иван Иванович и Петрова Анна."), (2, "no names here"), (3, "Ёлкин Пётр, Кузнецов Олег"), (4, "Москва"), (5, "Иванов Иван Иванов Иван")], id="c_custkey", text="v.text || ' ' || c_name")


@query(f"SELECT id, {replace_sql('text', _TWO_OR_THREE_NAMES, chr(39) + 'FIO' + chr(39))} AS text FROM {_PERSONS}")
def person_names_masked(spark, sf_dir):
    return inline(spark, _PERSONS, sf_dir).select("id", X.mask_matches(F.col("text"), X.PERSON_VALUE, "FIO").alias("text"))


_COLUMNS = over("orders", "o_orderkey", "name, type, unverified", [("Name", "string", None), ("name", "String(50)", None), ("Sum", "number", True), ("Ref", "CatalogRef", None)], name="v.name || (o_custkey % 50)::STRING")
_LINEAGE = over("orders", "o_orderkey", "col, source_path, source_type, secret_cut", [("NAME", "Catalog.A.Name", "string", None), ("sum", "Register.B.Sum", None, None), ("Name", "Catalog.C.Name", None, True), ("extra", "Catalog.D", "x", False)], col="v.col || (o_custkey % 50)::STRING")


@query(f"""
SELECT lower(n) AS field, coalesce(array_to_string(list_sort(list_distinct(list(p) FILTER (WHERE p IS NOT NULL))), ','), '') AS source_paths, coalesce(array_to_string(list_sort(list_distinct(list(t) FILTER (WHERE t IS NOT NULL))), ','), '') AS field_types, bool_or(c) AS secret_cut, bool_or(u) AS unverified
FROM (SELECT name AS n, NULL AS p, type AS t, FALSE AS c, coalesce(unverified, FALSE) AS u FROM {_COLUMNS} UNION ALL SELECT col, source_path, source_type, coalesce(secret_cut, FALSE), FALSE FROM {_LINEAGE}) GROUP BY 1
""")
def evidence_by_column(spark, sf_dir):
    found = policy.evidence(inline(spark, _COLUMNS, sf_dir), inline(spark, _LINEAGE, sf_dir).withColumnRenamed("col", "column"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("source_paths", "field_types")})


@query("""
SELECT doc_id, 1::BIGINT AS depth, 2::BIGINT AS cells, (strlen(text) + strlen(source))::BIGINT AS bytes, strlen(text) + strlen(source) <= 5000 AS ok FROM documents
""")
def bounds_check(spark, sf_dir):
    return masking.bounds(masking.unpivot(table(spark, sf_dir, "documents"), "doc_id", ["text", "source"]), 64, 200_000, 5000)


_DOCS = per("orders", "o_orderkey", "doc_id", 6, "doc_id, json", values("doc_id, json", [(1, '{"a":{"Script":[1,2]},"b":"x"}'), (2, '[{"c~/d":null},{"c":true}]'), (3, '{"html":"<b>"}'), (4, '{"n":1.5,"s":"ok","deep":{"x":{"y":["z"]}}}'), (5, "{bad"), (6, '"top"')]))
_LEAVES = "SELECT o_orderkey AS doc_id, ptr, field, kind, value FROM orders JOIN (VALUES (1, '/a/Script/0', 'Script', 'number', '1'), (1, '/a/Script/1', 'Script', 'number', '2'), (1, '/b', 'b', 'string', 'x'), (2, '/0/c~0~1d', 'c~/d', 'null', 'null'), (2, '/1/c', 'c', 'boolean', 'true'), (3, '/html', 'html', 'string', '<b>'), (4, '/n', 'n', 'number', '1.5'), (4, '/s', 's', 'string', 'ok'), (4, '/deep/x/y/0', 'y', 'string', 'z'), (6, '', '', 'string', 'top')) AS v(id, ptr, field, kind, value) ON id = 1 + o_orderkey % 6"


@query(f"SELECT doc_id::BIGINT AS doc_id, ptr, field, kind, value FROM ({_LEAVES})")
def json_walk_nested(spark, sf_dir):
    return masking.walk_json(inline(spark, _DOCS, sf_dir))


@query(f"SELECT doc_id::BIGINT AS doc_id, bool_or(list_has_any(string_split(lower(ptr), '/'), ['binary', 'html', 'script', 'formatter'])) AS unsafe FROM ({_LEAVES}) GROUP BY doc_id")
def unsafe_shape_reject(spark, sf_dir):
    return masking.unsafe_documents(masking.walk_json(inline(spark, _DOCS, sf_dir)))


@query("SELECT d.doc_id, b.item_id, 'C' || (b.item_id % 4)::VARCHAR AS category FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def dictionary_hits(spark, sf_dir):
    values_ = table(spark, sf_dir, "benchmark").select(F.col("text").alias("value"), F.concat(F.lit("C"), (F.col("item_id") % 4).cast("string")).alias("category"), "item_id")
    found = dictionary.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), values_.drop("item_id"))
    return found.join(values_.drop("category"), "value").select("doc_id", "item_id", "category")


_ACTIONS = values("category, action, priority, pos", [("C0", "keep", 1, 1), ("C0", "mask", 1, 2), ("C1", "keep", 5, 3), ("C2", "secret", 0, 4), ("C2", "mask", 9, 5)])


@query(f"""
SELECT 'C' || (item_id % 4)::VARCHAR AS category, item_id, coalesce(action, 'mask') AS action FROM benchmark LEFT JOIN
 (SELECT category AS k, action FROM {_ACTIONS} QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_RANK} DESC, priority DESC, pos DESC) = 1) ON k = 'C' || (item_id % 4)::VARCHAR
""")
def dictionary_category_action(spark, sf_dir):
    rules = inline(spark, _ACTIONS).select("pos", F.lit("dictionary").alias("selector"), F.col("category").alias("pattern"), "action", "category", "priority")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("C"), (F.col("item_id") % 4).cast("string")).alias("category"))
    return items.join(dictionary.action_of(items, rules), "category").select("category", "item_id", "action")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list('dictionary:C' || (item_id % 4)::VARCHAR || ':keep'))), ',') AS reasons, count(*) AS n_values FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id")
def dictionary_keep_reasons(spark, sf_dir):
    found = dictionary_hits(spark, sf_dir)
    reason = F.concat(F.lit("dictionary:"), "category", F.lit(":keep"))
    return found.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(reason)), ",").alias("reasons"), F.count("*").alias("n_values"))


_WORDS = {"then": "ADV", "the": "ART", "there": "ADV", "and": "CON", "with": "PRE", "from": "PRE"}
_KIND = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORDS.items()) + " END"
_LONGEST = "|".join(sorted(_WORDS, key=lambda v: (-len(v), v)))


@query(f"SELECT conv_id, turn, {replace_sql('text', _LONGEST, _KIND)} AS text FROM conversations")
def dictionary_replace_longest(spark, sf_dir):
    return dictionary.replace_values(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _WORDS)


@query(f"SELECT conv_id, turn, {replace_sql('text', _LONGEST, _KIND)} AS text FROM conversations")
def automaton_mask_conversations(spark, sf_dir):
    return dictionary.replace_values(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _WORDS, "text", native=0)


def benchmark_values(spark, sf_dir):
    """The benchmark's texts and their words of 4 letters or more, with categories."""
    texts = table(spark, sf_dir, "benchmark").where("text <> ''").select("text")
    words = texts.select(F.explode(F.split("text", r"\s+")).alias("text")).where(F.length("text") >= 4)
    return {r["text"]: f"C{len(r['text']) % 4}" for r in texts.union(words).distinct().collect()}


@query()
def automaton_mask_documents(spark, sf_dir):
    return dictionary.replace_values(table(spark, sf_dir, "documents").select("doc_id", "text"), benchmark_values(spark, sf_dir))


def _feed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("pos"), F.concat(F.lit("Catalog."), "p_brand").alias("source_path"), F.concat(F.lit("K"), (F.col("p_size") % 7).cast("string")).alias("category"), F.col("p_type").alias("value"))


_FEED = "(SELECT p_partkey AS pos, 'Catalog.' || p_brand AS source_path, 'K' || (p_size % 7)::VARCHAR AS category, p_type AS value FROM part)"


@query(f'SELECT source_path, arg_min(category, pos) AS category, count(*) AS "values", sum(strlen(value))::BIGINT AS bytes FROM {_FEED} GROUP BY 1')
def dictionary_source_stats(spark, sf_dir):
    return dictionary.source_stats(_feed(spark, sf_dir))


@query(f"SELECT category, arg_min(source_path, pos) AS source_path FROM {_FEED} GROUP BY 1")
def dictionary_first_source(spark, sf_dir):
    return dictionary.first_source(_feed(spark, sf_dir))


@query(f"SELECT value, arg_max(category, pos) AS category FROM {_FEED} GROUP BY 1")
def dictionary_last_wins(spark, sf_dir):
    return dictionary.last_wins(_feed(spark, sf_dir))


@query(f"SELECT bit_xor(('0x' || substr(md5(value || chr(31) || category), 1, 15))::BIGINT) AS fingerprint, count(*) AS n_values FROM (SELECT value, arg_max(category, pos) AS category FROM {_FEED} GROUP BY 1)")
def dictionary_fingerprint(spark, sf_dir):
    return dictionary.fingerprint(dictionary.last_wins(_feed(spark, sf_dir)))


@query(f'SELECT source_path, "values", greatest(1, ceil("values" / 20000.0))::BIGINT AS load_s, (bytes * 2 + "values" * 48)::BIGINT AS memory_bytes FROM (SELECT source_path, count(*) AS "values", sum(strlen(value))::BIGINT AS bytes FROM {_FEED} GROUP BY 1) WHERE "values" >= 10')
def source_large_warning(spark, sf_dir):
    return dictionary.large_sources(dictionary.source_stats(_feed(spark, sf_dir)), 10)


_FILTER = {"op": "and", "args": [{"op": "in", "field": "o_orderstatus", "values": ["F", "O"]}, {"op": "not", "arg": {"op": "eq", "field": "o_orderpriority", "value": "5-LOW"}}, {"op": "or", "args": [{"op": "ne", "field": "o_custkey", "value": 7}, {"op": "eq", "field": "o_orderkey", "value": 1}]}]}


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT o_orderpriority = '5-LOW' AND (o_custkey <> 7 OR o_orderkey = 1)")
def filter_ast_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(filters.compile_filter(_FILTER)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_MANIFEST = over("customer", "c_custkey", "source_path, field_name, field_type, password_mode", [
    ("Catalog.Person.Name", "Name", "String", False), ("Catalog.Person.Password", "Password", "String", True), ("Справочник.Фирма.Имя", "Имя", "Строка(50)", False), ("Register.Sales.Sum", "Sum", "Number", False),
    ("Catalog.Person.ApiKey", "ApiKey", "string", False), ("Catalog.Person.Age", "Age", "Number", False), ("Catalog.Item.Title", "Title", "String(10)", False), ("Catalog.Item.Parts.Code", "Code", "String", False),
], source_path="CASE WHEN c_custkey < 8 THEN v.source_path ELSE v.source_path || c_custkey::STRING END")
_ALLOW = values("selector, pattern", [("source_path", "Catalog.Person.Name"), ("source_path", "Catalog.Person.ApiKey"), ("source_path", "Справочник.Фирма.Имя"), ("source_path", "Catalog.Missing"), ("source_path", "*Nowhere*"), ("source_path", "*sales*"), ("name", "x")])
_SECRET_ITEM = _MARKERS.replace("name)", "field_name || ' ' || source_path)")


@query(f"SELECT source_path FROM {_MANIFEST} WHERE (starts_with(source_path, 'Catalog.') OR starts_with(source_path, 'Справочник.')) AND (contains(lower(field_type), 'string') OR contains(lower(field_type), 'строка')) AND NOT password_mode AND NOT ({_SECRET_ITEM}) AND source_path IN (SELECT pattern FROM {_ALLOW} WHERE NOT contains(pattern, '*') AND selector = 'source_path')")
def catalog_expansion(spark, sf_dir):
    path, kind = F.col("source_path"), F.lower("field_type")
    ok = (path.startswith("Catalog.") | path.startswith("Справочник.")) & (F.contains(kind, F.lit("string")) | F.contains(kind, F.lit("строка"))) & ~F.col("password_mode")
    ok &= ~X.compact_secret_name(F.concat_ws(" ", "field_name", "source_path"))
    allowed = inline(spark, _ALLOW).where("selector = 'source_path' and not contains(pattern, '*')").select(F.col("pattern").alias("source_path"))
    return inline(spark, _MANIFEST, sf_dir).where(ok).join(allowed, "source_path", "left_semi").select("source_path")


@query(f"SELECT selector, pattern FROM {_ALLOW} a WHERE selector = 'source_path' AND NOT EXISTS (SELECT 1 FROM (SELECT source_path AS value FROM {_MANIFEST}) m WHERE {_MATCH})")
def path_not_in_manifest(spark, sf_dir):
    return policy.missing_paths(inline(spark, _ALLOW), inline(spark, _MANIFEST, sf_dir)).select("selector", "pattern")


_PATTERNS = values("pattern", [(p,) for p in ("*", "*name*", "*NAM*", "first_name", "x", "**", "*a*b*", "*x*", "ab")])


@query(f"""
SELECT a.pattern AS wide, b.pattern AS narrow FROM {_PATTERNS} a, {_PATTERNS} b WHERE a.pattern <> b.pattern AND (a.pattern = '*' OR
 (length(a.pattern) > 2 AND starts_with(a.pattern, '*') AND ends_with(a.pattern, '*') AND b.pattern <> '*' AND contains(CASE WHEN length(b.pattern) > 2 AND starts_with(b.pattern, '*') AND ends_with(b.pattern, '*') THEN lower(substr(b.pattern, 2, length(b.pattern) - 2)) ELSE lower(b.pattern) END, lower(substr(a.pattern, 2, length(a.pattern) - 2)))))
""")
def pattern_coverage(spark, sf_dir):
    return policy.covering(inline(spark, _PATTERNS))


@query(f"SELECT pattern, regexp_full_match(pattern, '\\*|\\*[^*]+\\*|[^*]+') AS valid FROM {_PATTERNS}")
def pattern_validity(spark, sf_dir):
    return inline(spark, _PATTERNS).select("pattern", X.pattern_valid(F.col("pattern")).alias("valid"))


_TOKENS = f"(SELECT DISTINCT 'n' || c_nationkey::VARCHAR AS database, upper(c_mktsegment) AS category, c_name AS value, {token_sql('upper(c_mktsegment)', 'c_name', chr(39) + 'n' + chr(39) + ' || c_nationkey::VARCHAR')} AS token FROM customer)"


def _mapped(spark, sf_dir):
    return mapping.mappings(table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("database"), X.category(F.col("c_mktsegment")).alias("category"), F.col("c_name").alias("value")))


@query(f"SELECT * FROM {_TOKENS}")
def token_mapping_distinct(spark, sf_dir):
    return _mapped(spark, sf_dir)


@query("SELECT o_orderkey AS doc_id, c_custkey % 10 <> 0 AS ok, CASE WHEN c_custkey % 10 <> 0 THEN 'order of ' || c_name END AS text FROM orders JOIN customer ON o_custkey = c_custkey")
def token_resolve_roundtrip(spark, sf_dir):
    known = _mapped(spark, sf_dir)
    tokens = known.select("token", F.col("value").alias("c_name"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(tokens, "c_name")
    texts = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order of "), "token").alias("text"))
    gone = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_name").alias("value"))
    out = mapping.resolve(texts, known.join(gone, "value", "left_anti"))
    return out.select("doc_id", "ok", F.when(F.col("ok"), F.col("text")).alias("text"))


@query("SELECT 'u' || user_id::VARCHAR AS database, event_id::VARCHAR AS token, ts AS used FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) > 3")
def mapping_lru_eviction(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return mapping.evicted(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("database"), F.col("event_id").cast("string").alias("token"), F.col("ts").alias("used")), 3)


@query("SELECT event_id AS token, ts + INTERVAL 1 DAY AS expires_at FROM events WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY 2, 1 LIMIT 200")
def mapping_ttl_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("token"), F.expr("ts + interval 1 day").alias("expires_at"))
    return mapping.expired(e, "2024-01-10 00:00:00", 200)
