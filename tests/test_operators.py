"""Kernels against plain specifications and invariants."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import filters
from veilspark.functions import text as X
from veilspark.operators import dictionary, lifecycle, mapping, masking, policy, report, result
from veilspark.sources import pages
from veilspark.streaming import state


def test_token_has_the_grammar_and_is_keyed(spark):
    import hashlib
    import hmac
    from base64 import urlsafe_b64encode

    row = spark.range(1).select(X.mask_token(F.lit("phone number!"), F.lit("значение")).alias("a"), X.mask_token(F.lit("Х"), F.lit("v"), key=b"k" * 100).alias("b")).first()
    assert re.fullmatch(X.TOKEN, row["a"]) and row["a"].startswith("[MASK:v1:PHONENUMBER:") and row["b"].startswith("[MASK:v1:DATA:")
    digest = hmac.new(X.KEY, "db\x1fPHONENUMBER\x1fзначение".encode(), hashlib.sha256).digest()
    assert row["a"].split(":")[3][:-1] == urlsafe_b64encode(digest[:24]).decode()


def test_native_and_automaton_replacement_agree(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    values = {w: rng.choice(("A", "B")) for w in words}
    texts = spark.createDataFrame([(i, "".join(rng.choice("abc ") for _ in range(40))) for i in range(60)] + [(60, None), (61, "")], "id int, text string")
    native = {r["id"]: r["text"] for r in dictionary.replace_values(texts, values).collect()}
    automaton = {r["id"]: r["text"] for r in dictionary.replace_values(texts, values, "text", native=0).collect()}
    assert native == automaton


def test_automaton_masks_documents(spark, sf_dir):
    import hashlib
    import hmac
    from base64 import urlsafe_b64encode

    import __spark_entry__
    from veilspark.plans.masking import benchmark_values

    values = benchmark_values(spark, sf_dir)
    assert len(values) > dictionary.NATIVE_VALUES
    sizes = sorted({len(v) for v in values}, reverse=True)

    def masked(text):
        out, at = [], 0
        while at < len(text):
            n = next((n for n in sizes if text[at : at + n] in values and at + n <= len(text)), 0)
            if n:
                v = text[at : at + n]
                digest = hmac.new(X.KEY, f"db\x1f{values[v]}\x1f{v}".encode(), hashlib.sha256).digest()
                out.append(f"[MASK:v1:{values[v]}:{urlsafe_b64encode(digest[:24]).decode()}]")
            else:
                out.append(text[at])
            at += n or 1
        return "".join(out)

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in __spark_entry__.queries()["automaton_mask_documents"](spark, sf_dir).collect()}
    assert got == {i: None if t is None else masked(t) for i, t in docs.items()}


def test_resolve_is_the_inverse_of_mask(spark):
    people = spark.createDataFrame([("d", "NAME", f"value {i}") for i in range(20)], "database string, category string, value string")
    known = mapping.mappings(people)
    texts = known.select(F.monotonically_increasing_id().alias("doc_id"), F.concat(F.lit("x "), "token", F.lit(" y "), "token").alias("text"), "value")
    back = mapping.resolve(texts.select("doc_id", "text"), known).join(texts.select("doc_id", "value"), "doc_id").collect()
    assert len(back) == 20 and all(r["ok"] and r["text"] == f"x {r['value']} y {r['value']}" for r in back)
    unknown = spark.createDataFrame([(1, f"[MASK:v1:NAME:{'A' * 32}]"), (2, "plain"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["ok"] for r in mapping.resolve(unknown, known).collect()} == {1: False, 2: True, 3: True}


def test_cascade_order(spark):
    rows = [("password", "x", None, X.REMOVED), ("a", X.REMOVED, "mask", X.REMOVED), ("a", "bearer abcdefgh12 z", "mask", f"{X.REMOVED} z"), ("a", "v", "secret", X.REMOVED), ("a", "v", "keep", "v"), ("a", None, "mask", None)]
    df = spark.createDataFrame([(i, f, v, a) for i, (f, v, a, _) in enumerate(rows)], "i int, f string, v string, a string")
    got = {r["i"]: r["m"] for r in df.select("i", masking.mask_cell(F.col("f"), F.col("v"), F.col("a"), F.lit("K")).alias("m")).collect()}
    assert got == {i: e for i, (*_, e) in enumerate(rows)}
    kept = df.select(masking.mask_cell(F.lit("фио"), F.lit("Иванов"), F.lit("keep"), F.lit("K")).alias("m")).first()["m"]
    assert kept.startswith("[MASK:v1:FIO:")


@pytest.mark.parametrize("bad", [None, {}, {"op": "and", "args": []}, {"op": "eq", "field": "1x", "value": 1}, {"op": "in", "field": "a", "values": []}, {"op": "eq", "field": "a", "value": {}}, {"op": "not"}])
def test_bad_filters(bad):
    assert filters.problems(bad)


def test_filters_reach_the_scan(spark, sf_dir):
    node = {"op": "in", "field": "o_orderstatus", "values": ["F"]}
    plan = spark.read.parquet(f"{sf_dir}/orders.parquet").where(filters.compile_filter(node)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_orderstatus" in plan.split("PushedFilters")[1]
    deep = {"op": "not", "arg": node}
    for _ in range(20):
        deep = {"op": "not", "arg": deep}
    assert filters.problems(deep)
    assert filters.normal_form({"op": "or", "args": [{**node, "field": "O_OrderStatus"}, node]}) == {"op": "or", "args": [node]}


def test_feed_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"selector":"*","page":1,"success":true,"metadata":[{"source_path":"Catalog.A","field_name":"A","field_type":"String","password_mode":false}],"dictionary_values":[{"source_path":"Catalog.A","category":"K","value":"v"}],"next_cursor":"c"}\n{"selector":"*","page":2,"success":true,"metadata":[],"dictionary_values":[]}\n{"selector":"x","page":1,"success":false,"error":"nope","final_chunk":true}\n')
    df = pages.read_pages(spark, str(tmp_path / "p.json"))
    assert {(r["selector"], r["page"], r["problem"]) for r in pages.page_problems(df).collect()} == {("*", 2, "cursor or final chunk"), ("x", 1, "nope")}
    assert pages.metadata_items(df).count() == 1 and pages.dictionary_items(df).first()["value"] == "v"


def test_reveal_expands_tokens_in_values_of_its_own_batch(spark):
    a, b, c = (f"[MASK:v1:K:{x * 32}]" for x in "ABC")
    known = spark.createDataFrame([(1, a, f"x {b}"), (1, b, "y"), (2, c, "z")], "batch int, token string, value string")
    texts = spark.createDataFrame([(1, 1, f"{a} {c}"), (2, 2, f"{a}{c}"), (3, 9, a), (4, 1, None)], "doc_id int, batch int, text string")
    assert {r["doc_id"]: r["text"] for r in mapping.reveal(texts, known).collect()} == {1: f"x y {c}", 2: f"{a}z", 3: a, 4: None}


def test_changes_are_paired_once():
    from veilspark.operators.governance import pair_changes

    rule = lambda p, s="name", a="mask": {"selector": s, "pattern": p, "action": a}
    got = pair_changes([rule("client"), rule("*a*"), rule("q", "type")], [rule("*lie*"), rule("ba"), rule("*")])
    assert [(r["pattern"], a["pattern"], how) for r, a, how in got] == [("client", "*lie*", "widened"), ("*a*", "ba", "narrowed")]


def test_setup_problems():
    from veilspark.functions import setup

    rule = {"selector": "regex", "value": r"\d{4}", "action": "mask", "category": "NUM", "reason": "numbers", "tests": {"match": ["1234"], "no_match": ["12"]}}
    good = {"rules": [rule], "dictionary": {"sources": [{"source_path": "Catalog.A", "category": "K", "reason": "names"}]}, "tools": [{"tool": "query", "mode": "data-mask"}]}
    assert setup.problems(good) == []
    bad = {"rules": [rule, rule, {**rule, "value": "(?=x)"}, {**rule, "value": "[a"}, {**rule, "value": "7", "tests": {"match": ["8"], "no_match": ["7"]}}, {"selector": "name", "value": "*a*b*", "action": "hide", "category": "", "reason": ""}], "dictionary": {"sources": [{"source_path": "", "filter": {"op": "x"}, "reason": "r"}]}, "tools": [{"tool": "a b", "mode": "open"}]}
    assert [p for p, _ in setup.problems(bad)] == [
        "rules[1]", "rules[2].value", "rules[3].value", "rules[4].tests.match[0]", "rules[4].tests.no_match[0]", "rules[5].action", "rules[5].category", "rules[5].reason", "rules[5].value",
        "dictionary.sources[0].source_path", "dictionary.sources[0].filter", "tools[0].tool", "tools[0].mode",
    ]
    assert len(setup.problems({"rules": [{}] * 100})) == setup.MAX_PROBLEMS


def test_csv(spark, tmp_path):
    from veilspark.operators.report import to_csv

    to_csv(spark.createDataFrame([(1, 'a "b";c')], "id int, t string").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text() == 'id;t\n1;"a ""b"";c"\n'


def test_secrets_go_from_the_whole_document(spark):
    from veilspark.operators.result import cut_secrets

    rows = [(1, "password", "hunter2"), (1, "note", "it is hunter2, or bearer abcdefgh12"), (1, "token", None), (2, "note", "hunter2"), (3, "api_key", ""), (3, "note", None), (3, "memo", "")]
    cells = spark.createDataFrame(rows, "doc_id int, field string, value string").withColumn("ptr", F.col("field"))
    got = {(r["doc_id"], r["field"]): r["value"] for r in cut_secrets(cells).collect()}
    assert got == {(1, "password"): X.REMOVED, (1, "note"): f"it is {X.REMOVED}, or {X.REMOVED}", (1, "token"): None, (2, "note"): "hunter2", (3, "api_key"): X.REMOVED, (3, "note"): None, (3, "memo"): ""}


def test_sql_functions_equal_the_builders(spark):
    from veilspark.functions import sql

    sql.register(spark)
    df = spark.createDataFrame([("d", "phone number!", "значение"), ("d", "Х", ""), ("e", None, "v")], "d string, k string, v string")
    both = df.select(F.expr("mask_token(d, k, v)").alias("a"), X.mask_token(F.col("k"), F.col("v"), F.col("d")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    pairs = spark.createDataFrame([(p, v) for p in ("*", "**", "*ÄB*", "äb", "x", "*a*b*") for v in ("", "ÄB", "xäbx", "X", None)], "p string, v string")
    assert pairs.where(~F.expr("wildcard_match(p, v)").eqNullSafe(X.wildcard_match(F.col("p"), F.col("v")))).count() == 0
    with pytest.raises(ValueError):
        sql.register(spark, b"k" * 65)


def test_natural_order(spark):
    from veilspark.operators.report import natural_key

    df = spark.createDataFrame([(x,) for x in ("a10", "A9", None, "a9b2", "a9b10", "b1", "")], "x string")
    assert [r["x"] for r in df.orderBy(natural_key(F.col("x")).asc_nulls_last()).collect()] == ["", "A9", "a9b2", "a9b10", "a10", "b1", None]


def test_secrets_and_dictionary_in_one_cascade(spark):
    """The order of the cascade: a secret value of the dictionary comes before
    persons and rules, a kept one changes nothing."""
    cells = spark.createDataFrame([(1, "/a", "a", "x top y"), (1, "/фио", "фио", "top"), (2, "/a", "a", "keep Иванов Иван seg"), (3, "/a", "a", None), (4, "/a", "a", "[SECRET_REMOVED]")], "doc_id long, ptr string, field string, value string")
    columns = policy.evidence(spark.createDataFrame([("a", "string", None)], "name string, type string, unverified boolean"), spark.createDataFrame([], "column string, source_path string, source_type string, secret_cut boolean"))
    none = spark.createDataFrame([], "pos int, selector string, pattern string, action string, category string, priority int")
    got = {(r["doc_id"], r["ptr"]): (r["value"], r["reason"]) for r in result.protect(cells, columns, none, {"top": "T", "keep": "K", "seg": "S"}, [], {"T": "secret", "K": "keep"}).collect()}
    assert got[1, "/a"] == ("[SECRET_REMOVED]", "dictionary:T:secret") == got[1, "/фио"]
    assert re.fullmatch(r"keep \[MASK:v1:FIO:.{32}\] \[MASK:v1:S:.{32}\]", got[2, "/a"][0]) and got[2, "/a"][1] == "text"
    assert got[3, "/a"] == (None, None) and got[4, "/a"] == ("[SECRET_REMOVED]", None)


def test_matches_in_texts_that_hold_the_mark(spark):
    df = spark.createDataFrame([("a\x1e1 b2",), ("a1b22",), ("",), (None,), ("7",)], "t string")
    got = [r["m"] for r in df.select(X.replace_matches(F.col("t"), "[0-9]+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("m")).collect()]
    assert got == ["a\x1e<1> b<2>", "a<1>b<22>", "", None, "<7>"]


def test_automata_stay_in_their_worker(spark):
    """The function that goes to the workers names the cache's module; it has
    no copy of its own."""
    from pyspark import cloudpickle

    from veilspark.operators import automata

    class Shared:
        value = {"a": "A"}

    run = cloudpickle.loads(cloudpickle.dumps(automata.contained("t", "v", automata.content_key(Shared.value), Shared())))
    import pyarrow as pa

    automata._built.clear()
    list(run(iter([pa.RecordBatch.from_pydict({"t": ["xa", None]})])))
    assert list(automata._built) == [automata.content_key({"a": "A"})]
    assert automata.content_key({"a": "A", "b": "B"}) == automata.content_key({"b": "B", "a": "A"}) != automata.content_key({"a": "B", "b": "A"})


def test_bounds_of_arrays_and_texts(spark):
    cells = spark.createDataFrame([(1, "/data/9999", "x"), (2, "/data/10000", "x"), (3, "/a", "y" * 50)], "doc_id long, ptr string, value string")
    assert {r["doc_id"]: r["ok"] for r in masking.bounds(cells, 9, 9, 999, max_items=10_000, max_text=40).collect()} == {1: True, 2: False, 3: False}


def test_settings_out_of_bounds():
    assert [report.bounded_setting(x, 5, 1, 9) for x in ("7", " 9 ", "10", "0", "x", None, "")] == [7, 9, 5, 5, 5, 5, 5]


def test_pulls_that_fail(spark):
    values = spark.createDataFrame([("p", "K", "v"), ("q", "K", "v"), ("p", "K" * 40, None)], "source_path string, category string, value string")
    asked = spark.createDataFrame([("p", "K")], "source_path string, category string")
    assert {(r["problem"], r["n"]) for r in pages.dictionary_problems(values, asked).collect()} == {("item out of bounds", 1), ("not requested", 2)}
    assert [r["problem"] for r in pages.metadata_problems(spark.createDataFrame([], "source_path string, field_name string, field_type string")).collect()] == ["no metadata"]


def test_cascade_spares_the_audit(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "database string, n int")
    out = lifecycle.cascade({"history": rows, "audit": rows}, "a")
    assert (out["history"].count(), out["audit"].count()) == (1, 2)


def test_calls_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"call_id":"1","tool_name":"q","arguments":"{}"}\nbad\n')
    parsed = pages.parse_calls(pages.read_calls(spark, str(tmp_path / "in"), stream=True))
    assert parsed.isStreaming
    got = state.drained(parsed.select("call_id", "problem"), "calls").collect()
    assert {tuple(r) for r in got} == {("1", None), (None, "not JSON")} == {tuple(r) for r in pages.parse_calls(pages.read_calls(spark, str(tmp_path / "in"))).select("call_id", "problem").collect()}


def test_review_of_setup_files():
    import json

    from veilspark.functions import setup

    good = {"schema": setup.SCHEMA, "rules": [{"selector": "regex", "value": "[0-9]+", "action": "mask", "category": "N", "reason": "r", "tests": {"match": ["1"]}}], "dictionary": {"mode": "part", "sources": [{"source_path": "p", "category": "K", "reason": "r"}]}, "tools": [{"tool": "q", "mode": "data-mask"}]}
    codes = lambda x: [c for c, _ in setup.review(x if isinstance(x, str) else json.dumps(x))["issues"]]
    assert codes(good) == []
    assert codes("{") == codes("[1]") == ["SETUP_NOT_JSON"]
    assert codes({}) == ["SETUP_SCHEMA_MISSING"] and codes({"schema": "v0"}) == ["SETUP_SCHEMA_UNSUPPORTED"]
    assert codes(good | {"extra": 1}) == ["SETUP_UNKNOWN_FIELD"]
    assert codes(" " * (1 << 20) + "{}") == ["SETUP_TOO_LARGE"]
    rule = good["rules"][0]
    assert codes(good | {"rules": [rule, rule]}) == ["SETUP_DUPLICATE_RULE"]
    assert codes(good | {"rules": [rule | {"selector": "name", "value": "a*b"}]}) == ["SETUP_TESTS_NOT_REGEX", "SETUP_PATTERN_UNSUPPORTED"]
    assert codes(good | {"rules": [rule | {"tests": {"match": ["x"], "no_match": ["7"]}}]}) == ["SETUP_REGEX_TEST_FAILED"] * 2
    assert codes(good | {"rules": [rule | {"tests": None}]}) == ["SETUP_REGEX_TESTS_MISSING"] and codes(good | {"rules": [rule | {"value": "("}]}) == ["SETUP_REGEX_INVALID"]
    assert codes(good | {"rules": [rule | {"reason": ""}, {"x": 1}]})[:2] == ["SETUP_UNKNOWN_FIELD", "SETUP_REASON_MISSING"]
    star = {"source_path": "*", "category": "K", "reason": "r"}
    assert codes(good | {"dictionary": {"mode": "all", "sources": [star]}}) == [] and codes(good | {"dictionary": {"mode": "part", "sources": [star]}}) == ["SETUP_DICTIONARY_MODE"]
    assert codes(good | {"dictionary": {"mode": "all", "sources": [star, star | {"source_path": "p"}]}}) == ["SETUP_DICTIONARY_MODE"]
    assert codes(good | {"dictionary": {"sources": [star, star]}}) == ["SETUP_DUPLICATE_SOURCE"] and codes(good | {"dictionary": {"sources": [star | {"filter": {"op": "x"}}]}}) == ["SETUP_FILTER_INVALID"]
    assert codes(good | {"tools": good["tools"] * 2}) == ["SETUP_DUPLICATE_TOOL"] and codes(good | {"tools": [{"tool": "q", "mode": "open"}]}) == ["SETUP_FIELD_INVALID"]
    many = setup.review(json.dumps(good | {"rules": [rule | {"value": f"[0-9]{{{k}}}", "reason": ""} for k in range(1, 300)]}))
    assert len(many["issues"]) == 200 and many["truncated"]
