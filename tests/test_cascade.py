"""The cascade with its reasons: leaks that may not happen, and odd cells."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import cascade, dictionary, policy

CELLS = "doc_id long, ptr string, field string, kind string, value string"
EMPTY = "pos int, selector string, pattern string, action string, category string, priority int"


def _evidence(spark, columns=(), lineage=()):
    return policy.evidence(spark.createDataFrame(list(columns), "name string, type string, unverified boolean"), spark.createDataFrame(list(lineage), "column string, source_path string, source_type string, secret_cut boolean"))


def _run(spark, cells, evidence, rules=(), values=None, manifest=None):
    own = cascade.Policy(spark.createDataFrame(list(rules), cascade.RULES), values or {}, manifest)
    rows = cascade.cascade(spark.createDataFrame([(d, f"/{f}", f, k, v) for d, f, k, v in cells], CELLS), evidence, own).collect()
    return {(r.doc_id, r.ptr[1:]): (r.value, r.why, [x.code for x in r.reasons]) for r in rows}


def test_persons_and_secrets_by_source(spark):
    evidence = _evidence(spark, lineage=[("buyer", "Catalog.Order.ФИО", None, None), ("whole", "Catalog.X.НаименованиеПолное", None, None), ("pin", "Catalog.A.Pin", None, True), ("key", "Catalog.B.UserPassword", None, None), ("listed", "Catalog.C.Code", None, None)])
    manifest = spark.createDataFrame([("catalog.c.code", "Code", True)], "source_path string, field_name string, password_mode boolean")
    cells = [(1, "buyer", "string", "Sidorov"), (1, "note", "string", "for Sidorov and ООО: pw1 kk zz"), (1, "whole", "string", "ООО"), (1, "pin", "string", "pw1"), (1, "key", "string", "kk"), (1, "listed", "string", "zz"), (2, "note", "string", "Sidorov pw1")]
    got = _run(spark, cells, evidence, manifest=manifest)
    assert got[1, "buyer"][2] == ["mandatory:fio:name"] == got[1, "whole"][2]
    assert [got[1, f] for f in ("pin", "key", "listed")] == [("[SECRET_REMOVED]", "secret:name", ["secret:name"])] * 3
    assert re.fullmatch(r"for \[MASK:v1:FIO:.{32}\] and \[MASK:v1:FIO:.{32}\]: \[SECRET_REMOVED\] \[SECRET_REMOVED\] \[SECRET_REMOVED\]", got[1, "note"][0])
    assert got[1, "note"][2] == ["secret:literal", "mandatory:fio:source"]
    assert got[2, "note"] == ("Sidorov pw1", "text", [])


def test_numbers_pass_and_unverified_columns_do_not(spark):
    evidence = _evidence(spark, columns=[("sum", "number", None), ("free", "string", True), ("token", "string", True)])
    rules = [(1, "name", "sum", "mask", "SUM", 1), (2, "name", "free", "keep", "F", 1)]
    got = _run(spark, [(1, "sum", "number", "5"), (1, "sum2", "null", None), (2, "sum", "string", "5"), (1, "free", "null", None), (2, "free", "number", "7"), (1, "token", "string", "hunter2"), (1, "note", "string", "hunter2!")], evidence, rules)
    assert got[1, "sum"] == ("5", "kept", []) and got[1, "sum2"] == (None, "kept", [])
    assert got[2, "sum"][1:] == ("rule:mask", ["name:sum:mask"])
    assert got[1, "free"][0].startswith("[MASK:v1:UNVERIFIED_NULL:") and got[2, "free"][0].startswith("[MASK:v1:UNVERIFIED_NUMBER:") and got[2, "free"][2] == ["unverified:free"]
    # a secret never becomes a token that can be resolved
    assert got[1, "token"] == ("[SECRET_REMOVED]", "secret:name", ["secret:name"]) and got[1, "note"][0] == "[SECRET_REMOVED]!"


def test_a_secret_source_without_text_fails_its_document(spark):
    evidence = _evidence(spark, lineage=[("pin", "Catalog.A.Pin", None, True)])
    got = _run(spark, [(1, "pin", "number", "12"), (1, "note", "string", "12"), (2, "pin", "null", None), (2, "note", "string", "12"), (3, "password", "number", "12"), (3, "note", "string", "x")], evidence)
    assert got[1, "pin"] == got[1, "note"] == (None, "failed", ["failed"])
    assert got[2, "note"][0] == "12" and got[3, "password"][0] == "[SECRET_REMOVED]" and got[3, "note"][0] == "x"


def test_reasons_of_all_stages_in_order(spark):
    rules = [(1, "source_path", "*a.b*", "keep", "P", 1), (2, "name", "note", "mask", "N", 9), (3, "dictionary", "K", "keep", "K", 1), (4, "dictionary", "S", "secret", "S", 1), (5, "regex", "[0-9]{4}", "mask", "NUM", 2), (6, "regex", "z+", "keep", "Z", 1), (7, "regex", "stop!", "secret", "X", 1)]
    values = {"cat": "C", "dog": "D", "keep": "K", "vault": "S"}
    evidence = _evidence(spark, lineage=[("note", "Catalog.A.B", None, None), ("фио", "Catalog.A.C", None, None)])
    text = "Ivan: dog, Петров Пётр 1234, cat dog keep zz bearer abcdefgh99"
    got = _run(spark, [(1, "note", "string", text), (1, "фио", "string", "Ivan"), (2, "note", "string", "the vault"), (3, "note", "string", "stop! dog"), (4, "note", "string", "")], evidence, rules, values)
    value, why, codes = got[1, "note"]
    assert codes == ["secret:value", "mandatory:fio:source", "mandatory:fio:text", "source_path:p:keep", "dictionary:D", "dictionary:C", "dictionary:K", "regex:Z", "regex:NUM"] and why == "text"
    assert not any(x in value for x in ("Ivan", "dog", "Петров", "1234", "cat", "bearer"))
    assert got[2, "note"] == ("[SECRET_REMOVED]", "dictionary:S:secret", ["dictionary:S:secret"]) and got[3, "note"] == ("[SECRET_REMOVED]", "secret:regex", ["regex:x:secret"])
    assert got[4, "note"] == ("", "text", ["source_path:p:keep"])


def test_table_of_reasons(spark):
    rules = [(1, "regex", "a", "mask", "A", 1), (2, "regex", "b", "mask", "B", 2), (3, "regex", "c", "mask", "C", 3)]
    own = cascade.Policy(spark.createDataFrame(rules, cascade.RULES))
    cells = spark.createDataFrame([(1, "/1", "x", "b c"), (1, "/0", "x", "c b"), (1, "/2", "x", "a"), (2, "/0", "x", "-"), (3, "/0", "x", "b")], "doc_id long, ptr string, field string, value string")
    entries, bound = cascade.reason_table(cascade.cascade(cells, _evidence(spark), own), 2)
    assert sorted((r.doc_id, r.idx, r.code) for r in entries.collect()) == [(1, 0, "regex:B"), (1, 1, "regex:C"), (3, 0, "regex:B")]
    assert sorted((r.doc_id, r.ptr, r.idx) for r in bound.collect()) == [(1, "/0", 0), (1, "/0", 1), (1, "/1", 0), (1, "/1", 1), (3, "/0", 0)]


@pytest.mark.parametrize("native", [0, 200])
def test_parts_and_held_values(spark, native):
    values = {"a.b": "X", "ab": "Y", "abc": "Z"}
    df = spark.createDataFrame([("abcab a.b",), ("axb",), ("",), (None,)], "t string")
    parts = [[tuple(p) for p in r.p] for r in dictionary.marked_values(df, values, "t", "p", native).collect()]
    assert parts == [[("", "abc", "Z"), ("", "ab", "Y"), (" ", "a.b", "X"), ("", None, None)], [("axb", None, None)], [("", None, None)], [("", None, None)]]
    held = [[tuple(p) for p in r.p] for r in dictionary.held_values(df, values, "p", "t", native).collect()]
    assert held == [[("a.b", "X"), ("ab", "Y"), ("abc", "Z")], [], [], []]


def test_no_cells(spark):
    assert _run(spark, [], _evidence(spark), [(1, "name", "*", "mask", "A", 1)], {"a": "A"}) == {}
    assert cascade.cell_reasons(cascade.cascade(spark.createDataFrame([], CELLS), _evidence(spark), cascade.Policy(spark.createDataFrame([], EMPTY)))).agg(F.count("*")).first()[0] == 0
