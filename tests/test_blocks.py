"""Blocks, tables and coordinates of results of any shape."""

from pyspark.sql import functions as F

from veilspark.operators import blocks, masking

RESULTS = [
    (1, '{"content":[{"type":"text","text":"hello"},{"type":"other"},{"type":"json","json":{"rows":[{"id":1,"Text":"[MASK:v1:A:x]"},{"ID":null,"extra":{"name":"n","x":[1,2]}}]}}],"structured_content":[{"n":1},{"n":"s"}]}'),
    (2, "[1,2]"), (3, '{"data":[{"a/b":true,"c":{"z":[1]}}]}'), (4, "bad"), (5, None), (6, '{"rows":[]}'), (7, '"x"'), (8, '{"rows":[{},{}]}'), (9, '{"content":[{"type":"json"},{"type":"text","text":5}]}'), (10, '[{"A":1},{"a":2}]'),
]


def _all(spark, schema=()):
    results = spark.createDataFrame(RESULTS, "doc_id long, json string")
    found = blocks.result_blocks(results)
    cells = blocks.table_cells(found)
    columns = blocks.table_columns(cells, spark.createDataFrame(list(schema), "doc_id long, pos int, name string"))
    return results, found, cells, columns


def test_blocks(spark):
    _, found, _, _ = _all(spark)
    got = {(r.doc_id, r.block): (r.ptr, r.kind, r.text) for r in found.collect()}
    assert got == {
        (1, 0): ("/content/0", "text", "hello"), (1, 1): ("/content/2/json", "table", None), (1, 2): ("/structured_content", "table", None), (2, 0): ("", "text", "[1,2]"), (3, 0): ("", "table", None),
        (4, 0): ("", "text", "bad"), (6, 0): ("", "text", '{"rows":[]}'), (7, 0): ("", "text", '"x"'), (8, 0): ("", "text", '{"rows":[{},{}]}'), (9, 0): ("/content/0/json", "text", "null"), (10, 0): ("", "table", None),
    }


def test_columns_and_cells(spark):
    _, _, cells, columns = _all(spark, [(1, 1, "text"), (1, 2, "Id"), (1, 3, "none"), (1, 4, "TEXT")])
    own = {(r.doc_id, r.block, r.col): (r.id, r.type, r.masked) for r in columns.collect()}
    assert [own[1, 1, i] for i in range(4)] == [("Text", "string", True), ("id", "number", False), ("none", "null", False), ("extra", "string", False)]
    assert own[1, 2, 3] == ("n", "mixed", False) and own[3, 0, 0] == ("a/b", "boolean", False)
    assert (own[10, 0, 0], own[10, 0, 1]) == (("A", "number", False), ("a", "number", False))
    assert {(r.key, r.value) for r in cells.where("doc_id in (1, 3)").collect()} >= {("extra", "n"), ("ID", None), ("c", '{"z":[1]}'), ("a/b", "true")}


def test_coordinates(spark):
    results, found, cells, columns = _all(spark, [(1, 1, "text")])
    got = {(r.doc_id, r.ptr): (r.block, r.row, r.col) for r in blocks.coordinates(masking.walk_json(results), found, cells, columns).collect()}
    assert got[1, "/content/0/text"] == (0, None, None) == got[1, "/content/1/type"]
    assert got[1, "/content/2/json/rows/1/extra/x/1"] == (1, 1, 2) and got[1, "/content/2/json/rows/0/Text"] == (1, 0, 0)
    assert got[3, "/data/0/a~1b"] == (0, 0, 0) and got[3, "/data/0/c/z/0"] == (0, 0, 1) and got[2, "/1"] == (0, None, None)
    assert got[10, "/1/a"] == (0, 1, 0)  # the first of the columns that differ in case only


def test_nearest_takes_whole_segments(spark):
    known = spark.createDataFrame([(1, "/a", 1), (1, "/a/b", 2), (1, "", 0), (2, "/a", 9)], "doc_id long, ptr string, cell int")
    asked = spark.createDataFrame([(1, p) for p in ("/a/b/c", "/a/bc", "/ab", "/a", "")] + [(2, "/ab"), (2, "/a/x"), (3, "/a")], "doc_id long, ptr string")
    got = {(r.doc_id, r.ptr): r.cell for r in blocks.nearest(asked, known, "doc_id").collect()}
    assert got == {(1, "/a/b/c"): 2, (1, "/a/bc"): 1, (1, "/ab"): 0, (1, "/a"): 1, (1, ""): 0, (2, "/ab"): None, (2, "/a/x"): 9, (3, "/a"): None}


def test_json_that_is_deep_or_bad(spark):
    texts = [(1, "[" * 100_000), (2, "NaN"), (3, '{"a":1e400,"b":-1E999}'), (4, '{"a":1,"a":2}'), (5, "[" * 70 + "1" + "]" * 70), (6, '{"x":Infinity}'), (7, "")]
    got = {(r.doc_id, r.ptr): (r.kind, r.value) for r in masking.walk_json(spark.createDataFrame(texts, "doc_id long, json string")).collect()}
    assert {d for d, _ in got} == {3, 4, 5}
    assert got[3, "/a"] == ("number", "1e400") and got[3, "/b"] == ("number", "-1E999") and got[4, "/a"] == ("number", "2") and got[5, "/0" * 64] == ("too deep", None)
    assert blocks.result_blocks(spark.createDataFrame(texts, "doc_id long, json string")).agg(F.count("*")).first()[0] == len(texts)
