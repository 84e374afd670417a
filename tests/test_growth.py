"""Steps whose work must not grow faster than their input."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.functions.text import mask_token
from veilspark.operators import automata, blocks, cascade, ledger, mapping, masking, patterns, routing
from veilspark.plans import QUERIES
from veilspark.session import numbered
from veilspark.sources import pages
from veilspark.streaming import store


def test_a_text_meets_its_own_tokens_only(spark):
    n = 3000
    known = spark.range(n).select(F.lit(1).alias("batch"), mask_token(F.lit("K"), F.col("id").cast("string")).alias("token"), F.concat(F.lit("v"), "id").alias("value"))
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("batch"), F.concat(F.lit("a "), mask_token(F.lit("K"), F.col("id").cast("string")), F.lit(" b")).alias("text"))
    out = mapping.reveal(texts, known, 2)
    assert "collect_list(struct(token" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: f"a v{i} b" for i in range(n)}


def test_revealed_texts_keep_their_rows(spark):
    a, b = (f"[MASK:v1:K:{x * 32}]" for x in "AB")
    known = spark.createDataFrame([(1, a, f"<{b}{b}>"), (1, b, None), (None, b, "z")], "batch int, token string, value string")
    texts = spark.createDataFrame([(1, 1, a), (1, 1, a), (2, 1, ""), (None, None, b), (3, 1, f"{a}x{a}")], "doc_id int, batch int, text string")
    out = sorted((str(r["doc_id"]), r["text"]) for r in mapping.reveal(texts, known, 3).collect())
    assert out == [("1", f"<{b}{b}>"), ("1", f"<{b}{b}>"), ("2", ""), ("3", f"<{b}{b}>x<{b}{b}>"), ("None", b)]


def test_bounds_are_those_of_one_pull(spark, monkeypatch):
    monkeypatch.setitem(pages.MOST, "values", 5)
    values = spark.range(12).select(F.lit("p").alias("source_path"), F.lit("K").alias("category"), F.lit("v").alias("value"), F.when(F.col("id") < 3, 0).when(F.col("id") < 6, 1).otherwise(2).alias("pull"))
    asked = spark.createDataFrame([("q", "K")], "source_path string, category string")
    assert {tuple(r) for r in pages.dictionary_problems(values, asked, "pull").select("pull", "problem", "n").collect()} == {(0, "not requested", 3), (1, "not requested", 3), (2, "not requested", 6), (2, "too many values", 6)}
    assert {tuple(r) for r in pages.dictionary_problems(values, asked).select("problem", "n").collect()} == {("not requested", 12), ("too many values", 12)}


def test_rate_windows_are_dealt_out_by_the_hour(spark):
    at = [0, 59, 60, 60, 61, 3599, 3600, 3601, 3660, 7200, 7201, 14400, 14400, None, None]
    rows = [(i, k, t) for k in (1, None) for i, t in enumerate(at)]
    attempts = spark.createDataFrame(rows, "event_id int, key int, t int").select(F.when(F.col("key").isNull(), F.col("event_id") + 100).otherwise(F.col("event_id")).alias("event_id"), "key", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"))
    found = ledger.rate_limited(attempts, 2, 6)
    assert "specifiedwindowframe(RangeFrame, -" not in found._jdf.queryExecution().optimizedPlan().toString()
    near = lambda t, n: sum(x is None if t is None else x is not None and t - n <= x <= t for x in at)
    assert {tuple(r) for r in found.collect()} == {(i + add, m := near(t, 60), h := near(t, 3600), m <= 2 and h <= 6) for add in (0, 100) for i, t in enumerate(at)}


@pytest.mark.parametrize("most", [100, 0])
def test_cells_are_not_dealt_out_by_their_field(spark, monkeypatch, most):
    monkeypatch.setattr(cascade, "BROADCAST_FIELDS", most)
    cells = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("/t").alias("ptr"), F.when(F.col("id") == 7, "n").when(F.col("id") > 7, "T").alias("field"))
    facts = spark.createDataFrame([("t", "a"), ("n", "b")], "__field string, fact string")
    met = cascade.with_facts(cells, facts)
    assert Counter(r["fact"] for r in met.collect()) == {"a": 1992, "b": 1, None: 7} and met.columns == ["doc_id", "ptr", "field", "fact"]
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan if most else "__deal" in plan


def test_batches_of_a_token_are_put_together_once(monkeypatch):
    reads = []

    class Text(str):
        def split(self, *a):
            reads.append(1)
            return str.split(self, *a)

    own = store.Tokens({"t": ["v", Text("a"), 0, 0, 0, 10**6]}, 9, 10**6)
    out = own.take([(i, i, f"b{i % 50}", "publish", "t", "v") for i in range(1, 500)])
    assert {x[6] for x in out} == {"reused"} and len(reads) == 1
    assert own.entries["t"][1].split(store._SEP) == ["a", *[f"b{i % 50}" for i in range(1, 51)]]
    # an entry that expires starts with its new batch alone, later calls add to it
    own.take([(10**7, 1, "x", "publish", "t", "v"), (10**7 + 1, 2, "y", "publish", "t", "v")])
    assert own.entries["t"][1] == f"x{store._SEP}y"


def test_texts_pass_an_automaton_in_small_parts(monkeypatch):
    monkeypatch.setattr(automata, "SLICE_BYTES", 100)

    class Shared:
        value = {"a": "A"}

    texts = ["xa" * 20, None, "", "a" * 300, *["a"] * 150]
    frame = pa.RecordBatch.from_pydict({"t": texts})
    for run in (automata.parts, automata.contained, automata.held):
        out = list(run("t", "o", automata.content_key(Shared.value), Shared)(iter([frame])))
        assert len(out) >= 4 and [x for o in out for x in o["t"].to_pylist()] == texts
    assert list(automata.slices(iter([frame.slice(0, 0)]), "t")) == []


def test_texts_of_a_shard_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(routing, "PART_BYTES", 100)
    texts = spark.range(400).select("id", F.concat(F.lit("a needle "), F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    found = routing.matches(texts, spark.createDataFrame([("needle", "N")], "value string, category string"))
    assert {(r["doc_id"], r["start"]) for r in found.collect()} == {(i, 2) for i in range(400)}
    per = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per) > 2 and max(r["count"] for r in per) < 300


RESULTS = [
    (1, '{"content":[{"type":"text","text":"x"},{"type":"json","json":{"rows":[{"a/b":1,"A/B":{"x":[1,2]}},{},{"c~":null}]}},{"type":"json"}],"structured_content":[{"N":1}]}'),
    (2, '{"data":[{"Id":1},{"iD":"[MASK:v1:K:0]"}],"rest":[1]}'), (3, '{"data":[]}'), (4, "[{}]"), (5, '[{"":5},{"b":true}]'), (6, "no json"), (7, None), (8, '{"rows":[{"a":1},null]}'), (9, "[[1]]"), (10, "7"),
]


def _parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson")


def test_results_are_parsed_once_for_their_coordinates(spark, sf_dir):
    assert _parses(QUERIES["report_coordinates"](spark, sf_dir)) == 0
    results = spark.createDataFrame(RESULTS, "doc_id long, json string")
    schema = spark.createDataFrame([(d, i, n) for d in range(1, 11) for i, n in enumerate(("ID", "n", "a/b"))], "doc_id long, pos int, name string")
    found = blocks.result_blocks(results)
    cells = blocks.table_cells(found)
    expected = blocks.coordinates(masking.walk_json(results), found, cells, blocks.table_columns(cells, schema)).collect()
    assert len(expected) > 15 and Counter(expected) == Counter(blocks.result_coordinates(masking.walk_json(results), results, schema).collect())


def test_columns_of_tables_come_from_keys_read_once(spark, sf_dir):
    assert _parses(QUERIES["report_table_columns"](spark, sf_dir)) == 0


def test_columns_of_tables_sort_and_send_no_values(spark, sf_dir, monkeypatch):
    sent = []
    monkeypatch.setattr(blocks, "written", lambda df, name, f=blocks.written: sent.append(df) or f(df, name))
    plan = QUERIES["report_table_columns"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    keys = sent[-1]._jdf.queryExecution().executedPlan().toString()
    # values that are sorted or held as objects grow with the texts
    assert "HashAggregate" in keys and not any(x in keys for x in ("ObjectHashAggregate", "SortAggregate", "Sort ["))
    assert plan.count("Exchange hashpartitioning") <= 3
    results = spark.createDataFrame([(1, '[{"A":1},{"a":"s","c":true},{"b":null}]'), (None, '[{"a":[1]},{"a":null,"A":0}]')], "doc_id long, json string")
    schema = spark.createDataFrame([(1, 2, "a"), (1, 1, "zz"), (1, 0, None), (1, 7, "AA"), (1, 3, "A"), (None, 1, "a"), (9, 1, "a")], "doc_id long, pos int, name string")
    got = blocks.table_columns(blocks.table_cells(blocks.result_blocks(results)), schema).orderBy("doc_id", "col").collect()
    assert [tuple(r) for r in got] == [
        (None, 0, 0, "A", "number", False, "a"), (None, 0, 1, "a", "string", False, "a"),
        (1, 0, 0, "zz", "null", False, "zz"), (1, 0, 1, "A", "mixed", False, "a"), (1, 0, 2, "AA", "null", False, "aa"), (1, 0, 3, "b", "null", False, "b"), (1, 0, 4, "c", "boolean", False, "c"),
    ]


def test_a_dry_run_resolves_its_cells_once(spark, sf_dir):
    files = QUERIES["dry_run_policies"](spark, sf_dir).inputFiles()
    assert files and not any("documents.parquet" in f for f in files)


def test_changes_are_numbered_by_ranges(spark, sf_dir):
    assert "row_number()" not in QUERIES["compute_diff"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    rows = [(i % 7, None if i % 5 == 0 else f"s{i * 37 % 101}") for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "a int, b string"), "place", F.desc("a"), "b").orderBy("place").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or "")) and [r["place"] for r in got] == list(range(1, 501))
    assert numbered(spark.createDataFrame([], "a int"), "place", "a").collect() == []


def test_patterns_share_long_runs_with_texts(spark):
    most = lambda text: spark.createDataFrame([(text,)], "t string").select(patterns._run_length(F.col("t"))).first()[0]
    assert [most("x" * n) for n in (1, 2, 3, 4, 7, 8, 9, 31, 32, 200)] == [1, 2, 2, 4, 4, 8, 8, 16, 32, 32]
    text = "".join(chr(97 + i * i % 23) for i in range(80))
    texts = [text[i:i + n] for n in (1, 2, 3, 5, 8, 9, 17, 33, 70) for i in (0, 4)] + ["zz" * 20]
    got = patterns.matches(spark.createDataFrame([(f"*{x}*",) for x in texts], "pattern string"), spark.createDataFrame([(x,) for x in texts], "value string")).collect()
    assert Counter((r["pattern"], r["value"]) for r in got) == Counter((f"*{a}*", b) for a in texts for b in texts if a in b)
