"""The pipeline's stages against what the operators say on its own."""

import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from veilspark.llm.decontaminate import find_leaks
from veilspark.llm.near_dup import near_duplicates


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialise(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= rows
        rows = docs.count()
    assert near_duplicates(docs, pipeline.SIMILARITY).where("not kept").count() == 0
    assert find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(map(str, last)) == sorted(map(str, pipeline.run(spark, sf_dir).collect()))


def test_edges(spark, sf_dir):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, None, "s", 5), (1, text, None, "s", 5), (2, text, "en", None, 5), (None, text + " x", "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (4, "y " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_duplicate(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] or -1 for r in kept)) == [-1, 1, 3, 4]
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        if name in ("line dedup", "benchmark decontamination"):
            assert sorted(map(str, stage(spark, docs, sf_dir).drop("n_chars").collect())) == sorted(map(str, docs.drop("n_chars").collect()))
    taken = pipeline.mix(spark, docs, sf_dir).collect()
    assert all(r["text"] and 0 < r["taken"] <= 3 * r["size"] for r in taken)


def test_ids_never_group_documents(spark, sf_dir):
    """Unrelated texts without id, or with one id, are no copies of each other."""
    rows = [(None, "one lonely text about ships"), (None, "another text on the price of bread"), (7, "a third text of seven"), (7, "and a fourth one that shares the id"), (7, "a third text of seven"), (None, "one lonely text about ships"), (9, "another text on the price of bread")]
    clash = [(*r, i, "x", 3, True, 5, "h") for i, r in enumerate(rows)]
    docs = spark.createDataFrame(clash, "doc_id long, text string, text_hash int, i string, h int, first boolean, cluster int, __hash string")
    kept = pipeline.near_duplicate(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("None", rows[0][1]), ("9", rows[1][1]), ("7", rows[2][1]), ("7", rows[3][1])])
    assert all((r["doc_id"], r["text"], r["text_hash"], r["i"], r["h"]) in {c[:5] for c in clash} for r in got)


def test_stages_keep_columns_of_their_own_names(spark, sf_dir):
    rows = [(i, f"words of text {i} and some more of them", "s", 1, 0.25, 7, 8, 9, 10) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, predicted int, score double, n_lines int, text_hash int, taken int, size int")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert set(map(tuple, out.collect())) <= set(rows)
    mixed = pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == [c for c in docs.columns if c not in pipeline.MIX_COLUMNS] + list(pipeline.MIX_COLUMNS)
    assert {r["text_hash"] for r in mixed.collect()} == {8}


def test_twins_have_places_of_their_own(spark, sf_dir):
    rows = [(1, "a b c d e", "s")] * 9 + [(None, "f g h", "s")] * 4 + [(2, "i j k l m n o p", "t")]
    taken = pipeline.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf_dir).collect()
    by = Counter()
    for r in taken:
        by[r["source"]] += r["taken"]
    assert all(abs(by[r["source"]] - r["target"]) < 1 for r in taken)


def test_only_leaking_rows_go(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, f"copy: {item}"), (None, "a clean text without id"), (None, None), (7, "a clean text of id seven"), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = pipeline.decontamination(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[2], rows[3]], key=str)


def test_lines_of_small_sources_go(spark, sf_dir):
    rows = [(i, f"own {i}\nfooter", s) for s, n in (("a", 19), ("b", 4)) for i in range(n)]
    got = pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted((i, t.replace("\nfooter", "") if s == "a" else t, s) for i, t, s in rows)


def test_edge_rows_of_near_duplicates(spark, sf_dir):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (2, text), (None, text + " x"), (None, None), (3, ""), (4, "y " * 50_000)]
    got = pipeline.near_duplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], *rows[4:]], key=str)


def test_stages_against_plain_python(spark, sf_dir):
    def rows_of(df):
        return {r["doc_id"]: r.asDict() for r in df.collect()}

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = rows_of(docs)
    # lines: pages with the line by pages of the source; each second one gets a footer
    footed = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nfooter of "), "source")).otherwise(F.col("text")))
    lined = rows_of(footed)
    pages, lines = Counter(r["source"] for r in lined.values()), Counter()
    for r in lined.values():
        lines.update({(r["source"], x.strip(" \t\n\v\f\r")) for x in (r["text"] or "").split("\n")})
    bad = {k for k, n in lines.items() if k[1] and n >= 5 and n > 0.1 * pages[k[0]]}
    want = {i: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" \t\n\v\f\r")) not in bad) for i, r in lined.items()}
    assert want != {i: r["text"] for i, r in lined.items()}
    assert {i: r["text"] for i, r in rows_of(pipeline.lines(spark, footed, sf_dir)).items()} == want
    # near-dedup: shingle sets in pairs
    sets = {}
    for i, r in before.items():
        w = r["text"].encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= pipeline.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    assert set(rows_of(pipeline.near_duplicate(spark, docs, sf_dir))) == {i for i in sets if top(i) == i}
    # decontamination: 10 words of an item in a row are three windows
    words = lambda t: re.sub(r"[^\w\s]|_", "", t.lower()).split()
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    ten = set().union(*(runs(w, min(10, len(w))) for w in items if w))
    leaks = {i for i, r in before.items() if any(runs(words(r["text"]), n) & ten for n in {len(x) for x in ten})}
    kept = set(rows_of(pipeline.decontamination(spark, docs, sf_dir)))
    assert leaks and not leaks & kept
    # mixing: budgets of the sources, three epochs at most
    size = Counter()
    for r in before.values():
        size[r["source"]] += len(r["text"].split())
    names = sorted(size)
    weight, fixed, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, sum(size.values())
    while over := [s for s in names if s not in fixed and left * weight[s] / sum(weight[x] for x in names if x not in fixed) > 3 * size[s]]:
        fixed |= {s: 3 * size[s] for s in over}
        left = sum(size.values()) - sum(fixed.values())
    free = sum(weight[s] for s in names if s not in fixed)
    taken = Counter()
    for r in pipeline.mix(spark, docs, sf_dir).collect():
        assert before[r["doc_id"]]["text"] == r["text"] and 0 < r["taken"] <= 3 * len(r["text"].split())
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - fixed.get(s, left * weight[s] / free)) < 1 for s in names)
