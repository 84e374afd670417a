"""Ingestion into several tables, with crashes between them."""

from collections import Counter

import pytest

from veilspark.streaming.ingest import TABLES, Ingestion

SCHEMA = "call_id string, database string, tool string, code string, kind string, seq long"


def _rows(n=90):
    return [(f"c{i % 17}", f"d{i % 3}", f"t{i % 4}", f"x{i % 2}", ("finalize", "terminal", "terminal")[i % 3], i) for i in range(n)]


def _expected(rows):
    history, terminals, seen = {}, [], {}
    for c, d, t, code, kind, i in rows:
        if kind == "finalize":
            history.setdefault(c, (c, d, t, i))
        else:
            first = seen.setdefault(c, (t, code, i))
            terminals.append((c, t, code, i, "inserted" if first[2] == i else "existing" if first[:2] == (t, code) else "conflict"))
    return {"history": Counter(history.values()), "terminals": Counter(terminals), "audit": Counter((r[5], r[0], r[4]) for r in rows)}


@pytest.fixture
def stream(spark, tmp_path):
    for k in range(4):
        part = [r for r in _rows() if r[5] * 4 // 90 == k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def _tables(job):
    return {t: Counter(tuple(r) for r in job.read(t).collect()) for t in TABLES}


def test_each_call_once(spark, tmp_path, stream):
    job = Ingestion(spark, TABLES, f"file://{tmp_path}/out")
    job.run(stream())
    assert job.batches() == [0, 1, 2, 3] and _tables(job) == _expected(_rows())
    job.run(stream())
    assert _tables(job) == _expected(_rows())


@pytest.mark.parametrize("table", list(TABLES))
def test_a_crash_between_tables_leaves_no_trace(spark, tmp_path, stream, table):
    at = f"file://{tmp_path}/out"
    schema, part = TABLES[table]
    left = [2]

    def breaks(df, known):
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("killed")
        return part(df, known)

    with pytest.raises(Exception, match="killed"):
        Ingestion(spark, {**TABLES, table: (schema, breaks)}, at).run(stream())
    job = Ingestion(spark, TABLES, at)
    assert job.batches() == [0]
    job.run(stream())
    assert _tables(job) == _expected(_rows())


def test_a_complete_batch_that_runs_again_changes_nothing(spark, tmp_path):
    job = Ingestion(spark, TABLES, f"file://{tmp_path}/out")
    df = spark.createDataFrame(_rows(9), SCHEMA)
    job.take(df, 0)
    job.take(df, 0)
    job.take(df, 1)  # replayed as another batch
    found, once = _tables(job), _expected(_rows(9))
    assert found["history"] == once["history"] and found["audit"] == once["audit"]
    assert Counter(r[4] for r in found["terminals"].elements() if r[4] == "inserted") == Counter(r[4] for r in once["terminals"].elements() if r[4] == "inserted")
