"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, mix.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept and returns a DataFrame; run() writes each as Parquet and reads it again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.decontaminate import find_leaks
from veilspark.llm.line_dedup import MIN_LINE_PAGES, drop_boilerplate
from veilspark.llm.mixing import mix_sources
from veilspark.llm.near_dup import near_duplicates
from veilspark.llm.quality import score_quality
from veilspark.llm.storage import materialise, scratch
from veilspark.session import with_package

#: Lists of rows to leave out are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000
SIMILARITY = 80


def _aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns called like those that an operator adds under
    other names, and the columns of ``docs`` as they were."""
    other = {c: _free(docs, f"own_{c}") for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``docs`` has that."""
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the hash of the text, and that column's name."""
    name = _free(docs, "text_hash")
    return docs.withColumn(name, F.xxhash64("text")), name


def _picked(docs: DataFrame, hashed: str, rows: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of ``docs`` with (doc_id, text_hash) of ``rows``;
    null ids are equal. Up to BROADCAST_ROWS rows (of two numbers) are sent to
    all tasks, more are shuffled."""
    own_id, own_hash = _free(docs, "own_id"), _free(docs, "own_hash")
    rows = materialise(rows.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct(), "rows")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(hashed) == F.col(own_hash)), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Each row is judged by its text alone: rows that repeat an id or a text,
    or have no id, stay or go by themselves. Null and empty texts have the
    score of all-zero statistics; without usable labels all rows stay. Tables
    without rows and columns of any other name pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, columns = _aside(docs, {"held_out", "score", "predicted"})
    return score_quality(docs, labels).where("predicted = 1").select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines, of small sources
    too; n_chars, where there is one, is that of the text that is left.

    No row goes. Null texts stay null, a text that loses all lines becomes
    empty; rows without source are one source; repeated rows are pages of
    their own. Columns of any other name pass through.
    """
    own, columns = _aside(docs, {"n_lines", "n_dropped"})
    kept = drop_boilerplate(own, min_host_pages=MIN_LINE_PAGES).select(*columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest
    doc_id (rows without id come last, then by the text's hash).

    Groups are told apart by their texts, never by ids: unrelated texts that
    share an id or have none all stay. Rows that repeat both doc_id and text
    count once. Documents without words are no copies and stay. Empty tables
    and columns of any other name pass through.
    """
    judged = materialise(near_duplicates(docs, SIMILARITY).select("doc_id", "text_hash", "first"), "judged")
    hashed, name = _hashed(docs)
    kept = _picked(hashed, name, judged.where("not first"), "left_anti")
    twice = materialise(judged.where("first").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    if twice.limit(1).count():
        again = _picked(kept, name, twice, "left_semi").dropDuplicates(["doc_id", name])
        kept = _picked(kept, name, twice, "left_anti").union(again)
    return kept.drop(name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks.

    Rows that share a doc_id, or have none, are judged apart, by their texts;
    rows that repeat both go together. Null and empty texts stay, as do all
    rows where the benchmark is empty. Empty tables and columns of any other
    name pass through.
    """
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True)
    hashed, name = _hashed(docs)
    return _picked(hashed, name, leaks, "left_anti").drop(name)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, taken
    (words) and epochs (how often each occurs); of the one at its source's cut
    the words that fit count.

    Rows are numbered first, so those that repeat an id, or all of a row, have
    places of their own in the mix. Null and empty texts are never taken; rows
    without source are one source. Columns that the mix adds replace those of
    the same name; others pass through. An empty table gives an empty one.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in MIX_COLUMNS]
    row = _free(docs, "row_number")
    numbered = materialise(docs.select(*own, F.monotonically_increasing_id().alias(row)), "numbered")
    taken = mix_sources(numbered, keep=(row,)).where("taken > 0").select(row, *MIX_COLUMNS)
    return numbered.join(taken, row).drop(row)


MIX_COLUMNS = ("size", "source_size", "target", "taken", "epochs")
STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicate), ("benchmark decontamination", decontamination), ("mixing to target weights", mix)]

#: Trees and MinHash have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage writes on its
    way is deleted when its result is written."""
    with_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower(), keep=True)
    return docs
