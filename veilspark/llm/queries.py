"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import find_leaks
from .hard_negatives import NEGATIVES_ORACLE, mine_hard_negatives, with_moved_labels
from .html_text import extract_main_text
from .katz import score_language
from .line_dedup import LINE_ORACLE, drop_boilerplate
from .mixing import MIX_ORACLE, mix_sources
from .near_dup import near_duplicates
from .quality import score_quality
from .repeats import remove_repeats
from .resampling import RESAMPLE_ORACLE, importance_resample
from .tokens import count_tokens
from .topk import top_k
from .url_filter import URL_ORACLE, judge_urls, rule_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score_quality(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(with_moved_labels(_table(spark, sf_dir, "embeddings")))


TOP_K_ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_exact_top_k, op2_mix_sources, op3_quality_classifier, op4_decontamination, op5_minhash_near_dedup, op6_line_dedup, op7_token_counts,
        op8_html_extraction, op9_url_filter, op10_suffix_array_dedup, op11_importance_resampling, op12_katz_scoring, op13_hard_negatives,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": TOP_K_ORACLE, "op2_mix_sources": MIX_ORACLE, "op6_line_dedup": LINE_ORACLE, "op9_url_filter": URL_ORACLE, "op11_importance_resampling": RESAMPLE_ORACLE, "op13_hard_negatives": NEGATIVES_ORACLE}
