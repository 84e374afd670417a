"""Boilerplate lines by site-relative frequency.

For each host the pages that contain a line are counted (a page once) and
divided by the host's pages; lines above a ratio are boilerplate and dropped.
Lines are compared by the 64-bit hash of their text without outer white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

RATIO = 0.1
MIN_HOST_PAGES = 20
MIN_LINE_PAGES = 5
#: Lists of lines are broadcast up to so many lines; beyond, they are joined
#: by host, each host in SALTS parts.
BROADCAST_LINES = 100_000
SALTS = 64
_WS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(_WS)))


def boilerplate_lines(docs: DataFrame, ratio: float = RATIO, min_host_pages: int = MIN_HOST_PAGES, min_line_pages: int = MIN_LINE_PAGES) -> DataFrame:
    """(host, line, pages, host_pages) of the lines above ``ratio`` of their
    host's pages; line is the hash. Counts are pre-aggregated, so neither a
    hot host nor a hot line meets in one task."""
    each = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x, F.lit(_WS)) != ""), _hash))
    counted = docs.select("host", F.explode(each).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_line_pages)
    hosts = docs.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= min_host_pages)
    return counted.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > ratio * F.col("host_pages")).select("host", "line", "pages", "host_pages")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_host_pages: int = MIN_HOST_PAGES, min_line_pages: int = MIN_LINE_PAGES) -> DataFrame:
    """One row per row of ``docs`` with all its columns, ``text`` without its
    host's boilerplate lines, and n_lines and n_dropped.

    A host with fewer than ``min_host_pages`` pages loses nothing, nor do
    lines on fewer than ``min_line_pages`` pages; empty lines are never
    dropped. A null host is one host. A null text stays null with no lines;
    one whose lines all go becomes empty. Repeated rows are pages of their
    own. The columns n_lines and n_dropped are replaced where ``docs`` has
    them; other columns are passed through.
    """
    pages = docs.select(F.col(host).alias("host"), "text")
    bad = boilerplate_lines(pages, ratio, min_host_pages, min_line_pages)
    bad = materialise(bad.groupBy(F.col("host").alias("__host")).agg(F.sort_array(F.collect_set("line")).alias("__bad")), "lines")
    same = docs[host].eqNullSafe(bad["__host"])
    if (bad.agg(F.sum(F.size("__bad"))).first()[0] or 0) <= BROADCAST_LINES:
        met = docs.join(F.broadcast(bad), same, "left")
    else:
        each = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = docs.join(each, same & (F.pmod(F.xxhash64(docs["text"]), F.lit(SALTS)) == F.col("__salt")), "left")
    kept = F.when(F.col("__bad").isNull(), _lines(docs["text"])).otherwise(F.filter(_lines(docs["text"]), lambda x: (F.trim(x, F.lit(_WS)) == "") | ~F.array_contains(F.col("__bad"), _hash(x))))
    met = met.withColumn("__kept", kept)
    left = F.when(docs["text"].isNull(), F.lit(None).cast("string")).otherwise(F.array_join("__kept", "\n"))
    n = F.when(F.coalesce(docs["text"], F.lit("")) == "", 0).otherwise(F.size(_lines(docs["text"])))
    dropped = F.when(F.coalesce(docs["text"], F.lit("")) == "", 0).otherwise(F.size(_lines(docs["text"])) - F.size("__kept"))
    same = [docs[c] if c != "text" else left.alias("text") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return met.select(*same, n.cast("int").alias("n_lines"), dropped.cast("int").alias("n_dropped"))


LINE_ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
k AS (
  SELECT source, line, count(*) AS pages FROM (
    SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) AS line FROM l)
  GROUP BY ALL),
h AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
bad AS (
  SELECT k.source, list(line) AS bad FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source
  WHERE pages > {RATIO} * host_pages AND host_pages >= {MIN_HOST_PAGES} AND pages >= {MIN_LINE_PAGES} GROUP BY k.source),
r AS (
  SELECT doc_id, l.text, l.lines,
         list_filter(lines, lambda x: NOT coalesce(list_contains(bad, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), false)) AS kept
  FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
       CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(lines) END::INT AS n_lines,
       CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(lines) - len(kept) END::INT AS n_dropped
FROM r
"""
