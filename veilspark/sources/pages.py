"""Feed pages as tables: envelopes, cursors and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "selector string, page int, success boolean, error string, metadata array<struct<source_path:string,field_name:string,field_type:string,password_mode:boolean>>, dictionary_values array<struct<source_path:string,category:string,value:string>>, next_cursor string, final_chunk boolean"
MAX_PATH, MAX_NAME, MAX_TYPE, MAX_VALUE, MAX_CATEGORY = 512, 256, 1 << 20, 2 << 20, 32
MAX_PAGES, MAX_CURSOR = 10_000, 1 << 20
MOST = {"sources": 100, "values": 1_000_000, "bytes": 1 << 30}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON files, with a fixed schema; never inferred."""
    return spark.read.schema(PAGE).json(path)


def page_problems(pages: DataFrame) -> DataFrame:
    """(selector, page, problem) of failed pages and of pages that don't have
    either a cursor or the end mark."""
    cursor, final = F.col("next_cursor").isNotNull(), F.coalesce("final_chunk", F.lit(False))
    problem = F.when(~F.coalesce("success", F.lit(False)), F.coalesce("error", F.lit("failed"))).when(cursor == final, "cursor or final chunk")
    return pages.select("selector", "page", problem.alias("problem")).where("problem is not null")


def complete_pulls(pages: DataFrame) -> DataFrame:
    """(selector, pages, complete) of pulls: every page succeeds and has either
    a cursor or the end mark, and the end mark comes once."""
    ok = F.col("success") & (F.col("next_cursor").isNotNull() != F.col("final_chunk"))
    return pages.groupBy("selector").agg(F.count("*").alias("pages"), (F.bool_and(ok) & (F.count_if("final_chunk") == 1)).alias("complete"))


def metadata_items(pages: DataFrame, bounded: bool = True) -> DataFrame:
    """The pages' items, those within the bounds only or all; where one isn't,
    metadata_problems() of all items says that the pull fails."""
    m = pages.select(F.explode("metadata").alias("m")).select("m.*")
    return m.where((F.octet_length("source_path") <= MAX_PATH) & (F.octet_length("field_name") <= MAX_NAME)) if bounded else m


def dictionary_items(pages: DataFrame, bounded: bool = True) -> DataFrame:
    """The pages' values with their place, within the bounds only or all; see
    dictionary_problems()."""
    d = pages.select("selector", "page", F.posexplode("dictionary_values").alias("i", "d")).select("selector", "page", "i", "d.*")
    return d.where((F.octet_length("value") <= MAX_VALUE) & (F.length("category") <= MAX_CATEGORY) & (F.octet_length("source_path") <= MAX_PATH)) if bounded else d


def metadata_problems(items: DataFrame) -> DataFrame:
    """(problem, n) of a pull's metadata: items out of bounds, or none at all.
    Any row means that the pull fails as a whole."""
    long = (F.octet_length("source_path") > MAX_PATH) | (F.octet_length("field_name") > MAX_NAME) | F.coalesce(F.octet_length("field_type") > MAX_TYPE, F.lit(False))
    bad = items.where(long | F.col("source_path").isNull() | F.col("field_name").isNull()).groupBy(F.lit("item out of bounds").alias("problem")).agg(F.count("*").alias("n"))
    empty = items.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no metadata").alias("problem"), "n")
    return bad.unionByName(empty)


def dictionary_problems(values: DataFrame, requested: DataFrame, pull: str | None = None) -> DataFrame:
    """(problem, n) of a pull's values, given the sources asked for
    (source_path, category). Any row means that the pull fails as a whole.
    ``pull``: a column that tells pulls apart; each has its own bounds and its
    own rows (pull, problem, n)."""
    own = values.withColumn("__pull", F.lit(0) if pull is None else F.col(pull))
    long = (F.octet_length("value") > MAX_VALUE) | (F.length("category") > MAX_CATEGORY) | (F.octet_length("source_path") > MAX_PATH) | F.col("value").isNull()
    counted = lambda df, name: df.groupBy("__pull", F.lit(name).alias("problem")).agg(F.count("*").alias("n"))
    bad = counted(own.where(long), "item out of bounds")
    foreign = counted(own.join(requested, ["source_path", "category"], "left_anti"), "not requested")
    sums = own.groupBy("__pull").agg(F.count("*").alias("values"), F.countDistinct("source_path").alias("sources"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))
    over = sums.select("__pull", F.explode(F.array(*[F.struct(F.lit(f"too many {c}").alias("problem"), F.col(c).cast("long").alias("n"), F.lit(most).alias("most")) for c, most in MOST.items()])).alias("x")).select("__pull", "x.*").where("n > most").drop("most")
    all_ = bad.unionByName(foreign).unionByName(over)
    return all_.drop("__pull") if pull is None else all_.withColumnRenamed("__pull", pull)


def feed_problems(pages: DataFrame) -> DataFrame:
    """(selector, problem) of pulls with too many pages, a cursor out of
    bounds or a cursor that comes twice."""
    each = pages.groupBy("selector").agg(F.count("*").alias("n"), F.max(F.octet_length("next_cursor")).alias("longest"), F.count("next_cursor").alias("cursors"), F.countDistinct("next_cursor").alias("different"))
    problem = F.when(F.col("n") > MAX_PAGES, "too many pages").when(F.col("longest") > MAX_CURSOR, "cursor too long").when(F.col("cursors") > F.col("different"), "cursor given twice")
    return each.select("selector", problem.alias("problem")).where("problem is not null")


CALL = "call_id string, correlation_id string, tool_name string, caller string, arguments string, kind string, at timestamp_ntz"
MAX_BODY = 8 << 20


def read_calls(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Calls (raw) from JSON lines, as a table or as a stream; see parse_calls."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).withColumnRenamed("value", "raw")


def parse_calls(lines: DataFrame) -> DataFrame:
    """The fields of CALL and problem of raw call bodies (raw): too large, not
    JSON, or without call_id or tool_name. Batch and stream alike."""
    parsed = lines.select("raw", F.from_json("raw", CALL).alias("c"))
    problem = F.when(F.octet_length("raw") > MAX_BODY, "too large").when(F.try_parse_json("raw").isNull(), "not JSON").when(F.col("c.call_id").isNull() | F.col("c.tool_name").isNull(), "call_id and tool_name are needed")
    return parsed.select("c.*", problem.alias("problem"))
