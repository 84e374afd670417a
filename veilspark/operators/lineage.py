"""Whether the columns of query results are proved by their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What evidence may say, and columns that need no source.
COLUMN_KEYS = ("name", "type", "types", "sources", "sourceless", "unverified", "output_types")
LINEAGE_KEYS = ("column", "result_name", "name", "source_path", "source_type", "source_types", "secret_cut")
SOURCELESS = ("count", "literal", "parameter", "value", "composite")


def _known(keys: str, allowed: tuple[str, ...]):
    return F.forall(F.coalesce(keys, F.expr("cast(array() as array<string>)")), lambda k: k.isin(*allowed))


def valid_calls(calls: DataFrame, columns: DataFrame, lineage: DataFrame, cells: DataFrame) -> DataFrame:
    """(call_id, valid) of query results.

    calls: (call_id, rows, strict): how many rows the result's array has, null
    where it has no array; columns: (call_id, name, keys, sources, sourceless,
    unverified, output_types), each what the evidence says or null; lineage:
    (call_id, name, source_path, keys); cells: (call_id, name, kind) of the
    rows. A result without array isn't valid, one without rows is. Else every
    column has known keys, a name of its own and an array of sources; its
    lineage names exactly these sources, or it is of a kind without sources,
    or, in strict mode only, it is unverified with its output types. Every
    cell belongs to a column; those of columns without sources are scalars,
    of counts numbers.
    """
    strict = calls.select("call_id", "strict")
    own = columns.join(strict, "call_id")
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    free = F.coalesce("unverified", F.lit(False))
    sourced = ~free & (F.size("sources") > 0)
    shape = (
        F.when(free, F.col("strict") & F.col("sourceless").isNull() & F.col("output_types").isNotNull())
        .when(F.col("unverified").isNotNull(), False)
        .when(F.size("sources") == 0, F.coalesce(F.col("sourceless").isin(*SOURCELESS), F.lit(False)))
        .otherwise(F.col("sourceless").isNull() & F.forall("sources", lambda s: F.coalesce(s != "", F.lit(False))))
    )
    own = own.withColumn("fits", F.coalesce(named & _known("keys", COLUMN_KEYS) & F.col("sources").isNotNull() & shape, F.lit(False)))
    kinds = F.when(free, "unverified").when(sourced, "sourced").otherwise(F.col("sourceless"))
    listed = own.groupBy("call_id", "name").agg(F.count("*").alias("n"), F.bool_and("fits").alias("fits"), F.first(kinds).alias("is"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(sourced, F.col("sources")))))).alias("paths"))
    said = lineage.withColumn("good", F.coalesce(_known("keys", LINEAGE_KEYS) & F.col("name").isNotNull() & F.col("source_path").isNotNull(), F.lit(False)))
    proved = said.groupBy("call_id", "name").agg(F.bool_and("good").alias("good"), F.sort_array(F.collect_set("source_path")).alias("proved"))
    met = listed.join(proved, ["call_id", "name"], "full_outer")
    agree = F.when(F.col("is") == "unverified", True).when(F.col("is") == "sourced", F.col("paths") == F.coalesce("proved", F.expr("cast(array() as array<string>)"))).otherwise(F.col("proved").isNull())
    of_columns = met.groupBy("call_id").agg(F.bool_and(F.coalesce((F.col("n") == 1) & F.col("fits") & agree & F.coalesce("good", F.lit(True)), F.lit(False))).alias("columns_ok"))
    shown = cells.groupBy("call_id", "name").agg(F.bool_and(~F.col("kind").isin("object", "array")).alias("scalars"), F.bool_and(F.col("kind") == "number").alias("numbers"))
    allowed = F.when(F.col("is").isin("unverified", "sourced"), True).when(F.col("is") == "count", F.col("numbers")).when(F.col("is").isNotNull(), F.col("scalars"))
    of_cells = shown.join(listed.select("call_id", "name", "is"), ["call_id", "name"], "left").groupBy("call_id").agg(F.bool_and(F.coalesce(allowed, F.lit(False))).alias("cells_ok"))
    out = calls.join(of_columns, "call_id", "left").join(of_cells, "call_id", "left")
    valid = F.when(F.col("rows").isNull(), False).when(F.col("rows") == 0, True).otherwise(F.coalesce("columns_ok", F.lit(False)) & F.coalesce("cells_ok", F.lit(True)))
    return out.select("call_id", valid.alias("valid"))
