"""Reports of whole results: blocks, tables, and where each path stands.

A result gives text blocks and tables; a table's cells have a row and a column.
A path belongs to the cell or block at its nearest ancestor: paths are exploded
to their ancestors and joined on equal keys, the longest match stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import DISPLAY_KEYS
from ..functions.text import REMOVED, ascii_lower, pointer_escape
from ..session import written

_KIND = {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string"}
#: Types of cells with a value.
_TYPES = ("boolean", "number", "string")


def ancestors(pointer: Column) -> Column:
    """A path's ancestors, the root and itself included."""
    parts = F.split(pointer, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def nearest(pointers: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """``pointers`` (keys, ptr) with the columns of ``known`` (keys, ptr, ...)
    at the nearest ancestor of each path, null where there is none. Needs no
    comparison of paths but equality."""
    found = [c for c in known.columns if c not in (*keys, "ptr")]
    each = pointers.select(*keys, "ptr", F.explode(ancestors(F.col("ptr"))).alias("__at"))
    met = each.join(known.withColumnRenamed("ptr", "__at"), [*keys, "__at"], "left")
    best = met.groupBy(*keys, "ptr").agg(F.max_by(F.struct(*found), F.when(F.col("__there"), F.length("__at"))).alias("x")) if "__there" in found else None
    if best is None:
        return nearest(pointers, known.withColumn("__there", F.lit(True)), *keys)
    return best.select(*keys, "ptr", *[F.col(f"x.{c}") for c in found if c != "__there"])


def _string(value: Column, path: str = "$") -> Column:
    at = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(value, path, "string"))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def result_blocks(results: DataFrame) -> DataFrame:
    """(doc_id, block, ptr, rows_ptr, kind, text, rows) of results (doc_id,
    json): typed content in its order, then the structured content, else the
    result as a whole.

    A block is a table where its value, or what it has as rows or data, is an
    array of objects that have keys at all; everything else is text, JSON in canonical form.
    Bad JSON is one text block as it is; null has no blocks.
    """
    none = F.lit(None).cast("string")
    item = lambda ptr, text, value: F.struct(ptr.alias("ptr"), text.alias("text"), value.alias("value"))
    empty = F.try_parse_json(F.lit(None).cast("string"))
    no_items = F.expr("cast(array() as array<struct<ptr:string,text:string,value:variant>>)")

    def typed(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("/content/"), i.cast("string"))
        kind = _string(x, "$.type")
        body = F.try_variant_get(x, "$.json", "variant")
        return F.when((kind == "text") & _string(x, "$.text").isNotNull(), item(at, _string(x, "$.text"), empty)).when(kind == "json", item(F.concat(at, F.lit("/json")), none, F.coalesce(body, F.parse_json(F.lit("null")))))

    # each step is a projection of its own: what is used twice is worked out once
    parsed = results.where("json is not null").select("doc_id", "json", F.try_parse_json("json").alias("v"))
    parts = parsed.select("doc_id", "json", "v", F.try_variant_get("v", "$.content", "array<variant>").alias("content"), F.try_variant_get("v", "$.structured_content", "variant").alias("structured"))
    listed = F.coalesce(F.filter(F.transform("content", typed), lambda b: b.isNotNull()), no_items)
    some = F.concat(listed, F.when(F.col("structured").isNotNull(), F.array(item(F.lit("/structured_content"), none, F.col("structured")))).otherwise(no_items))
    whole = F.array(item(F.lit(""), F.when(F.col("v").isNull(), F.col("json")), F.col("v")))
    each = parts.select("doc_id", "json", "v", some.alias("some")).select("doc_id", F.posexplode(F.when(F.size("some") > 0, F.col("some")).otherwise(whole)).alias("block", "b")).select("doc_id", "block", "b.*")
    array = lambda path: F.try_variant_get("value", path, "array<variant>")
    each = each.select("*", array("$").alias("own"), array("$.rows").alias("in_rows"), array("$.data").alias("in_data"))
    at = F.when(F.col("own").isNotNull(), F.col("ptr")).when(F.col("in_rows").isNotNull(), F.concat("ptr", F.lit("/rows"))).when(F.col("in_data").isNotNull(), F.concat("ptr", F.lit("/data")))
    each = each.select("doc_id", "block", "ptr", "text", "value", F.coalesce("own", "in_rows", "in_data").alias("rows"), at.alias("rows_ptr"))
    each = each.withColumn("kinds", F.transform("rows", F.schema_of_variant))
    table = F.coalesce((F.size("kinds") > 0) & F.forall("kinds", lambda k: k.startswith("OBJECT")) & F.exists("kinds", lambda k: k != "OBJECT<>"), F.lit(False))
    each = each.withColumn("table", table)
    return each.select("doc_id", "block", "ptr", F.when(F.col("table"), F.col("rows_ptr")).alias("rows_ptr"), F.when(F.col("table"), "table").otherwise("text").alias("kind"), F.when(~F.col("table"), F.coalesce("text", F.to_json("value"))).alias("text"), F.when(F.col("table"), F.col("rows")).alias("rows"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, row, key, ptr, type, value) of the tables among
    ``blocks``: type is that of the JSON value, and what isn't a scalar has its
    display text, else canonical JSON."""
    rows = blocks.where("kind = 'table'").select("doc_id", "block", "rows_ptr", F.posexplode("rows").alias("row", "object"))
    spark = blocks.sparkSession
    cells = rows.lateralJoin(spark.tvf.variant_explode(F.col("object").outer())).select("doc_id", "block", "row", "key", F.concat_ws("/", "rows_ptr", F.col("row").cast("string"), pointer_escape(F.col("key"))).alias("ptr"), F.col("value").alias("v"))
    kind = F.schema_of_variant("v")
    scalar = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in _KIND.items()], F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), "string"), F.lit("number"))
    shown = F.coalesce(*[_string(F.col("v"), f"$['{k}']") for k in DISPLAY_KEYS])
    text = F.when(scalar == "null", None).when(kind == "STRING", F.try_variant_get("v", "$", "string")).when(kind.startswith("OBJECT"), F.coalesce(shown, F.to_json("v"))).otherwise(F.to_json("v"))
    return cells.select("doc_id", "block", "row", "key", "ptr", scalar.alias("type"), text.alias("value"))


def outline(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, ptr, row, key, cell) of ``blocks``: a row for each cell
    (cell: its path) and for each block that has none, without any value, in
    the shared folder: results are read once, however often it is used."""
    rows = blocks.select("doc_id", "block", "ptr", "rows_ptr", F.posexplode_outer("rows").alias("row", "object"))
    each = rows.lateralJoin(blocks.sparkSession.tvf.variant_explode_outer(F.col("object").outer()))
    at = F.when(F.col("key").isNotNull(), F.concat_ws("/", "rows_ptr", F.col("row").cast("string"), pointer_escape(F.col("key"))))
    return written(each.select("doc_id", "block", "ptr", "row", "key", at.alias("cell")), "outline")


def table_columns(cells: DataFrame, schema: DataFrame) -> DataFrame:
    """(doc_id, block, col, id, type, masked) of tables' cells: the columns of
    the result's schema (doc_id, pos, name) in their order, under the name that
    the rows give them without regard to ASCII case, then all other keys in
    order. type: the one type of the values, mixed, or null."""
    bits = {k: 1 << i for i, k in enumerate(_TYPES)}
    code = F.coalesce(*[F.when(F.col("type") == k, F.lit(n)) for k, n in bits.items()], F.lit(0))
    masked = F.coalesce(F.contains("value", F.lit("[MASK:v1:")) | F.contains("value", F.lit(REMOVED)), F.lit(False))
    # numbers only: values are never sorted or sent; all that follows has a row for each key
    small = cells.select("doc_id", "block", "row", "key", code.alias("types"), masked.alias("masked"))
    keys = written(small.groupBy("doc_id", "block", "key").agg(F.min("row").alias("row"), F.bit_or("types").alias("types"), F.max("masked").alias("masked")), "keys")
    tables = keys.select("doc_id", "block").repartition("doc_id").distinct()
    names = schema.where("name is not null").select("doc_id", ascii_lower(F.col("name")).alias("low"), F.struct("pos", "name").alias("s")).repartition("doc_id")
    wanted = names.groupBy("doc_id", "low").agg(F.min("s").alias("s")).join(tables, "doc_id")
    # keys and wanted names meet in one shuffle, in which the places are numbered too
    both = keys.withColumn("low", ascii_lower(F.col("key"))).unionByName(wanted.withColumns({"types": F.lit(0), "masked": F.lit(False)}), allowMissingColumns=True).repartition("doc_id", "block")
    order = Window.partitionBy("doc_id", "block", "low").orderBy(F.col("row").asc_nulls_last(), "key")
    alike = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = both.select("doc_id", "block", "low", "key", "types", "masked", F.max("s").over(alike).alias("s"), F.struct(F.first("key").over(alike).alias("key"), F.bit_or("types").over(alike).alias("types"), F.max("masked").over(alike).alias("masked")).alias("all"), F.row_number().over(order).alias("n"))
    own = F.col("s").isNull()
    each = met.where(own | (F.col("n") == 1)).select(
        "doc_id", "block", F.when(own, 1).otherwise(0).alias("extra"), F.when(own, F.lit(0)).otherwise(F.col("s.pos")).alias("pos"), F.when(own, F.col("key")).otherwise(F.coalesce("all.key", "s.name")).alias("id"),
        F.when(own, F.col("types")).otherwise(F.col("all.types")).alias("types"), F.when(own, F.col("masked")).otherwise(F.col("all.masked")).alias("masked"), "low",
    )
    place = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("extra", "pos", F.col("id").cast("binary"))) - 1
    kind = F.coalesce(F.when(F.col("types") == 0, "null"), *[F.when(F.col("types") == n, k) for k, n in bits.items()], F.lit("mixed"))
    return each.select("doc_id", "block", place.alias("col"), "id", kind.alias("type"), "masked", "low")


def coordinates(leaves: DataFrame, blocks: DataFrame, cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, ptr, block, row, col) of paths (doc_id, ptr): that of the cell
    at or above the path, else of its block without row and column; what is in
    no block counts as in the first one."""
    first = columns.groupBy("doc_id", "block", "low").agg(F.min("col").alias("col"))
    own = cells.withColumn("low", ascii_lower(F.col("key"))).join(first, ["doc_id", "block", "low"]).select("doc_id", "ptr", "block", "row", "col")
    none = F.lit(None).cast("int")
    known = own.unionByName(blocks.select("doc_id", "ptr", "block", none.alias("row"), none.alias("col")))
    met = nearest(leaves.select("doc_id", "ptr"), known, "doc_id")
    return met.select("doc_id", "ptr", F.coalesce("block", F.lit(0)).alias("block"), "row", "col")


def result_coordinates(leaves: DataFrame, results: DataFrame, schema: DataFrame) -> DataFrame:
    """coordinates() of the paths ``leaves`` (doc_id, ptr) of results (doc_id,
    json) with their schema (doc_id, pos, name), by way of outline()."""
    found = outline(result_blocks(results))
    none = F.lit(None).cast("string")
    cells = found.where("key is not null").select("doc_id", "block", "row", "key", F.col("cell").alias("ptr"), none.alias("type"), none.alias("value"))
    return coordinates(leaves, found.select("doc_id", "block", "ptr").distinct(), cells, table_columns(cells, schema))
