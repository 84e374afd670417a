"""Reports, reasons and result grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what counts as a date in a grid.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"


def reason_cells(reasons: DataFrame) -> DataFrame:
    """(doc_id, ptr, reasons): sorted distinct reasons of each cell."""
    return reasons.groupBy("doc_id", "ptr").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def reason_index(reasons: DataFrame) -> DataFrame:
    """(reason, idx): reasons numbered by first occurrence (pos)."""
    first = reasons.groupBy("reason").agg(F.min("pos").alias("pos"))
    return first.select("reason", (F.row_number().over(Window.orderBy("pos", "reason")) - 1).alias("idx"))


def column_types(cells: DataFrame) -> DataFrame:
    """(field, type): one type, ``mixed`` or ``null``, from cells (field,
    value)."""
    kind = F.when(F.col("value").isNull(), None).when(F.col("value").rlike(r"^-?\d+(\.\d+)?$"), "number").when(F.col("value").isin("true", "false"), "boolean").otherwise("string")
    kinds = cells.groupBy("field").agg(F.collect_set(kind).alias("k"))
    return kinds.select("field", F.when(F.size("k") == 0, "null").when(F.size("k") == 1, F.element_at("k", 1)).otherwise("mixed").alias("type"))


def range_filter(column: Column, text: str) -> Column:
    """``a..b``, ``..b`` or ``a..`` (inclusive, decimal commas allowed)."""
    low, _, high = text.replace(" ", "").replace(",", ".").partition("..")
    out = column.isNotNull()
    if low:
        out &= column >= float(low)
    if high:
        out &= column <= float(high)
    return out


def contains_text(columns: list[str], text: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out |= F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    return out


def call_title(text: Column, most: int) -> Column:
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) > most, F.concat(F.substring(trimmed, 1, most), F.lit("…"))).otherwise(trimmed)


def tree_level(items: DataFrame, prefix: str) -> DataFrame:
    """(segment, fields, passwords, deeper) of the level below ``prefix`` of
    items (source_path, password_mode)."""
    below = items.where(F.col("source_path").startswith(prefix)).withColumn("rest", F.substring("source_path", F.lit(len(prefix) + 1), F.length("source_path")))
    below = below.withColumn("segment", F.substring_index("rest", ".", 1))
    return below.groupBy("segment").agg(F.count("*").alias("fields"), F.sum(F.col("password_mode").cast("int")).cast("long").alias("passwords"), F.bool_or(F.contains("rest", F.lit("."))).alias("deeper"))


def report_columns(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, place): a table's columns, those of the schema (pos, id) in its
    order, then other keys (id) of the rows in order without regard to case."""
    from ..functions.text import ascii_lower

    extra = keys.select("id").distinct().join(columns.select("id"), "id", "left_anti").select(F.lit(1).alias("part"), F.lit(None).cast("int").alias("pos"), "id")
    both = columns.select(F.lit(0).alias("part"), "pos", "id").unionByName(extra)
    w = Window.orderBy("part", "pos", ascii_lower(F.col("id")), "id")
    return both.select("id", F.row_number().over(w).alias("place"))


def to_csv(table: DataFrame, path: str) -> None:
    """A grid as CSV files: ``;`` between fields, quotes doubled."""
    table.write.option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)


def count_label(n: Column) -> Column:
    """Compact counts: ~1.2 mln, ~150 k, ~999."""
    return F.when(n >= 1_000_000, F.concat(F.lit("~"), F.round(n / 1_000_000, 1).cast("string"), F.lit(" mln"))).when(n >= 1000, F.concat(F.lit("~"), F.floor(n / 1000).cast("string"), F.lit(" k"))).otherwise(F.concat(F.lit("~"), n.cast("string")))


def natural_key(text: Column, digits: int = 20) -> Column:
    """A sort key by which numbers within texts are in order of their value."""
    from ..functions.text import replace_matches

    return replace_matches(F.lower(text), "[0-9]+", lambda m: F.lpad(m, digits, "0"))


def tsv_line(columns: list[str]) -> Column:
    """A row as it is copied: tabs between cells, white space in them one
    space, nulls empty."""
    return F.concat_ws("\t", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " "), F.lit("")) for c in columns])


def pointer_values(leaves: DataFrame, pointers: DataFrame) -> DataFrame:
    """(doc_id, pointer, rest, kind, value): the leaves (doc_id, ptr, kind,
    value) of the value that each pointer (doc_id, pointer) names, with the
    rest of their path, which is empty for a leaf itself. Pointers that name
    nothing have no rows. One equi-join: a leaf is met under each of its own
    prefixes."""
    steps = F.split("ptr", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    under = leaves.select("doc_id", F.explode(up).alias("pointer"), "ptr", "kind", "value")
    met = under.join(pointers.select("doc_id", "pointer").distinct(), ["doc_id", "pointer"])
    return met.select("doc_id", "pointer", F.substring("ptr", F.length("pointer") + 1, F.length("ptr")).alias("rest"), "kind", "value")


def object_fields(items: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """The first ``most`` items (source_path, field_name) below an object, in order."""
    return items.where(F.col("source_path").startswith(f"{name}.")).orderBy("source_path", "field_name").limit(most)


def number_text(x: Column, digits: int = 2, group: str = " ", point: str = ",") -> Column:
    """A number as a locale shows it: groups of three and a decimal mark."""
    return F.translate(F.format_number(x, digits), ",.", group + point)


def date_text(x: Column, pattern: str = "dd.MM.yyyy HH:mm:ss") -> Column:
    return F.date_format(x, pattern)


def bounded_setting(text: str | None, default: int, low: int, high: int) -> int:
    """A whole number from a setting; ``default`` where it is none or out of bounds."""
    try:
        x = int((text or "").strip())
    except ValueError:
        return default
    return x if low <= x <= high else default


def tool_list(tools: DataFrame, text: str = "", added: bool | None = None) -> DataFrame:
    """Tools (tool, mode, auto_added) whose name contains ``text`` in any case,
    auto-added ones or others only, by name."""
    out = tools.where(F.contains(F.lower("tool"), F.lit(text.lower())))
    return (out if added is None else out.where(F.col("auto_added") == added)).orderBy("tool")


def timing(runs: DataFrame, group: str, key: str, value: str, budget: float) -> DataFrame:
    """(group, upper_median, slowest, slowest_id, over_budget) of the times of
    runs: the median is the upper one, the slowest of equals has the least key.
    One aggregation, combined before the shuffle; times are counted, never sorted as rows."""
    return runs.groupBy(group).agg(
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)").alias("upper_median"), F.max(value).alias("slowest"),
        F.max_by(key, F.struct(value, -F.col(key))).alias("slowest_id"), F.count_if(F.col(value) > budget).alias("over_budget"),
    )


def refresh_state(databases: DataFrame, intents: DataFrame, generations: DataFrame) -> DataFrame:
    """(database, state) of databases (database, mode): disabled, or what their
    refresh intent (database, state) says, or ready where a generation
    (database, status) is active, else empty."""
    active = generations.where("status = 'active'").select("database").distinct().withColumn("__active", F.lit(True))
    met = databases.join(intents.select("database", F.col("state").alias("__state")), "database", "left").join(active, "database", "left")
    return met.select("database", F.when(F.col("mode") != "enabled", "disabled").when(F.col("__state").isNotNull(), F.col("__state")).when(F.col("__active"), "ready").otherwise("empty").alias("state"))


def typed_order(value: Column, kind: str, down: bool = False) -> list[Column]:
    """Sort keys of a grid column: numbers, booleans and dates by value, texts
    in any case with numbers in order of their value; empty cells last, and
    first where the order is turned round."""
    empty = value.isNull() | (value == "")
    key = {"number": lambda: value.cast("double"), "boolean": lambda: (value == "true").cast("int"), "date": lambda: F.try_to_timestamp(value)}.get(kind, lambda: natural_key(value))()
    return [empty.desc(), key.desc(), value.desc()] if down else [empty.asc(), key.asc(), value.asc()]


def grid_types(cells: DataFrame) -> DataFrame:
    """(col, type) of a grid's columns, from cells (col, value): date where
    all values are dates, else string."""
    kind = F.when(F.col("value").isNotNull(), F.when(F.col("value").rlike(ISO_DATE), "date").otherwise("string"))
    kinds = cells.groupBy("col").agg(F.collect_set(kind).alias("k"))
    return kinds.select("col", F.when(F.size("k") == 1, F.element_at("k", 1)).otherwise("string").alias("type"))


def databases_by_label(databases: DataFrame) -> DataFrame:
    """(place, database, label) of databases (database, label) in order of the
    label, of those without one in that of their id, which is shown as label;
    ties by id. Databases are a list that one person manages."""
    shown = databases.select("database", F.coalesce("label", "database").alias("label"))
    return shown.withColumn("place", F.row_number().over(Window.orderBy(F.col("label").cast("binary"), "database"))).select("place", "database", "label")
