"""Cells and the masking cascade."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PERSON_NAME, PERSON_VALUE, REMOVED, SECRET_VALUE, cut_secret_values, mask_matches, mask_token, pointer_escape, secret_name

MAX_DEPTH = 64


def unpivot(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Cells (doc_id, ptr, field, value) of a typed table, one row a cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")
    return table.select(F.col(key).alias("doc_id"), cells).select("doc_id", F.concat(F.lit("/"), pointer_escape(F.col("c.field"))).alias("ptr"), "c.field", "c.value")


class _Big(float):
    """A number beyond floats, with its text."""

    text = ""


def _number(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        x = _Big(x)
        x.text = text
    return x


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


_READ = json.JSONDecoder(parse_float=_number, parse_constant=_refused).decode


def _walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {bool: "boolean", int: "number", float: "number", _Big: "number", str: "string", type(None): "null"}
    for frame in frames:
        out: dict[str, list] = {k: [] for k in ("doc_id", "ptr", "field", "kind", "value")}
        for doc, text in zip(frame["doc_id"].to_pylist(), frame["json"].to_pylist(), strict=True):
            try:
                todo = [("", "", _READ(text), 0)] if text is not None else []
            except (ValueError, RecursionError):
                todo = []
            while todo:
                ptr, field, x, depth = todo.pop()
                if isinstance(x, (dict, list)) and depth < MAX_DEPTH:
                    items = x.items() if isinstance(x, dict) else enumerate(x)
                    # array items keep the name of the field that holds them
                    todo += [(f"{ptr}/{str(k).replace('~', '~0').replace('/', '~1')}", k if isinstance(x, dict) else field, v, depth + 1) for k, v in items]
                    continue
                kind = kinds.get(type(x), "too deep")
                value = x if isinstance(x, str) else None if kind == "too deep" else x.text if isinstance(x, _Big) else json.dumps(x)
                for k, v in zip(out, (doc, ptr, field, kind, value), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("ptr", pa.string()), ("field", pa.string()), ("kind", pa.string()), ("value", pa.string())]))


def walk_json(docs: DataFrame) -> DataFrame:
    """Leaves (doc_id, ptr, field, kind, value) of JSON documents (doc_id,
    json) of any shape. Bad JSON has none, which NaN, infinities and texts too
    deep to be read are too; parts below MAX_DEPTH are leaves of kind ``too
    deep``; of keys that repeat in an object the last counts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("json").cast("string").alias("json")).mapInArrow(_walk, "doc_id long, ptr string, field string, kind string, value string")


def is_person_field(field: Column) -> Column:
    return field.rlike(f"(?iu){PERSON_NAME}")


def verdict(field: Column, value: Column, action: Column, secret_cut: Column | None = None, held: Column | None = None, unverified: Column | None = None, secret_patterns: list[str] = ()) -> Column:
    """What decides about one cell: the first that applies of the marker of
    removal (kept), a secret field or source (``secret_cut``), the shape of a
    secret, a secret rule, a secret dictionary value (``held``: its category,
    or null), a secret pattern, an unverified column, a person's field, a
    mask rule, else its text. ``action`` is the structural decision or null."""
    no = F.lit(False)
    secret_regex = no
    for pattern in secret_patterns:
        secret_regex |= value.rlike(pattern)
    held = F.lit(None).cast("string") if held is None else held
    return (
        F.when(F.coalesce(unverified, no) if unverified is not None else no, "unverified").when(value.isNull() | (value == REMOVED), "kept")
        .when(secret_name(field) | (F.coalesce(secret_cut, no) if secret_cut is not None else no), "secret:name")
        .when(value.rlike(f"(?i){SECRET_VALUE}"), "secret:value")
        .when(F.coalesce(action, F.lit("")) == "secret", "secret:rule")
        .when(held.isNotNull(), F.concat(F.lit("dictionary:"), held, F.lit(":secret")))
        .when(secret_regex, "secret:regex")
        .when(is_person_field(field) & (value != ""), "person:field").when(action == "mask", "rule:mask").otherwise("text")
    )


def rendered(why: Column, value: Column, kind: Column, free: Column, json_kind: Column | None = None) -> Column:
    """The cell after verdict() ``why``: ``kind`` is the category of its rule,
    ``free`` its text with all that is replaced in it. A token stands for the
    value itself, never for one in which parts are tokens already; an
    unverified cell's token has the kind of its JSON value, null too."""
    json_kind = F.lit("string") if json_kind is None else F.coalesce(json_kind, F.lit("string"))
    typed = F.concat(F.lit("UNVERIFIED_"), F.when(json_kind == "boolean", "BOOL").otherwise(F.upper(json_kind)))
    return (
        F.when(why == "kept", value).when(why.startswith("secret:") & (why != "secret:value") | why.startswith("dictionary:"), REMOVED).when(why == "secret:value", cut_secret_values(value))
        .when(why == "unverified", mask_token(typed, F.coalesce(value, F.lit("null")))).when(why == "person:field", mask_token(F.lit("FIO"), value)).when(why == "rule:mask", mask_token(kind, value)).otherwise(free)
    )


def mask_cell(field: Column, value: Column, action: Column, kind: Column, regexes: list[tuple[str, str, str]] = ()) -> Column:
    """The cascade for one string cell as one expression, without literals of
    its document and without a dictionary: verdict(), then persons' names and
    matches of ``regexes`` (pattern, category, action) in order. ``action``
    and ``kind`` are the structural decision and its category, or null.
    """
    free = mask_matches(value, PERSON_VALUE, "FIO")
    for pattern, cat, what in regexes:
        if what == "mask":
            free = mask_matches(free, pattern, cat)
    why = verdict(field, value, action, secret_patterns=[p for p, _, what in regexes if what == "secret"])
    return rendered(why, value, kind, free)


def cell_status(value: Column) -> Column:
    return F.when(F.contains(value, F.lit(REMOVED)), "secret").when(F.contains(value, F.lit("[MASK:v1:")), "masked").otherwise("open")


def bounds(cells: DataFrame, max_depth: int, max_cells: int, max_bytes: int, max_items: int | None = None, max_text: int | None = None) -> DataFrame:
    """(doc_id, depth, cells, bytes, ok): sizes of each document, all bytes
    of its texts together. ``max_items`` bounds arrays (the highest index of a
    path, from 0), ``max_text`` each text."""
    depth = F.length("ptr") - F.length(F.replace("ptr", F.lit("/"), F.lit("")))
    index = F.array_max(F.transform(F.split("ptr", "/"), lambda x: F.expr("cast(-1 as long)") if max_items is None else F.coalesce(F.when(x.rlike("^[0-9]{1,18}$"), x.cast("long")), F.lit(-1).cast("long"))))
    out = cells.groupBy("doc_id").agg(
        F.max(depth).cast("long").alias("depth"), F.count("*").alias("cells"), F.sum(F.octet_length("value")).cast("long").alias("bytes"), F.max(index).alias("__index"), F.max(F.octet_length("value")).alias("__text"),
    )
    ok = (F.col("depth") <= max_depth) & (F.col("cells") <= max_cells) & (F.col("bytes") <= max_bytes)
    if max_items is not None:
        ok &= F.col("__index") < max_items
    if max_text is not None:
        ok &= F.coalesce("__text", F.lit(0)) <= max_text
    return out.withColumn("ok", ok).drop("__index", "__text")


#: Field names that make a result unsafe.
UNSAFE = ("binary", "html", "script", "formatter")


def unsafe_documents(cells: DataFrame) -> DataFrame:
    """(doc_id, unsafe): whether any name on any path is an unsafe one."""
    parts = F.split(F.lower("ptr"), "/")
    return cells.groupBy("doc_id").agg(F.bool_or(F.arrays_overlap(parts, F.array(*[F.lit(x) for x in UNSAFE]))).alias("unsafe"))
