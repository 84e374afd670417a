"""JSON texts: canonical form, results as tools give them, report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an object has its display text, first one first.
DISPLAY_KEYS = ("Представление", "presentation", "ПредставлениеСсылки", "name", "text", "value")
_SCALARS = ("VOID", "BOOLEAN", "BIGINT", "DOUBLE", "STRING")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_scalar(value: Column) -> Column:
    kind = _kind(value)
    return value.isNull() | kind.isin(*_SCALARS) | kind.startswith("DECIMAL")


def _string(value: Column, path: str = "$") -> Column:
    """The string at ``path``; null where there is none or it isn't a string."""
    at = F.try_variant_get(value, path, "variant")
    return F.when(_kind(at) == "STRING", F.try_variant_get(value, path, "string"))


def canonical_json(text: Column) -> Column:
    """Compact JSON with the keys of all objects in order; null for bad JSON."""
    return F.to_json(F.try_parse_json(text))


def content_hash(text: Column) -> Column:
    """``sha256:`` and the digest of the canonical form."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text), 256))


def wrap_result(text: Column) -> Column:
    """A tool's result as content: what has typed content blocks stays, else
    one text block (a string verbatim, other values as canonical JSON) with
    is_error where it says success false or is_error true. Null for bad JSON."""
    value = F.try_parse_json(text)
    blocks = F.try_variant_get(value, "$.content", "array<variant>")
    typed = F.coalesce((F.size(blocks) > 0) & F.forall(blocks, lambda b: _string(b, "$.type").isNotNull()), F.lit(False))
    flag = lambda key: F.when(_kind(F.try_variant_get(value, f"$.{key}", "variant")) == "BOOLEAN", F.try_variant_get(value, f"$.{key}", "boolean"))
    failed = F.coalesce(~flag("success"), F.lit(False)) | F.coalesce(flag("is_error"), F.lit(False))
    body = F.coalesce(_string(value), F.to_json(value))
    wrapped = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), body.alias("text"))).alias("content"), failed.alias("is_error")))
    return F.when(value.isNotNull(), F.when(typed, F.to_json(value)).otherwise(wrapped))


def unwrap_result(text: Column) -> Column:
    """What wrap_result() has wrapped: the first text block, as JSON where it
    is JSON and else as a JSON string; other values in canonical form."""
    value = F.try_parse_json(text)
    blocks = F.try_variant_get(value, "$.content", "array<variant>")
    first = _string(F.get(F.filter(blocks, lambda b: _string(b, "$.type") == "text"), F.lit(0)), "$.text")
    quoted = F.to_json(F.struct(first.alias("v")))
    as_string = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    return F.when(first.isNotNull(), F.coalesce(canonical_json(first), as_string)).otherwise(F.to_json(value))


def envelope_body(text: Column) -> Column:
    """What a feed's answer holds, as canonical JSON: structured content that
    is an object, else the first content item's JSON or its text as JSON, else
    the answer itself where it says whether it was a success. Null for others
    and for bad JSON."""
    value = F.try_parse_json(text)
    at = lambda path: F.try_variant_get(value, path, "variant")
    structured = at("$.structured_content")
    kind = _string(value, "$.content[0].type")
    inner = F.try_parse_json(_string(value, "$.content[0].text"))
    item = F.when((kind == "json") & at("$.content[0].json").isNotNull(), F.to_json(at("$.content[0].json")))
    is_text = (kind == "text") & _string(value, "$.content[0].text").isNotNull()
    own = F.when(at("$.success").isNotNull(), F.to_json(value))
    return F.when(F.coalesce(_kind(structured).startswith("OBJECT"), F.lit(False)), F.to_json(structured)).when(item.isNotNull(), item).when(F.coalesce(is_text, F.lit(False)), F.to_json(inner)).otherwise(own)


def cell_scalar(text: Column) -> Column:
    """A report cell from a JSON value: scalars as text, of objects their
    display text, else canonical JSON; null stays null."""
    value = F.try_parse_json(text)
    display = F.coalesce(*[_string(value, f"$['{k}']") for k in DISPLAY_KEYS])
    return F.when(_kind(value) == "VOID", None).otherwise(F.coalesce(_string(value), display, F.to_json(value)))


def report_safe(text: Column) -> Column:
    """Whether a report is of version 1, its blocks are texts or tables, and
    every table's rows have a scalar for each column."""
    value = F.try_parse_json(text)
    columns = lambda b: F.try_variant_get(b, "$.columns", "array<variant>")
    rows = lambda b: F.try_variant_get(b, "$.rows", "array<array<variant>>")
    table = lambda b: F.forall(rows(b), lambda r: (F.size(r) == F.size(columns(b))) & F.forall(r, _is_scalar))
    block = lambda b: F.coalesce((_string(b, "$.kind") == "text") & _string(b, "$.text").isNotNull(), F.lit(False)) | F.coalesce((_string(b, "$.kind") == "table") & table(b), F.lit(False))
    whole = (F.try_variant_get(value, "$.version", "int") == 1) & F.forall(F.try_variant_get(value, "$.blocks", "array<variant>"), block)
    return F.coalesce(whole, F.lit(False))
