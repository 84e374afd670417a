"""Whole results: literals of a document, and the cascade end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REMOVED, cut_secret_values, mask_token, secret_name
from . import policy
from .cascade import RULES, Policy, cascade, expand, json_escaped  # noqa: F401
from .masking import is_person_field


def _literals(cells: DataFrame, which: Column, name: str) -> DataFrame:
    """The texts of the cells that ``which`` names, of each document, longest
    first; texts of the same length in order."""
    found = cells.where(which & (F.col("value") != "")).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("value").alias("v"))
    ordered = F.array_sort(F.transform("v", lambda x: F.struct((-F.octet_length(x)).alias("n"), x.alias("x"))))
    return found.select("__doc", F.transform(ordered, lambda s: s["x"]).alias(name))


def _fold(text: Column, literals: Column, make) -> Column:
    return F.aggregate(F.coalesce(literals, F.expr("cast(array() as array<string>)")), text, lambda t, x: F.replace(t, x, make(x)))


def cut_secrets(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, ptr, field, value) without secrets: cells of secret
    fields go whole, their texts go wherever the same document repeats them,
    as they are and as JSON escapes them, and so do texts of the shape of a
    secret. Null values stay null."""
    met = cells.join(_literals(cells, secret_name(F.col("field")), "__secrets"), F.col("doc_id") == F.col("__doc"), "left")
    cut = F.when(F.col("value").isNotNull() & secret_name(F.col("field")), REMOVED).otherwise(cut_secret_values(_fold(_fold(F.col("value"), F.transform("__secrets", json_escaped), lambda x: F.lit(REMOVED)), F.col("__secrets"), lambda x: F.lit(REMOVED))))
    return met.select("doc_id", "ptr", "field", cut.alias("value"))


def mask_person_literals(cells: DataFrame) -> DataFrame:
    """Cells in which persons' names are tokens: cells of person fields as a
    whole, elsewhere each occurrence of those names in the same document."""
    met = cells.join(_literals(cells, is_person_field(F.col("field")), "__people"), F.col("doc_id") == F.col("__doc"), "left")
    person = is_person_field(F.col("field")) & (F.col("value") != "")
    token = lambda x: mask_token(F.lit("FIO"), x)
    return met.select("doc_id", "ptr", "field", F.when(person, token(F.col("value"))).otherwise(_fold(F.col("value"), F.col("__people"), token)).alias("value"))


def decisions(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """(field, action, category, secret_cut, unverified) of the columns in
    ``evidence`` (see policy.evidence); fields are matched, not cells."""
    paths = F.transform("source_paths", lambda x: F.struct(F.lit("source_path").alias("selector"), x.alias("value")))
    types = F.transform("field_types", lambda x: F.struct(F.lit("type").alias("selector"), x.alias("value")))
    own = F.array(F.struct(F.lit("name").alias("selector"), F.col("field").alias("value")))
    fields = evidence.select("field", F.inline(F.concat(own, paths, types)))
    return evidence.select("field", "secret_cut", "unverified").join(policy.structural_action(policy.strongest_rules(fields, rules)), "field", "left")


def protect(cells: DataFrame, evidence: DataFrame, rules: DataFrame, dictionary: dict[str, str], regexes: list[tuple[str, ...]], actions: dict[str, str] | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """(doc_id, ptr, value, reason) of result cells by cascade(); the reason is
    what decided, null where nothing changed. ``regexes``: (pattern, category,
    and mask, keep or secret: mask if left out); ``actions``: the action of a
    dictionary category, mask where it has none. Both come before ``rules``."""
    spark = cells.sparkSession
    more = [(i, "regex", p, a, c, 0) for i, (p, c, a) in enumerate((*r, "mask")[:3] for r in regexes)] + [(0, "dictionary", c, a, c, 1 << 30) for c, a in (actions or {}).items()]
    both = rules.select(*[F.col(c) for c in ("pos", "selector", "pattern", "action", "category", "priority")]).where("selector not in ('regex', 'dictionary')")
    own = Policy(both.union(spark.createDataFrame(more, RULES)) if more else both, dictionary, manifest)
    done = cascade(cells, evidence, own)
    return done.select("doc_id", "ptr", "value", F.when((F.col("why") != "kept") & ((F.col("why") != "text") | F.exists("reasons", lambda r: r["action"] != "keep")), F.col("why")).alias("reason"))
