"""Rules, evidence and the strongest rule of each field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import action_rank
from . import patterns


def strongest(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """(field, selector, pos, pattern, action, category): the strongest rule
    of each (field, selector).

    fields: (field, selector, value), distinct; rules: (pos, selector,
    pattern, action, category, priority). Stricter actions win over priority,
    priority over position, and of full ties the last rule. Wildcards are
    matched once per distinct field value, never per cell.
    """
    r = rules.select("selector", "pattern", *[F.col(c).alias(f"r_{c}") for c in ("pos", "action", "category", "priority")])
    met = patterns.matches(r, fields, "selector").withColumn("r_pattern", F.col("pattern"))
    order = [action_rank(F.col("r_action")).desc(), F.col("r_priority").desc(), F.col("r_pos").desc()]
    w = Window.partitionBy("field", "selector").orderBy(*order)
    return met.withColumn("n", F.row_number().over(w)).where("n = 1").select("field", "selector", *[F.col(f"r_{c}").alias(c) for c in ("pos", "pattern", "action", "category")])


def strongest_rules(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """(field, selector, pos, action, category) of strongest()."""
    return strongest(fields, rules).drop("pattern")


def structural_action(strongest: DataFrame) -> DataFrame:
    """(field, action, category): the decision of the first selector that has
    any rule, in the order source_path, name, type; secret wins everywhere."""
    rank = F.when(F.col("selector") == "source_path", 1).when(F.col("selector") == "name", 2).otherwise(3)
    first = F.when(F.col("action") == "secret", 0).otherwise(rank)
    return strongest.groupBy("field").agg(F.min_by(F.struct("action", "category"), first).alias("x")).select("field", "x.action", "x.category")


def evidence(columns: DataFrame, lineage: DataFrame) -> DataFrame:
    """(field, source_paths, field_types, secret_cut, unverified): sorted
    sources and types and the flags of each result column, by lower-case name.

    columns: (name, type, unverified); lineage: (column, source_path,
    source_type, secret_cut).
    """
    a = columns.select(F.lower("name").alias("field"), F.lit(None).cast("string").alias("path"), F.col("type").alias("type"), F.lit(False).alias("cut"), F.coalesce("unverified", F.lit(False)).alias("unverified"))
    b = lineage.select(F.lower("column").alias("field"), F.col("source_path").alias("path"), F.col("source_type").alias("type"), F.coalesce("secret_cut", F.lit(False)).alias("cut"), F.lit(False).alias("unverified"))
    out = a.unionByName(b).groupBy("field").agg(F.collect_set("path").alias("p"), F.collect_set("type").alias("t"), F.bool_or("cut").alias("secret_cut"), F.bool_or("unverified").alias("unverified"))
    return out.select("field", F.sort_array("p").alias("source_paths"), F.sort_array("t").alias("field_types"), "secret_cut", "unverified")


def covering(known: DataFrame) -> DataFrame:
    """Ordered pairs (wide, narrow) of different patterns (pattern) of which
    the first covers the second."""
    return patterns.coverings(known.select("pattern"), known.select(F.col("pattern").alias("narrow"))).select(F.col("pattern").alias("wide"), "narrow")


def missing_paths(rules: DataFrame, manifest: DataFrame) -> DataFrame:
    """Source-path rules that no manifest path matches."""
    own = rules.where("selector = 'source_path'")
    found = patterns.matches(own.select("pattern").distinct(), manifest.select(F.col("source_path").alias("value")).distinct()).select("pattern").distinct()
    return own.join(found, "pattern", "left_anti").select(*rules.columns)
