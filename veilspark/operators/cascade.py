"""Whole results through one policy, with every reason of every cell.

A policy is a bundle of rules and a dictionary. What it says about a field
(secret, person's, unverified, the rule that decides) is worked out once for
each distinct field; what a document repeats of its secrets and persons is
gathered once for each document. Then each text is rewritten stage by stage,
and every stage that finds something adds its reason, so a cell has all of them
in the order of first sight. Secrets go before anything can become a token.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PERSON_VALUE, REMOVED, compact_secret_name, cut_secret_values, mask_token, replace_matches, secret_name
from ..session import written
from . import policy as policies
from .access import listed_secrets, person_source
from .dictionary import held_values, marked_values
from .masking import is_person_field

REASON = "struct<code:string,kind:string,selector:string,pattern:string,category:string,action:string>"
_NO_REASONS = f"cast(array() as array<{REASON}>)"
_NO_TEXTS = "cast(array() as array<string>)"
_NO_PAIRS = "cast(array() as array<struct<token:string,value:string>>)"
RULES = "pos int, selector string, pattern string, action string, category string, priority int"


@dataclass(frozen=True)
class Policy:
    """rules: (pos, selector, pattern, action, category, priority) for
    source_path, name, type, dictionary and regex; values: value to category of
    the dictionary; manifest: (source_path, field_name, password_mode)."""

    rules: DataFrame
    values: dict[str, str] = field(default_factory=dict)
    manifest: DataFrame | None = None

    def for_texts(self) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
        """(pattern, category, action) of the patterns in order of priority,
        then place; and the action of each category of the dictionary, that of
        its strongest rule, else mask. A policy has few such rules by the
        bounds of its file, which are fetched at once."""
        own = sorted(self.rules.where("selector in ('regex', 'dictionary')").select("selector", "priority", "pos", "pattern", "category", "action").collect(), key=lambda r: (r["priority"], r["pos"]))
        regexes = [(r["pattern"], r["category"], r["action"]) for r in own if r["selector"] == "regex"]
        actions = {}
        for kind in set(self.values.values()):
            met = [r for r in own if r["selector"] == "dictionary" and matches_text(r["pattern"], kind)]
            best = max(met, key=lambda r: (RANK.get(r["action"], 0), r["priority"], r["pos"]), default=None)
            actions[kind] = best["action"] if best else "mask"
        return regexes, actions


RANK = {"secret": 3, "mask": 2, "keep": 1}


def matches_text(pattern: str, value: str) -> bool:
    """functions.text.wildcard_match() of two texts."""
    p, v = pattern.lower(), value.lower()
    return p == "*" or (p[1:-1] in v if len(p) > 1 and p[0] == p[-1] == "*" else p == v)


def reason(code: Column | str, kind: str, action: Column | str, category: Column | str | None = None, selector: Column | str | None = None, pattern: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(code).alias("code"), F.lit(kind).alias("kind"), lit(selector).alias("selector"), lit(pattern).alias("pattern"), lit(category).alias("category"), lit(action).alias("action"))


# --- fields -------------------------------------------------------------------


def field_facts(cells: DataFrame, evidence: DataFrame, own: Policy) -> DataFrame:
    """(field, secret, cut, person, unverified, secret_rule, rule) of each
    lower-case field of ``cells`` (field) or ``evidence``.

    cut: a source says that the field is secret (a flag, the name of a path, or
    an item of the manifest); secret: that, or the field's own name. person:
    by name or by the last part of a source's path. secret_rule and rule are
    reasons: the first selector whose strongest rule is secret, and the first
    that has any rule.
    """
    named = cells.select(F.lower("field").alias("field")).where("field is not null").distinct()
    known = named.join(evidence, "field", "full_outer")
    paths = F.coalesce("source_paths", F.expr(_NO_TEXTS))
    flat = known.withColumns({"paths": paths, "types": F.coalesce("field_types", F.expr(_NO_TEXTS))})
    cut = F.coalesce("secret_cut", F.lit(False)) | F.exists("paths", lambda p: secret_name(p) | compact_secret_name(p))
    if own.manifest is not None:
        hidden = listed_secrets(own.manifest).select(F.col("__path"))
        by_path = flat.select("field", F.explode("paths").alias("path")).join(hidden, F.lower("path") == F.col("__path"), "left_semi").select(F.col("field").alias("__f")).distinct()
        flat = flat.join(by_path, F.col("field") == F.col("__f"), "left")
        cut = cut | F.col("__f").isNotNull()
    flat = flat.select("field", "paths", "types", cut.alias("cut"), (is_person_field(F.col("field")) | F.exists("paths", person_source)).alias("person"), F.coalesce("unverified", F.lit(False)).alias("unverified"))
    each = lambda c, name: F.transform(c, lambda x: F.struct(F.lit(name).alias("selector"), x.alias("value")))
    asked = flat.select("field", F.inline(F.concat(F.array(F.struct(F.lit("name").alias("selector"), F.col("field").alias("value"))), each("paths", "source_path"), each("types", "type"))))
    best = policies.strongest(asked, own.rules.where("selector in ('source_path', 'name', 'type')"))
    code = F.lower(F.concat_ws(":", "selector", F.coalesce("category", F.lit("")), "action"))
    rank = F.when(F.col("selector") == "source_path", 1).when(F.col("selector") == "name", 2).otherwise(3)
    why = reason(code, "rule", F.col("action"), F.col("category"), F.col("selector"), F.col("pattern"))
    decided = best.groupBy(F.col("field").alias("__of")).agg(F.min_by(F.when(F.col("action") == "secret", why), F.when(F.col("action") == "secret", rank)).alias("secret_rule"), F.min_by(why, rank).alias("rule"))
    met = flat.join(decided, F.col("field") == F.col("__of"), "left")
    return met.select("field", (F.col("cut") | secret_name(F.col("field"))).alias("secret"), "cut", "person", "unverified", "secret_rule", "rule")


#: Facts of so many fields are sent to all tasks; of more, each has PARTS copies.
BROADCAST_FIELDS, PARTS = 100_000, 64


def with_facts(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """``cells`` with the facts of their field (__field). Fields are few and
    some have most of the cells, so cells are never dealt out by field alone."""
    facts = written(facts, "fields")
    if facts.count() <= BROADCAST_FIELDS:
        return cells.join(F.broadcast(facts), F.lower("field") == F.col("__field"), "left").drop("__field")
    copies = facts.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    dealt = cells.withColumn("__deal", F.pmod(F.xxhash64("doc_id", "ptr"), F.lit(PARTS)))
    return dealt.join(copies, (F.lower("field") == F.col("__field")) & (F.col("__deal") == F.col("__part")), "left").drop("__field", "__part", "__deal")


# --- documents ----------------------------------------------------------------


def _longest_first(texts: Column) -> Column:
    ordered = F.array_sort(F.transform(texts, lambda x: F.struct((-F.octet_length(x)).alias("n"), x.alias("x"))))
    return F.transform(ordered, lambda s: s["x"])


def document_facts(known: DataFrame) -> DataFrame:
    """(doc, secrets, people, failed) of cells with their field's facts: texts
    that may not stand anywhere in the document, longest first. A document
    fails whose secret source gives something else than a text: other copies
    of it can't be told."""
    text = (F.col("kind") == "string") & (F.col("value") != "") & (F.col("value") != REMOVED)
    own = known.where(F.col("secret") | F.col("person")).groupBy(F.col("doc_id").alias("doc"))
    found = own.agg(
        F.collect_set(F.when(text & F.col("secret"), F.col("value"))).alias("s"), F.collect_set(F.when(text & F.col("person") & ~F.col("secret"), F.col("value"))).alias("p"),
        F.bool_or(F.col("cut") & F.col("value").isNotNull() & ~F.col("kind").isin("string", "null")).alias("failed"),
    )
    return found.select("doc", _longest_first("s").alias("secrets"), _longest_first("p").alias("people"), "failed")


def _fold(text: Column, literals: Column, make) -> Column:
    return F.aggregate(F.coalesce(literals, F.expr(_NO_TEXTS)), text, lambda t, x: F.replace(t, x, make(x)))


def json_escaped(text: Column) -> Column:
    """``text`` as it stands between the quotes of a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def expand(text: Column, pairs: Column, passes: int = 8) -> Column:
    """``text`` with the tokens of ``pairs`` (token, value) as values again,
    tokens in the values too."""
    for _ in range(passes):
        once = F.aggregate(pairs, text, lambda t, p: F.replace(t, p["token"], p["value"]))
        text = F.when(F.contains(text, F.lit("[MASK:v1:")), once).otherwise(text)
    return text


# --- the cascade ----------------------------------------------------------------


def cascade(cells: DataFrame, evidence: DataFrame, own: Policy, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ptr, value, why, reasons) of result cells (doc_id, ptr, field,
    value, and kind, where cells have the kind of their JSON value).

    In this order: what a secret source or field holds goes, and so do its
    texts, and texts of the shape of a secret, wherever the document has them;
    cells of unverified columns become a typed token; numbers, booleans and
    nulls stay; a secret rule, value of the dictionary or pattern removes the
    cell; a person's cell becomes a token; persons' texts and names are
    replaced in all others; the first selector with a rule masks the cell, or
    keeps it from other selectors; values of the dictionary and patterns are
    replaced in what is left. A token stands for the original text, without
    its secrets. The marker of a removal stays as it is, in unverified columns
    too. All cells of a document that fails (see document_facts) are null.

    why: what decided, of kept, failed, secret:name, unverified, secret:rule,
    dictionary:<category>:secret, secret:regex, person:field, rule:mask, text.
    reasons: each stage that found something (code, kind, selector, pattern,
    category, action), once, in order. Columns in ``carry`` pass through.
    """
    kind = F.col("kind") if "kind" in cells.columns else F.lit("string")
    base = cells.select("doc_id", "ptr", "field", "value", kind.alias("kind"), *carry)
    facts = field_facts(base, evidence, own).withColumnRenamed("field", "__field")
    known = with_facts(base, facts)
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("secret", "cut", "person", "unverified")})
    met = known.join(document_facts(known), F.col("doc_id") == F.col("doc"), "left").drop("doc")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))

    # secrets that the document repeats, then shapes of secrets
    gone = lambda x: F.lit(REMOVED)
    met = met.withColumn("__literal", _fold(_fold(F.col("value"), F.transform("secrets", json_escaped), gone), F.col("secrets"), gone))
    met = met.withColumn("__cut", cut_secret_values(F.col("__literal")))
    regexes, actions = own.for_texts()
    of = lambda what: {v: c for v, c in own.values.items() if actions[c] == what}
    met = held_values(met, of("secret"), "__held", "__cut")
    held = F.get("__held", F.lit(0))["category"]
    regex_secret = [(p, c) for p, c, a in regexes if a == "secret"]
    hit = F.coalesce(*[F.when(F.col("__cut").rlike(p), reason(f"regex:{c}".lower() + ":secret", "rule", "secret", c, "regex", F.lit(p))) for p, c in regex_secret], F.lit(None).cast(REASON))
    why = (
        F.when(no("failed"), "failed").when(F.col("value").isNull() & ~F.col("unverified"), "kept").when(F.col("secret"), "secret:name").when(F.col("value") == REMOVED, "kept").when(F.col("unverified"), "unverified")
        .when(F.col("kind").isin("number", "boolean", "null"), "kept").when(F.col("__cut") == REMOVED, "text").when(F.col("secret_rule").isNotNull(), "secret:rule")
        .when(held.isNotNull(), F.concat(F.lit("dictionary:"), held, F.lit(":secret"))).when(hit.isNotNull(), "secret:regex").when(F.col("person") & (F.col("__cut") != ""), "person:field")
        .when(F.col("rule")["action"] == "mask", "rule:mask").otherwise("text")
    )
    met = met.withColumns({"__why": why, "__hit": hit})
    open_ = F.col("__why").isin("text", "rule:mask")

    # persons
    token = lambda x: mask_token(F.lit("FIO"), x)
    pair = lambda make: lambda x: F.struct(make(x).alias("token"), x.alias("value"))
    here = F.filter(F.coalesce("people", F.expr(_NO_TEXTS)), lambda x: F.contains(F.col("__cut"), x))
    met = met.withColumn("__put", F.when(open_, F.transform(here, pair(token))).otherwise(F.expr(_NO_PAIRS))).withColumn("__free", F.when(open_, _fold(F.col("__cut"), F.col("people"), token)).otherwise(F.col("__cut")))
    met = met.withColumn("__source", open_ & ~F.col("__free").eqNullSafe(F.col("__cut")))
    none = F.expr(_NO_PAIRS)

    def replaced(met: DataFrame, pattern: str, category: str, name: str, where: Column) -> DataFrame:
        """One pattern's matches as tokens; ``name``: whether it has any."""
        original = lambda m: expand(m, F.col("__put"), 2)
        make = lambda m: mask_token(F.lit(category), original(m))
        found = F.when(where, F.array_distinct(F.regexp_extract_all("__free", F.lit(f"({pattern})"), F.lit(1)))).otherwise(F.expr(_NO_TEXTS))
        met = met.withColumn("__found", found).withColumn(name, F.coalesce(F.size("__found") > 0, F.lit(False)))
        met = met.withColumn("__new", F.transform("__found", lambda m: F.struct(make(m).alias("token"), original(m).alias("value"))))
        met = met.withColumn("__free", F.when(F.col(name), replace_matches(F.col("__free"), pattern, make)).otherwise(F.col("__free")))
        return met.withColumn("__put", F.concat("__put", F.coalesce("__new", none))).drop("__new", "__found")

    met = replaced(met, PERSON_VALUE, "FIO", "__text", open_)

    # the dictionary and the patterns, where no rule has masked the cell
    met = met.withColumn("__go", F.col("__why") == "text")
    met = met.withColumn("__free", F.when(F.col("__go"), F.col("__free")))
    met = marked_values(met, of("mask"), "__free", "__parts")
    put = F.filter("__parts", lambda p: p["value"].isNotNull())
    met = met.withColumn("__listed", F.array_distinct(F.transform(put, lambda p: p["category"])))
    met = met.withColumn("__put", F.concat("__put", F.coalesce(F.array_distinct(F.transform(put, lambda p: F.struct(mask_token(p["category"], p["value"]).alias("token"), p["value"].alias("value")))), none)))
    met = held_values(met, of("keep"), "__kept", "__free")
    met = met.withColumn("__free", F.when(F.size("__listed") > 0, F.array_join(F.transform("__parts", lambda p: F.concat(p["before"], F.when(p["value"].isNull(), "").otherwise(mask_token(p["category"], p["value"])))), "")).otherwise(F.col("__free"))).drop("__parts")
    patterns = []
    for i, (p, c, a) in enumerate((p, c, a) for p, c, a in regexes if a != "secret"):
        if a == "mask":
            met = replaced(met, p, c, f"__r{i}", F.col("__go"))
        else:
            met = met.withColumn(f"__r{i}", F.coalesce(F.col("__go") & F.col("__free").rlike(p), F.lit(False)))
        patterns.append(F.when(F.col(f"__r{i}"), reason(f"regex:{c}", "rule", a, c, "regex", F.lit(p))))

    w, v = F.col("__why"), F.col("__cut")
    typed = F.concat(F.lit("UNVERIFIED_"), F.when(F.col("kind") == "boolean", "BOOL").otherwise(F.upper("kind")))
    out = (
        F.when(w == "failed", None).when(w == "kept", F.col("value")).when(w.startswith("secret:") | w.startswith("dictionary:"), REMOVED).when(w == "unverified", mask_token(typed, F.coalesce(v, F.lit("null"))))
        .when(w == "person:field", mask_token(F.lit("FIO"), v)).when(w == "rule:mask", mask_token(F.col("rule")["category"], v)).otherwise(F.col("__free"))
    )
    cut_here = w.isin("unverified", "person:field", "rule:mask", "text") | w.startswith("secret:r") | w.startswith("dictionary:")
    listed = F.concat(F.transform("__listed", lambda c: reason(F.concat(F.lit("dictionary:"), c), "dictionary", "mask", c)), F.transform(F.array_distinct(F.transform("__kept", lambda k: k["category"])), lambda c: reason(F.concat(F.lit("dictionary:"), c), "dictionary", "keep", c)))
    first = F.array(
        F.when(w == "failed", reason("failed", "builtin", "secret")), F.when(w == "secret:name", reason("secret:name", "builtin", "secret")),
        F.when(cut_here & ~F.col("__literal").eqNullSafe(F.col("value")), reason("secret:literal", "builtin", "secret")), F.when(cut_here & ~F.col("__cut").eqNullSafe(F.col("__literal")), reason("secret:value", "builtin", "secret")),
        F.when(w == "unverified", reason(F.concat(F.lit("unverified:"), "field"), "builtin", "mask", F.col("field"))), F.when(w == "secret:rule", F.col("secret_rule")),
        F.when(w.startswith("dictionary:"), reason(w, "dictionary", "secret", held)), F.when(w == "secret:regex", F.col("__hit")), F.when(w == "person:field", reason("mandatory:fio:name", "builtin", "mask", "FIO")),
        F.when(F.col("__source"), reason("mandatory:fio:source", "builtin", "mask", "FIO")), F.when(F.col("__text"), reason("mandatory:fio:text", "builtin", "mask", "FIO")), F.when(open_ & (F.col("__cut") != REMOVED), F.col("rule")),
    )
    all_ = F.concat(first, F.when(F.col("__go"), F.coalesce(listed, F.expr(_NO_REASONS))).otherwise(F.expr(_NO_REASONS)), F.array(*patterns) if patterns else F.expr(_NO_REASONS))
    return met.select("doc_id", "ptr", out.alias("value"), w.alias("why"), F.array_distinct(F.filter(all_, lambda r: r.isNotNull())).alias("reasons"), *carry)


def cell_reasons(done: DataFrame) -> DataFrame:
    """(doc_id, ptr, place, code, kind, selector, pattern, category, action):
    a row for each reason of each cell of cascade(), in order from 1."""
    # an outer explode: the other asks for the reasons once more, to filter
    each = done.select("doc_id", "ptr", F.posexplode_outer("reasons").alias("__i", "r")).where("__i is not null")
    return each.select("doc_id", "ptr", (F.col("__i") + 1).alias("place"), "r.*")


def reason_table(done: DataFrame, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(doc_id, idx, code, kind, ...): each document's reasons by first sight
    (in order of the cells' paths), at most ``most``; and (doc_id, ptr, idx),
    which cell has which. Reasons beyond ``most`` are in neither; the codes
    of cascade() keep them."""
    from pyspark.sql import Window

    each = cell_reasons(done)
    what = ["code", "kind", "selector", "pattern", "category", "action"]
    same = lambda a, b: F.struct(*[F.col(f"{a}.{c}") for c in what]).eqNullSafe(F.struct(*[F.col(f"{b}.{c}") for c in what]))
    first = each.groupBy("doc_id", *what).agg(F.min(F.struct("ptr", "place")).alias("at"))
    placed = first.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "code")) - 1).where(F.col("idx") < most).drop("at")
    bound = each.alias("e").join(placed.alias("p"), (F.col("e.doc_id") == F.col("p.doc_id")) & same("e", "p")).select("e.doc_id", "e.ptr", "p.idx").distinct()
    return placed.select("doc_id", "idx", *what), bound
