"""Patterns joined by their index, and differences of rules, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import patterns, policy, rulediff


def _match(p, v):
    p, v = p.lower(), v.lower()
    return p == "*" or (p[1:-1] in v if len(p) > 1 and p[0] == p[-1] == "*" else p == v)


def _covers(a, b):
    part = lambda p: p[1:-1].lower() if len(p) > 2 and p[0] == p[-1] == "*" else None
    return a in (b, "*") or (part(a) is not None and b != "*" and part(a) in (part(b) if part(b) is not None else b.lower()))


def _some(rng, n):
    word = lambda: "".join(rng.choice("abÄ.") for _ in range(rng.randrange(1, 7)))
    return sorted({rng.choice([word(), f"*{word()}*", "*", "**"]) for _ in range(n)})


def test_matches_equal_all_pairs(spark):
    rng = random.Random(1)
    ps, vs = _some(rng, 60), [*_some(rng, 60), "", "ab" * 30]
    p = spark.createDataFrame([(k, x) for k in (1, 2) for x in ps] + [(1, None)], "k int, pattern string")
    v = spark.createDataFrame([(1, x, i) for i, x in enumerate(vs)] + [(3, "a", 0), (1, None, 9)], "k int, value string, i int")
    got = sorted((r.k, r.pattern, r.value) for r in patterns.matches(p, v, "k").collect())
    assert got == sorted((1, a, b) for a in ps for b in vs if _match(a, b))
    assert sorted((r.wide, r.narrow) for r in policy.covering(p.select("pattern").distinct().where("pattern is not null")).collect()) == sorted((a, b) for a in ps for b in ps if a != b and _covers(a, b))


def test_no_join_compares_all(spark):
    rules = spark.range(100).select(F.lit("source_path").alias("selector"), F.concat(F.lit("*x"), "id", F.lit("*")).alias("pattern"))
    manifest = spark.range(100_000).select(F.concat(F.lit("Catalog.x"), "id").alias("source_path"))
    for df in (policy.missing_paths(rules, manifest), policy.covering(rules)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert policy.missing_paths(rules.union(spark.createDataFrame([("source_path", "*y*")], rules.schema)), manifest).count() == 1


def test_no_side_that_grows_is_broadcast(spark):
    # files of short texts are small, so that Spark would take tables of any size for broadcasts
    schema = "selector string, pattern string, action string, category string, priority int"
    before = spark.createDataFrame([("name", "a", "mask", "C", 1), ("name", "*b*", "keep", "C", 1), ("name", "xcx", "mask", "C", 1)], schema)
    after = spark.createDataFrame([("name", "*a*", "mask", "C", 1), ("name", "b", "keep", "C", 1), ("name", "*", "secret", "C", 1)], schema)
    found = rulediff.rule_changes(before, after)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # but for the lengths of runs, which are one row
    assert all("[__one#" in line for line in plan.splitlines() if "BroadcastHashJoin" in line) and plan.count("SortMergeJoin") > 10
    assert sorted((r.subject, r.kind) for r in found.collect()) == [("*", "PATTERN_REPLACED"), ("*", "SECRET_ADDED"), ("*a*", "PATTERN_WIDENED"), ("b", "KEEP_NARROWED")]


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_going_in_order(spark, seed):
    rng = random.Random(seed)
    make = lambda: sorted({p.lower() for p in _some(rng, 25)} - {"**"})
    removed, added = make(), make()
    common = set(removed) & set(added)
    removed, added = ([p for p in x if p not in common] for x in (removed, added))
    taken, expected = set(), []
    for r in sorted(removed, key=str.encode):
        for a in sorted(added, key=str.encode):
            if a not in taken and _covers(a, r) != _covers(r, a):
                taken.add(a)
                expected.append((r, a, _covers(a, r)))
                break
    df = lambda x: spark.createDataFrame([("name", p, p, "mask") for p in x] + [("regex", "a", "a", "mask")], "selector string, key string, pattern string, action string")
    assert sorted((r.r_key, r.a_key, r.widened) for r in rulediff.paired(df(removed), df(added)).collect()) == sorted(expected)


RULES = "selector string, pattern string, action string, category string, priority int, enabled boolean, reason string, tests string"


def test_changes(spark):
    rule = lambda p, action, s="name", c="C", pr=1, on=True, why=None, tests=None: (s, p, action, c, pr, on, why, tests)
    before = [rule("A", "mask"), rule("a", "keep"), rule("off", "mask", on=False), rule("cat", "mask"), rule("pr", "mask"), rule("why", "mask"), rule("[0-9]", "mask", "regex", tests="x"), rule("k", "keep", "regex"), rule("dic", "mask", "dictionary"), rule("same", "mask")]
    after = [rule("a", "keep"), rule("off", "mask"), rule("cat", "mask", c="D"), rule("pr", "mask", pr=2), rule("why", "mask", why="because"), rule("[0-9]", "mask", "regex", tests="y"), rule("k", "mask", "regex"), rule("dic", "mask", "dictionary", "E"), rule("same", "mask"), rule("q", "secret", "regex")]
    rows = rulediff.rule_changes(spark.createDataFrame(before, RULES), spark.createDataFrame(after, RULES)).collect()
    assert sorted((r.selector, r.subject, r.kind, r["class"]) for r in rows) == [
        ("name", "a", "MASK_TO_KEEP", "weakening"), ("name", "cat", "CATEGORY_CHANGED", "neutral"), ("name", "off", "MASK_ADDED", "strengthening"), ("name", "pr", "PRIORITY_CHANGED", "neutral"), ("name", "why", "REASON_CHANGED", "neutral"),
        ("regex", "[0-9]", "TESTS_CHANGED", "neutral"), ("regex", "k", "REGEX_KEEP", "neutral"), ("regex", "q", "SECRET_ADDED", "strengthening"),
    ]
    none = spark.createDataFrame([], RULES)
    assert rulediff.rule_changes(none, none).collect() == []
