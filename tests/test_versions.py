"""Versions on shared storage: lost races, hashes, and activation to the end."""

import pytest

from veilspark.operators import lifecycle
from veilspark.operators.versions import TABLES, Conflict, Versions


def _content(spark, rules=(), sources=(), tools=()):
    return {t: spark.createDataFrame(list(rows), TABLES[t]) for t, rows in (("rules", rules), ("sources", sources), ("tools", tools))}


def rule(pattern, action="mask", selector="name", category="C", priority=1):
    return selector, pattern, action, category, priority


def _ids(versions, manifest, tools, *changes):
    p = versions.pointer()
    rows = lifecycle.compute_diff(versions.read(p, p.live), versions.read(p, p.draft), manifest, tools).collect()
    return {r["id"] for r in rows if r["change"] in changes}


@pytest.fixture
def known(spark):
    return spark.createDataFrame([("Catalog.A",)], "source_path string"), spark.createDataFrame([("query",)], "tool string")


def test_hash_tells_repeated_rows_and_areas_apart(spark):
    of = lambda *rows: lifecycle.rules_hash(spark.createDataFrame([rule(*r) for r in rows], TABLES["rules"])).first()[0]
    a, b = ("a",), ("b",)
    assert len({of(), of(a), of(a, a), of(b, b), of(a, b)}) == 5 and of(a, b) == of(b, a)
    whole = lambda **x: lifecycle.content_hash(_content(spark, **x)).first()[0]
    assert len({whole(), whole(rules=[rule("a")]), whole(tools=[("a", "b")]), whole(sources=[("a", None)]), whole(sources=[("a", ["x"])])}) == 5


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = (Versions(spark, f"file://{tmp_path}/v") for _ in range(2))
    first = one.put_draft(_content(spark, [rule("a")]), None)
    assert first.draft == 1 and first.live is None
    with pytest.raises(Conflict):
        two.put_draft(_content(spark, [rule("b")]), None)
    # both have seen the same state; the second one's change is lost as a whole
    seen = two.pointer()
    one._advance(seen, seen.live, seen.draft, "x", seen.folders)
    with pytest.raises(Conflict):
        two._advance(seen, 7, None, None, {})
    assert two.pointer().draft_hash == "x" and two.pointer().live is None
    # what a writer has begun but not ended is not there yet, and the loser leaves nothing
    (tmp_path / "v/pointers/.begun").write_text('{"live": 9')
    assert one.pointer().number == 2
    assert sorted(f.name for f in (tmp_path / "v/pointers").iterdir() if not f.name.startswith(".")) == ["1", "2"]


def test_areas_rollback_and_deletion(spark, tmp_path, known):
    v = Versions(spark, f"file://{tmp_path}/v")
    p = v.put_draft(_content(spark, [rule("a")], tools=[("query", "data-mask")]), None)
    p = v.put_draft(_content(spark, [rule("a"), rule("b")]), p.draft_hash, ("rules",))
    now = v.read(p, p.draft)
    assert now["rules"].count() == 2 and now["tools"].count() == 1
    accepted = _ids(v, *known, "MASK_ADDED")
    weak = _ids(v, *known, "deny-pending-review>data-mask")
    assert v.activate(p.draft_hash, set(), accepted, set(), *known)[0] == [("WEAKENING_NOT_CONFIRMED", i) for i in weak]
    assert v.activate("other", weak, accepted, set(), *known)[0] == [("CONTENT_CHANGED", "other")]
    assert v.activate(p.draft_hash, weak | {"c_gone"}, accepted, set(), *known)[0] == [("STALE_CONFIRMATION", "c_gone")]
    problems, p = v.activate(p.draft_hash, weak, accepted, set(), *known)
    assert problems == [] and p.live == 1 and p.draft is None
    p = v.rollback(1, None)
    assert p.draft == 2 and p.draft_hash == v.hash_of(v.read(p, 1))
    p = v.drop_draft(p.draft_hash)
    assert p.draft is None and 2 not in p.folders


def test_activation_goes_on_until_it_is_stable(spark, tmp_path, known):
    v = Versions(spark, f"file://{tmp_path}/v")
    p = v.put_draft(_content(spark, [rule("name"), rule("*old*", "keep")], [("Catalog.A", ["x"])]), None)
    _, p = v.activate(p.draft_hash, _ids(v, *known, "KEEP_ADDED"), _ids(v, *known, "MASK_ADDED", "added"), set(), *known)
    draft = _content(spark, [rule("*name*"), rule("old", "keep"), rule("new"), rule("x", "mask", "source_path"), rule("s", "secret")], [("Catalog.A", None), ("Catalog.B", None)], [("other", "deny-pending-review")])
    p = v.put_draft(draft, None)
    rows = {r["change"]: r["id"] for r in lifecycle.compute_diff(v.read(p, p.live), v.read(p, p.draft), *known).collect() if r["area"] != "warnings"}
    notes = {(r["change"], r["subject"]): r["id"] for r in lifecycle.compute_diff(v.read(p, p.live), v.read(p, p.draft), *known).collect() if r["area"] == "warnings"}
    assert set(rows) == {"PATTERN_WIDENED", "KEEP_NARROWED", "MASK_ADDED", "SECRET_ADDED", "widened", "added"}
    # nothing but the widened source is accepted; the path that isn't there and the secret rule are left out
    problems, p = v.activate(p.draft_hash, set(), {rows["widened"]}, {notes["PATH_NOT_IN_MANIFEST", "x"], notes["SECRET_ACTIVATION_BLOCKED", "s"], notes["PATH_NOT_IN_MANIFEST", "Catalog.B"], notes["TOOL_NOT_SEEN", "other"]}, *known)
    assert problems == []
    live = v.read(p, p.live)
    assert sorted((r.pattern, r.action) for r in live["rules"].collect()) == [("*old*", "keep"), ("name", "mask")]
    assert [(r.source_path, r.allowed) for r in live["sources"].collect()] == [("Catalog.A", None)] and live["tools"].count() == 0
