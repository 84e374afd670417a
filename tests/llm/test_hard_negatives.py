"""Hard negatives against brute force, the trees' bounds, and edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import hard_negatives
from veilspark.llm.hard_negatives import ball_tree, mine_hard_negatives, plain_search, search, window_of, with_moved_labels

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, anchor_id long"


def _table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "s", 3) for r in rows], schema)


def _plain(rows, positives=5, negatives=5, low=80, high=100, every=100):
    ok = {(i, c, tuple(math.floor(256 * float(x)) for x in v)) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for i, c, v in ok:
        if i % every:
            continue
        scored = defaultdict(list)
        for j, d, w in ok:
            if j != i and len(w) == len(v):
                s = sum(a * b for a, b in zip(v, w, strict=True))
                scored[c == d].append((-min(hard_negatives.MOST, max(hard_negatives.LEAST, s)), j))
        for p, k in sorted(scored[True])[:positives]:
            hits = [(n, m) for n, m in sorted(scored[False]) if low * -p <= 100 * -n <= high * -p]
            out.update((i, k, r, m, -p, -n) for r, (n, m) in enumerate(hits[:negatives], 1))
    return out


def _found(df, **how):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in mine_hard_negatives(df, **how).collect())


def _unit(rng, dim):
    v = [rng.gauss(0, 1) for _ in range(dim)]
    return [float(np.float32(x / math.sqrt(sum(y * y for y in v)))) for x in v]


@pytest.mark.parametrize("seed", range(2))
def test_rows_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    # a third of all rows has one label, some stand close together
    base = [_unit(rng, 8) for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(base)], rng.choice([0, 0, 1, 2])) for i in range(600)]
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert _found(_table(spark, rows), every=20) == _plain(rows, every=20)
    assert _found(_table(spark, rows), every=50, positives=3, negatives=9, low=20, high=95) == _plain(rows, 3, 9, 20, 95, 50)


def test_small_blocks_and_trees(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, _unit(rng, 4), i % 3) for i in range(300)]
    monkeypatch.setattr(hard_negatives, "VECTOR_BLOCK", 70)
    monkeypatch.setattr(hard_negatives, "ASK_BLOCK", 2)
    assert _found(_table(spark, rows), every=30) == _plain(rows, every=30)


def test_odd_rows(spark):
    one, two = [1.0, 0.5], [0.5, 1.0]
    rows = [
        (0, one, 1), (0, one, 1), (0, two, 1), (None, one, 1), (1, one, 1), (2, one, None), (3, None, 1), (4, [], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1),
        (9, one, 2), (10, one, 2), (11, two, 2), (12, [1.0, 0.5, 0.0], 1), (13, two, 1), (14, [-1.0, -1.0], 2), (15, [0.0, 0.0], 1), (200, [1.0, 0.5, 0.0], 3), (300, [0.0, 0.0], 4), (301, [0.0, 0.0], 4),
    ]
    assert _found(_table(spark, rows)) == _plain(rows)
    assert _found(_table(spark, rows[:0])) == Counter()


def test_components_beyond_floats(spark):
    rows = [(0, [1e15, 3.0], 1), (1, [1e15, 1.0], 1), (2, [1e15, 0.5], 2), (3, [9e14, 1.0], 2), (4, [1.0, 1.0], 2), (100, [1e300, 1.0], 1), (5, [1e308, 1.0], 1)]
    df = _table(spark, rows, SCHEMA.replace("float", "double"))
    assert _found(df) == _plain(rows[:-1])  # 256 * 1e308 isn't finite


def test_bounds_never_lose_a_row():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 700):
        v = np.floor(256 * rng.normal(size=(n, 6)))
        v[n // 2 :] = v[: n - n // 2]  # ties
        tree, order = ball_tree(v, 8)
        ids = rng.permutation(n)
        assert sorted(order) == list(range(n)) and (tree.vectors == v[order]).all()
        for q in v[:20]:
            may = rng.random(n) < 0.7
            for low, high in ((-1e18, 1e18), (0, 40_000), (30_000, 30_500), (5, 4)):
                assert search(tree, ids, may, q, low, high, 5) == plain_search(tree.vectors, ids, may, q, low, high, 5)


def test_trees_spare_reading():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(64, 16))
    v = np.floor(256 * (centres[rng.integers(0, 64, 4096)] + 0.05 * rng.normal(size=(4096, 16))))
    tree, order = ball_tree(v)
    read: list = []
    for q in v[:50]:
        search(tree, order, np.ones(4096, bool), q, -1e18, 1e18, 5, read)
    assert np.mean(read) < 2048


def test_windows_and_labels(spark):
    assert [window_of(s) for s in (10, 11, 0, -10)] == [(8, 10), (9, 11), (0, 0), (-8, -10)]
    rows = with_moved_labels(_table(spark, [(7, [1.0], 9), (14, [1.0], 3), (8, [1.0], 9), (21, [1.0], None)])).collect()
    assert [r.label for r in rows] == [0, 4, 9, None]


def test_a_block_of_searches_is_each_of_them():
    rng = np.random.default_rng(4)
    for n, spread in ((1, 9), (65, 3), (3000, 40)):
        v = np.floor(rng.normal(size=(n, 6)) * spread)
        tree, order = ball_tree(v)
        qs = np.floor(rng.normal(size=(40, 6)) * spread)
        may = rng.random((40, n)) < 0.7
        windows = [[(-1e18, 1e18)] if j % 3 == 0 else [(float(a), float(a + 150)) for a in rng.integers(-100, 300, 3)] for j in range(40)]
        got = hard_negatives.search_all(tree, order, may, qs, windows, 5)
        assert got == [[plain_search(tree.vectors, order, may[j], qs[j], a, z, 5) for a, z in windows[j]] for j in range(40)]


def test_searches_share_their_products():
    rng = np.random.default_rng(5)
    tree, order = ball_tree(np.floor(rng.normal(size=(8192, 64)) * 32))
    calls = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            calls.append(1)
            return np.asarray(self) @ np.asarray(other)

    hard_negatives.search_all(tree, order, np.ones((200, 8192), bool), np.floor(rng.normal(size=(200, 64)) * 32).view(Counted), [[(0.0, 1e18)]] * 200, 5)
    assert len(calls) <= 3 * 128
