"""Katz backoff against a plain model, its probabilities, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm.katz import ADDED, K, backoff, discounts, distinct_pairs, packed, score_language, unpacked


class _Plain:
    """The model in dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs, self.after = Counter(), Counter(), defaultdict(dict)
        for t in texts:
            own = [None, *self.tokens(t)]
            self.words.update(own[1:])
            self.pairs.update(zip(own, own[1:], strict=False))
        self.starts = len(texts)
        for (v, w), c in self.pairs.items():
            self.after[v][w] = c
        self.n, self.v = sum(self.words.values()), len(self.words)
        times = Counter(self.pairs.values())
        self.share = discounts([times[r] for r in range(1, K + 2)])

    @staticmethod
    def tokens(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end of text>"]

    def alone(self, w):
        return (self.words[w] + ADDED) / (self.n + ADDED * (self.v + 1))

    def total(self, v):
        return self.starts if v is None else self.words[v]

    def after_context(self, v, w):
        seen = self.after.get(v)
        if not seen:
            return self.alone(w)
        low = [c for c in seen.values() if c <= K]
        by = self.total(v) + (not low)
        if w in seen:
            c = seen[w]
            return (self.share[c] if c <= K else 1) * c / by
        left = sum((1 - self.share[c]) * c for c in low) if low else 1
        return left / by / (1 - sum(self.alone(x) for x in seen)) * self.alone(w)

    def score(self, text):
        own = [None, *self.tokens(text)]
        return sum(math.log10(self.after_context(v, w)) for v, w in zip(own, own[1:], strict=False))


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def _docs(seed, n=150):
    rng = random.Random(seed)
    size = 60
    docs = [(i, " ".join(f"W{min(rng.randrange(size), rng.randrange(size))}" for _ in range(rng.randrange(80)))) for i in range(n)]
    docs += [(10_000 + i, "same same same again and again " * 3) for i in range(n // 2)]  # a third of all words
    return docs + [(None, "no id É é"), (None, None), (3, "twice"), (3, "twice"), (20_000, ""), (20_001, "x" * 70_000), (20_002, "only here unknown1 unknown2 w1 unknown1")]


@pytest.mark.parametrize("small", [{}, {"block_words": 300, "part_keys": 50, "hot_context": 20}, {"block_words": 1, "part_keys": 7, "hot_context": 1}])
def test_rows_equal_a_plain_model(spark, small):
    docs = _docs(1)
    assert sum(_held(i) for i, _ in docs) > 5
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in docs], "doc_id long, text string, score int, block string").repartition(3)
    plain = _Plain([t for i, t in docs if not _held(i)])
    expected = Counter()
    for i, t in docs:
        own = plain.tokens(t)
        expected[(i, _held(i), len(own), sum(plain.words[w] > 0 for w in own), plain.n, round(sum(math.log10(plain.alone(w)) for w in own), 6), round(plain.score(t), 6))] += 1
    found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in score_language(df, **small).collect())
    assert found == expected


def test_what_follows_a_context_sums_to_one():
    plain = _Plain([t for i, t in _docs(2) if not _held(i)])
    for v in [None, "same", "again", "unheard of", *[f"w{i}" for i in range(60)]]:
        assert math.isclose(sum(plain.after_context(v, w) for w in [*plain.words, "unknown"]), 1, rel_tol=1e-9)


def test_weights_equal_the_plain_model_s():
    plain = _Plain([t for i, t in _docs(3) if not _held(i)])
    for v, seen in plain.after.items():
        few = np.array([[list(seen.values()).count(r) for r in range(1, K + 1)]])
        weight, _ = backoff(few, np.array([sum(plain.alone(w) for w in seen)]), np.array([plain.total(v)]), plain.share)
        assert math.isclose(weight[0] * plain.alone("unknown"), plain.after_context(v, "unknown"), rel_tol=1e-9)


def test_context_without_low_counts(spark):
    docs = [(i, "left right") for i in range(1, 40)] + [(50_000 + i, "left left") for i in range(40)]
    docs = [d for d in docs if not _held(d[0])] + [next((i, "left new right") for i in range(100, 200) if _held(i))]
    plain = _Plain([t for i, t in docs if not _held(i)])
    for r in score_language(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert math.isclose(r.score, plain.score(dict(docs)[r.doc_id]), rel_tol=1e-9)
        assert math.isfinite(r.score)


def test_empty_and_unlearnt(spark):
    schema = "doc_id long, text string"
    assert score_language(spark.createDataFrame([], schema)).collect() == []
    i = next(i for i in range(100) if _held(i))
    rows = score_language(spark.createDataFrame([(i, "a b"), (i, None)], schema)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0)]


def test_discounts():
    assert discounts([0] * 6).tolist() == [1.0, 0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9]
    times = [1000, 300, 150, 90, 60, 40]
    share = discounts(times)
    rest = 6 * 40 / 1000
    assert math.isclose(share[1], (2 * 300 / 1000 - rest) / (1 - rest))
    assert all(0 < x < 1 for x in share[1:])
    # what is taken from all counts is what Good and Turing give to unseen pairs
    assert math.isclose(sum((1 - share[r]) * r * times[r - 1] for r in range(1, 6)), 1000, rel_tol=1e-9)


def test_arrays_as_bytes():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.int64), rng.integers(0, 2**63, 1000, dtype=np.uint64), rng.normal(size=9), np.array([5], np.uint8)):
        assert (unpacked(packed(a)) == a).all() and unpacked(packed(a)).dtype == a.dtype
    up = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (unpacked(packed(up, True), True) == up).all()


def test_pairs_of_any_size():
    rng = np.random.default_rng(2)
    v, w = rng.integers(0, 9, 500), rng.integers(0, 9, 500)
    for big in (0, 1 << 40):
        a, b, place = distinct_pairs(v + big, w)
        assert (a[place] == v + big).all() and (b[place] == w).all() and len(a) == len(set(zip(v.tolist(), w.tolist(), strict=True)))
        assert list(zip(a, b, strict=True)) == sorted(zip(a, b, strict=True))


def test_known_text_is_likelier_than_words_alone(spark, sf_dir):
    rows = score_language(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
