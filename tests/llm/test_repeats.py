"""The anchors' filter of op10 at the density of large tables."""

import random


def test_the_filter_of_repeated_anchors_grows_with_them(spark, monkeypatch):
    from veilspark.llm import repeats

    assert [repeats.filter_bits(n) for n in (0, 1 << 24, (1 << 24) + 1, 1 << 40)] == [1 << 27, 1 << 27, 1 << 28, 1 << 30]
    # few bits for many repeated anchors: what is sent must still be less than all stretches
    monkeypatch.setattr(repeats, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(repeats, "MOST_FILTER_BITS", 1 << 16)
    rng = random.Random(3)
    own = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    again = [own(3000) for _ in range(100)]
    rows = [(i, own(20_000) + again[i % 100]) for i in range(200)]
    sent = []
    monkeypatch.setattr(repeats, "_stretches", lambda *a, f=repeats._stretches: sent.append(a) or f(*a))
    spans = repeats.repeated_spans(repeats._keyed(spark.createDataFrame(rows, "doc_id long, text string")), 200 * 23_000).collect()
    assert len(sent[0][2].value) == 1 << 13 and 0 < sum(bin(x).count("1") for x in sent[0][2].value) < 1 << 15
    covered = {i: set() for i in range(200)}
    for r in spans:
        covered[r["order"]] |= set(range(r["lo"], r["hi"]))
    assert not any(covered[i] for i in range(100))
    for i in range(100, 200):
        first = 20_000
        while rows[i][1][first - 1] == rows[i - 100][1][first - 1]:
            first -= 1
        assert covered[i] == set(range(first, 23_000))


def test_names_are_induced_for_all_suffixes_at_once(monkeypatch):
    import numpy as np

    from veilspark.llm import suffix_array as module

    scanned, levels = module._induce_scanned, []
    monkeypatch.setattr(module, "_induce_scanned", lambda *a: levels.append(a[2]) or scanned(*a))
    rng = np.random.default_rng(11)
    part = rng.integers(1, 90, 9000)
    t = np.concatenate((part, rng.integers(1, 90, 40_000), part, [0]))
    raw = t.astype(">u2").tobytes()
    assert module.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: raw[2 * i:]) and not levels
    # falling runs, of which one symbol each is LMS: entry by entry, in proportion to the string
    for run in (np.full(4000, 7), np.arange(7000, 3000, -1)):
        t = np.concatenate((run, [2], run, [5000, 1], run[:70], [0]))
        raw = t.astype(">u2").tobytes()
        assert module.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: raw[2 * i:])
    assert levels
    for _ in range(300):
        t = np.append(rng.integers(1, rng.choice((2, 4, 50)) + 1, rng.integers(2, 90)), 0)
        s = module.classify(t)
        at = np.flatnonzero(s[1:] & ~s[:-1]) + 1
        at = np.array(sorted(at.tolist(), key=lambda i: t[i:].tolist()))
        assert module._induce_counted(t, s, int(t.max()) + 1, at).tolist() == scanned(t, s, int(t.max()) + 1, at).tolist()
