"""The training-data operators against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from veilspark.llm import html_text, line_dedup, queries, tokens
from veilspark.llm import suffix_array as sa_module
from veilspark.llm.components import connected_components
from veilspark.llm.decontaminate import UNITS, find_leaks
from veilspark.llm.line_dedup import drop_boilerplate
from veilspark.llm.mixing import mix_sources, source_targets
from veilspark.llm.near_dup import near_duplicates
from veilspark.llm.quality import FEATURES, grow, score_quality, statistics
from veilspark.llm.repeats import _keyed, remove_repeats, repeated_spans
from veilspark.llm.suffix_array import common_prefixes, full_prefixes, suffix_array
from veilspark.llm.tokens import VOCABULARY, attribute, count_tokens, encode, encoder
from veilspark.llm.topk import ROUNDS, block_top, top_k
from veilspark.llm.url_filter import judge_urls, rule_table


def _docs(spark, rows):
    """(doc_id, text) with extra columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, None, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, lang string, component_id string, n int, score double")


def _words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- queries with SQL ---------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    expected = Counter(repr(tuple(dict(zip(names, r, strict=True))[k] for k in columns)) for r in rel.fetchall())
    assert Counter(repr(tuple(r[k] for k in columns)) for r in df.collect()) == expected


# --- 1: exact top-k -----------------------------------------------------------


def test_bounds_never_lose_a_result():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 200, (500, 8)))
    v[:50] = v[0]  # ties
    q = np.floor(rng.normal(0, 200, (7, 8)))
    q[0] = 0
    ids = rng.permutation(500)
    got = block_top(ids, v, np.array([ids[0], -1, -2, -3, -4, -5, -6]), q, 10)
    for j, name in enumerate([ids[0], -1, -2, -3, -4, -5, -6]):
        best = sorted((-int(v[i] @ q[j]), int(ids[i])) for i in range(500) if ids[i] != name)[:10]
        assert [(-s, i) for _, i, s in [r for r in got if r[0] == name]] == best


def test_reading_stops_early():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None])
    trace = []
    block_top(np.arange(3000), v, np.arange(20), v[:20], 10, trace=trace)
    assert all(n <= 60 for _, _, n in trace) and min(r for _, r, _ in trace) < len(ROUNDS)


def test_scores_beyond_floats_and_longs():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 200, (60, 3)))
    v[3], v[4], v[5], v[6] = 2.0**60, -(2.0**60), 2.0**40 + 1, 2.0**31
    q = np.stack([v[3], v[6], v[0], v[1]])
    got = block_top(np.arange(60), v, np.array([3, 6, 0, 1]), q, 5)
    for name in (3, 6, 0, 1):
        score = {i: max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(v[i], v[name], strict=True)))) for i in range(60) if i != name}
        assert [(i, s) for j, i, s in got if j == name] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (3, [0.0, 1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (3, [0.0, 1.0]), (8, [])]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 524288), (0, 2, 3, 0), (100, 1, 0, 524288), (100, 2, 3, 524288)]
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 2: mixing ----------------------------------------------------------------


def test_targets_are_the_reshared_ones(spark):
    rng = random.Random(3)
    sizes = [(f"s{i:02}", rng.choice((0, 1, 50, 3000))) for i in range(11)] + [(None, 70)]
    rows = source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()
    names = sorted((s for s, _ in sizes if s)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = dict(sizes)
    fixed, left = {}, sum(size.values())
    while True:
        free = [s for s in names if s not in fixed]
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > 3 * size[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3 * size[s]
        left = sum(size.values()) - sum(fixed.values())
    want = fixed | {s: left * w[s] / sum(w[x] for x in free) for s in free}
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(want)


def test_mix_edges(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d", None), (4, "d", None), (None, "e f", "y"), (5, "\x1c g", "z")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, text string, source string, s string, size int")
    got = mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
    assert all(abs(by[r["source"]] - r["target"]) < 1 for r in got)
    assert sorted(map(tuple, mix_sources(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mix_sources(df.limit(0)).count() == 0


# --- 3: quality ---------------------------------------------------------------


def test_quality_holds_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels)
    assert got.columns == [*docs.columns, "score", "held_out", "predicted"]
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in own if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g, b in itertools.product(good, bad)]) > 0.9
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in score_quality(docs, flipped).collect()} == {r["doc_id"]: r["score"] for r in got.collect()}


def test_quality_edges(spark):
    docs = _docs(spark, [(1, None), (2, ""), (3, "x" * 100_000), (None, "text"), (4, "a"), (4, "a")])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = score_quality(docs, none).collect()
    assert len(got) == 6 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert score_quality(docs.limit(0), none).count() == 0


def test_learning_from_repeated_ids(spark):
    """The choice among texts of one id is the same in every run."""
    rng = random.Random(4)
    rows = [(i % 40, ("good words of a text. " if (i % 40) % 2 else "BAD!!! $$ ") * rng.randint(1, 30)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    runs = [{(r["doc_id"], r["text"]): r["score"] for r in score_quality(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), labels).collect()} for step, n in ((1, 1), (-1, 7))]
    assert runs[0] == runs[1]


def test_forest_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    forest = grow(x, (x[:, 1] + x[:, 2] > 0.3).astype(float), trees=12)

    def walk(row, node):
        if forest.feature[node] < 0:
            return forest.value[node]
        return walk(row, forest.left[node] + (row[forest.feature[node]] > forest.threshold[node]))

    want = [1 / (1 + np.exp(-(forest.base + sum(walk(r, n) for n in forest.roots)))) for r in x]
    assert forest.scores(x).tolist() == pytest.approx(want)


def test_statistics_by_hand():
    text = "One two two\n\nTHREE four#  aVeryLongWordOfMoreThanTwentyLetters 12.5 é!?"
    got = dict(zip(FEATURES, statistics(text), strict=True))
    raw, words, lines = text.encode(), text.encode().split(), text.encode().split(b"\n")
    share = lambda ok: sum(map(ok, raw)) / len(raw)
    of_words = lambda ok: sum(map(ok, words)) / len(words)
    want = {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "log_lines": np.log1p(len(lines)), "word_bytes": np.mean([len(w) for w in words]),
        "upper": share(lambda b: 65 <= b <= 90), "digits": share(lambda b: 48 <= b <= 57), "spaces": share(lambda b: b in b" \n"), "high": share(lambda b: b > 127),
        "marks": share(lambda b: b in b"#.!?"), "exclaims": share(lambda b: b == 33), "signs": share(lambda b: b == 35), "bars": 0, "stops": share(lambda b: b in b".?"),
        "entropy": -sum(c / len(raw) * np.log2(c / len(raw)) for c in Counter(raw).values()), "distinct_words": len(set(words)) / len(words), "top_word": 2 / len(words),
        "capital_words": of_words(lambda w: w[:1].isupper()), "shouted_words": of_words(lambda w: w.isupper() and len(w) > 1), "marked_words": of_words(lambda w: w[-1:] in b"#!"),
        "line_bytes": len(raw) / len(lines), "distinct_lines": 1, "long_words": of_words(lambda w: len(w) > 20), "short_words": of_words(lambda w: len(w) < 3), "doubled_words": 1 / len(words),
    }
    assert got == pytest.approx(want)


def test_forest_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = grow(x[:1500], y[:1500])
    assert ((forest.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


# --- 4: decontamination -------------------------------------------------------


def test_leaks(spark):
    item = "A train leaves Paris at 9 with 120 people and then after 3 hours the train stops where 40 people leave and Maria counts who is left on the train"
    same = f"before the text. {item} and after it"
    swapped = item.replace("120", "75").replace("40", "33").replace("Maria", "Olga").replace("9", "7").replace("Paris", "Rome")
    mixed = "he said A train leaves Paris at 9 and that was all of it so nothing else can be known about the people or the train"
    bench = spark.createDataFrame([(1, item), (2, "too short here"), (3, None), (1, item)], "item_id long, text string")
    docs = _docs(spark, [(1, same), (2, swapped), (3, mixed), (4, None), (5, ""), (6, "word " * 20_000), (7, same), (7, same), (None, same)])
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in find_leaks(docs, bench).collect()}
    assert got == {(1, 1): True, (2, 1): False, (7, 1): True, (None, 1): True}
    # copies in capitals and in lower case show no names
    docs = _docs(spark, [(1, f"STOP. {item.upper()}!! NOW!!"), (2, item.lower()), (3, "THE TRAIN IS LATE AND NOBODY KNOWS WHEN IT LEAVES THE STATION AGAIN")])
    assert {(r["doc_id"], r["exact"], r["coverage"]) for r in find_leaks(docs, bench).collect()} == {(1, True, 1.0), (2, True, 1.0)}
    # one value of the item with two values in the document isn't a copy
    twice = "the box of 5 kg and the bag of 5 kg were put on the cart by the men of the yard"
    bench = spark.createDataFrame([(1, twice)], "item_id long, text string")
    docs = _docs(spark, [(1, twice.replace("5", "8")), (2, twice.replace("5", "8", 1))])
    assert [r["doc_id"] for r in find_leaks(docs, bench).collect()] == [1]
    assert find_leaks(docs.limit(0), bench).count() == 0 == find_leaks(docs, bench.limit(0)).count()


def test_leaks_of_dense_and_short_items(spark):
    items = {1: "12 + 15 + 18 + 21 = ?", 2: "1901 45 3.5 77 1902 46 3.6 78 1903 47 3.7 79", 3: "he met Anna, Boris, Carla, Dmitri, Elena, Farid, Greta, Hiro, Ines, Jonas", 4: "?!", 5: "count on from 5 6 7 8 9 10 11 12 13 14 and say what is next in this row of numbers"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = [(i, f"Some words before it: {t}\nand others after it.") for i, t in items.items()] + [(10 + i, t.upper()) for i, t in items.items()]
    # other numbers and names of the same form
    docs += [(20, "13 + 15 + 18 + 21 = ?"), (21, "1801 46 4.5 78 1802 47 4.6 79 1803 48 4.7 80"), (22, "he met Olga, Peter, Clara, Diana, Erika, Frank, Gerda, Heinz, Irene, Julia"), (23, None), (24, "")]
    got = {(r["doc_id"], r["item_id"], r["coverage"], r["exact"]) for r in find_leaks(_docs(spark, docs), bench).collect()}
    assert got == {(10 * k + i, i, 1.0, True) for k in (0, 1) for i in (1, 2, 3, 5)}


def test_leaks_with_one_changed_figure(spark):
    item = "The men put a box of 5 kg on the cart and went to the mill. Then the miller gave them bread and they took another box of 5 kg from the yard and drove home to the town by night"
    one = " ".join(f"{a} and" for a in "oak elm ash fir yew box bay fig red blue green grey pink white black brown".split()) + " 48 or else 48 for all of them"
    bench = spark.createDataFrame([(1, item), (2, one)], "item_id long, text string")
    docs = [(1, item), (2, item.replace("5", "7", 1)), (3, item.replace("another box of 5 kg", "another box of 5 lb")), (4, item.replace("5", "7")), (5, one.replace("48", "49", 1)), (6, one.replace("else 48", "else 50"))]
    got = {r["doc_id"]: (r["item_id"], r["exact"], r["n_windows"] < r["n_item"]) for r in find_leaks(_docs(spark, docs), bench).collect()}
    assert got == {1: (1, True, False), 2: (1, False, True), 3: (1, False, True), 4: (1, False, False), 5: (2, False, True), 6: (2, False, True)}


def test_leaks_with_other_names_and_letters(spark):
    items = {
        1: "Maria buys 5 apples at the market. Then Maria eats 2 of them and gives the rest to her brother who was waiting at home",
        2: "The road from New York to the old mill by the river is 120 km long and the cart needs 6 hours for all of it",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = [
        (1, items[1].replace("Maria", "Olga").replace("5", "9")),
        (2, items[1].replace("Maria", "Anna Maria Lopez").replace("2", "3")),
        (3, items[2].replace("New York", "Rome").replace("120", "85")),
        (4, items[1].title()),
        (5, items[2].upper().replace("120", "85")),
        (6, items[2].title().replace("6", "7")),
        (7, items[1].replace("Maria buys", "Olga buys")),  # one name of two
        (8, "Olga sells 5 pears at the harbour. Then Maria reads 2 of them and shows the rest to her sister who was sitting at school"),
    ]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in find_leaks(_docs(spark, docs), bench).collect()}
    assert got == {(1, 1): False, (2, 1): False, (3, 2): False, (4, 1): True, (5, 2): False, (6, 2): False, (7, 1): True}


def _leaks_by_hand(docs, items, window=8, least=3):
    """(doc_id, item_id, n_windows, n_item, exact) of find_leaks, pair by pair."""

    def units(text):
        text = text or ""
        words, names, glued = [], [], False
        for m in regex.finditer(r"([^ \t\n\x0b\x0c\r]+)([ \t\n\x0b\x0c\r]*)", text):
            for raw, gap in [(m[1], m[2])]:
                w = regex.sub(r"[^\p{L}\p{N}]+", "", raw)
                follows = regex.match(r"\p{Lu}\p{L}*\p{Ll}", text, pos=m.end())
                here = regex.search(r"\p{Lu}\p{L}*(?<=\p{Ll})$", raw) and regex.fullmatch(r"[ \t]+", gap) and follows
                if w:
                    words.append(w)
                    if glued:
                        names[-1] += "\ue000" + w
                    else:
                        names.append(w)
                glued = bool(here) if w else False
        def kinds(us, named):
            out = []
            for u in us:
                if regex.search(r"\p{Nd}", u):
                    out.append("\x02")
                elif out and out[-1] == "\x02" and u.lower() in UNITS.split():
                    out.append("\x04")
                elif named and regex.match(r"\p{Lu}.*\p{Ll}", u):
                    out.append("\x03")
                else:
                    out.append(u.lower())
            return out
        return {1: (names, kinds(names, True)), 2: (words, kinds(words, False))}

    marks = {"\x02", "\x03", "\x04"}
    found = {}
    texts = [(d, t, units(t)) for d, t in set(docs)]
    for item_id, text in set(items):
        own = units(text)
        for kind, (w, t) in own.items():
            if not w or kind == 1 and ("\x03" not in t or len(t) < 5):
                continue
            n = min(window, len(t))
            wins = []
            for i in range(len(t) - n + 1):
                slots = sum(x in marks for x in t[i : i + n])
                dense = len(t) < 5 or slots * 2 > n or slots > 4
                if kind == 2 or not dense:
                    wins.append((i, dense))
            alike = sum(not dense for _, dense in wins)
            several = bool(regex.search(r"(?:[.!?…][^\p{L}\p{N}\s]*\s|[。！？।\n])[^\p{L}\p{N}]*[\p{L}\p{N}]", text.strip(" ")))
            index = defaultdict(list)
            for i, dense in wins:
                index[dense, tuple(x.lower() for x in w[i : i + n]) if dense else tuple(t[i : i + n])].append(i)
            for doc_id, body, both in texts:
                dw, dt = both[kind]
                lined = defaultdict(list)
                for a in range(len(dt) - n + 1):
                    for dense, key in ((True, tuple(x.lower() for x in dw[a : a + n])), (False, tuple(dt[a : a + n]))):
                        for i in index.get((dense, key), ()):
                            lined[a - i].append((i, a, dense))
                for hits in lined.values():
                    equal = [[x.lower() for x in w[i : i + n]] == [x.lower() for x in dw[a : a + n]] for i, a, _ in hits]
                    slots = {(t[i + j], w[i + j], dw[a + j]) for i, a, dense in hits if not dense for j in range(n) if t[i + j] in marks}
                    consistent = len(slots) == len({x[:2] for x in slots})
                    enough = len(hits) >= min(least, len(wins)) or alike and sum(not d for _, _, d in hits) >= min(least, alike)
                    if consistent and enough or sum(equal) >= (least if several else 2 * window):
                        best = (len(hits) if consistent else sum(equal), all(equal), len(wins))
                        found[doc_id, item_id] = max(best, found.get((doc_id, item_id), best))
    return {(*k, n, m, e) for k, (n, e, m) in found.items()}


def test_leaks_by_hand(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rng = random.Random(6)
    names, plain = ["Anna", "Boris Gray", "Carla", "New York", "Rome"], docs[:20]
    for k in range(30):  # word problems, and copies with other values, edits and letters
        words = [rng.choice([*(["of", "the", "and", "with", "men", "box", "cart", "mill", "bread", "yard"]), "Then", rng.choice(names), str(rng.randint(2, 99)), "5 kg", "walks.\nThe"]) for _ in range(rng.randint(3, 30))]
        items.append((1000 + k, " ".join(words)))
        for c in range(4):
            other = [rng.choice(names) if w in names and rng.random() < 0.5 else str(rng.randint(2, 99)) if w.isdigit() and rng.random() < 0.5 else w for w in words]
            copy = rng.choice([str, str.upper, str.title, str])(" ".join(other))
            docs.append((5000 + 10 * k + c, f"{plain[k % 20][1][:60]} {copy} {rng.choice(['and so on', 'THE END'])}"))
    docs += [(9000, None), (9001, ""), (9002, "?!"), (9003, items[-1][1])]
    got = {tuple(r[c] for c in ("doc_id", "item_id", "n_windows", "n_item", "exact")) for r in find_leaks(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = _leaks_by_hand(docs, items)
    assert len(want) > 80
    assert got == want


# --- 5: near duplicates -------------------------------------------------------


def _components(rows, similarity):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            root[top(j)] = top(i)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[top(i)].append(d)
    return [(d, len(s), min(low[top(i)]) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("blocks", [{}, {"list_block": 4, "set_block": 300}])
def test_near_duplicates(spark, blocks):
    rng = random.Random(5)
    rows = [(1000 + i, _words(rng, 60)) for i in range(20)]
    for i in range(60):  # copies with more and more edits, near the bound
        words = rows[i % 3][1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        rows.append((rng.randrange(10**6), " ".join(words)))
    rows += [(5, "One two"), (6, "one  TWO"), (7, "one two three"), (8, None), (9, ""), (10, " \n"), (11, "É a b c d"), (12, "é a b c d"), (13, "x " * 30_000), (13, "x " * 30_000)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(_docs(spark, rows), **blocks).collect())
    assert got == sorted(_components(rows, 85))


def test_one_large_group_of_near_copies(spark):
    """Chains of edits: the first class of a cluster doesn't reach all others."""
    rng = random.Random(12)
    words, rows = _words(rng, 120).split(), []
    for i in range(120):
        words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(_docs(spark, rows), set_block=1000).collect())
    assert got == sorted(_components(rows, 85)) and {c for _, _, c in got} == {0}


def test_near_duplicates_without_ids(spark):
    rows = near_duplicates(_docs(spark, [(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "q")])).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == Counter({(None, 4, False): 2, (4, 4, True): 1, (None, None, True): 1})
    assert near_duplicates(_docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


# --- 6: lines -----------------------------------------------------------------


def test_lines(spark):
    rows = [(i, f"own {i}\n Menu \n\nlast {i}", "a") for i in range(30)] + [(99, "Menu\nMenu", "b"), (98, None, "a"), (97, "", None), (96, "Menu", "a")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, n_lines int, pages string")
    got = {r["doc_id"]: r for r in drop_boilerplate(df).collect()}
    assert drop_boilerplate(df).columns == ["doc_id", "text", "source", "pages", "n_lines", "n_dropped"]
    assert got[3]["text"] == "own 3\n\nlast 3" and (got[3]["n_lines"], got[3]["n_dropped"]) == (4, 1)
    assert got[99]["text"] == "Menu\nMenu" and got[98]["text"] is None and got[97]["text"] == "" and got[96]["text"] == ""
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_lines_of_many_hosts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    df = spark.createDataFrame([(i, f"own {i}\nfooter of {i % 3}", "abc"[i % 3]) for i in range(90)] + [(90, None, None)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in drop_boilerplate(df).collect()} == {i: f"own {i}" for i in range(90)} | {90: None}


# --- 7: tokens ----------------------------------------------------------------


def test_tokens_add_up(spark):
    texts = [(1, "First line\n\n  second – línea\n"), (2, None), (3, ""), (4, "é" * 5000 + "\n" + "<|endoftext|>"), (None, "a\nb"), (1, "again")]
    encoding, sizes = encoder(VOCABULARY)
    got = count_tokens(_docs(spark, texts)).collect()
    by = defaultdict(int)
    for r in got:
        by[r["doc_id"]] += r["n_tokens"]
    want = defaultdict(int)
    for i, t in texts:
        want[i] += len(encoding.encode_ordinary(t or ""))
        assert sizes[encoding.encode_ordinary(t or "")].sum() == len((t or "").encode())
    assert by == want
    own = sorted((r["section"], r["start"], r["end"]) for r in got if r["doc_id"] == 4)
    assert own == [(0, 0, 5001), (1, 5001, 5014)]
    fields = count_tokens(_docs(spark, texts), ("text", "component_id"), by_line=False)
    assert fields.where("doc_id = 2").orderBy("field").select("field", "n_tokens").collect() == [("component_id", 1), ("text", 0)]
    assert count_tokens(_docs(spark, [])).count() == 0


def test_long_white_space(spark, monkeypatch):
    encoding, sizes = encoder(VOCABULARY)
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "x" * 100_000]
    got = count_tokens(_docs(spark, list(enumerate(texts)))).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in got} == {i: len(encode(encoding, t)) for i, t in enumerate(texts)}
    assert all(sizes[encode(encoding, t)].sum() == len(t) for t in texts)
    # splitting at every short run gives the tokens of the whole text
    monkeypatch.setattr(tokens, "_RUN", re.compile(f"[{tokens._SPACES}]{{3,}}"))
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice([" " * rng.randint(1, 9), "\n" * rng.randint(1, 6), "ab", "9", "'s", "!", " x", "\t \n", "\u3000 ", "\x1c", "é", "\x85"]) for _ in range(rng.randint(0, 14)))
        assert encode(encoding, t) == encoding.encode_ordinary(t)


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_tokens_of_each_section(spark, sf_dir, rule):
    """Each token by itself, byte by byte."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoding, sizes = encoder(VOCABULARY)
    got = defaultdict(list)
    for r in count_tokens(docs, rule=rule).orderBy("doc_id", "section").collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["n_tokens"]))
    for r in docs.collect():
        line, section_of, spans, at = 0, [], [], 0
        for part in (r["text"] or "").split("\n"):
            n = len(part) + (at + len(part) < len(r["text"] or ""))
            section_of += [line] * len((r["text"] or "")[at : at + n].encode())
            spans.append((at, at + n))
            line, at = line + 1, at + n
        counts, at = [0] * line, 0
        for token in encoding.encode_ordinary(r["text"] or ""):
            own = section_of[at : at + int(sizes[token])]
            counts[{"first": own[0], "last": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]] += 1
            at += len(own)
        assert got[r["doc_id"]] == [(a, b, c) for (a, b), c in zip(spans, counts, strict=True)]


def test_rules_for_crossing_tokens():
    sizes, ends = np.array([2, 4, 3]), np.array([3, 3, 9])
    assert attribute(sizes, ends, "first").tolist() == [2, 0, 1]
    assert attribute(sizes, ends, "last").tolist() == [1, 0, 2]
    assert attribute(sizes, ends, "most").tolist() == [1, 0, 2]


# --- 8: pages -----------------------------------------------------------------


def test_pages(spark):
    page = """<!doctype html><html><head><title>t</title><script>var a="</p><article>";</script></head><body class="home"><nav><a>menu</a></nav><div id=sideBar>side</div>
    <article class=post><header><h1>Head &amp; <i>line</i></h1></header><p><b>One&nbsp;two<br>three<p>fo<b>ur</b> &lt;b&gt; <!-- no > --> five<div class="cookie-notice">cookies</div><ul><li>six<li>seven</ul>
    <form>name <input></form><section class="comments"><article>nice!</article></section><footer>by me</footer></article><aside>more</aside><footer>&copy;</footer>"""
    text = "Head & line One two three four <b> five six seven"
    assert html_text.main_text(page) == text
    bare = "".join(f"<div class=box{i}>part {i}</div>" for i in range(3))
    rows = [(1, "http://a.org/1", page, "x"), (2, None, None, "x"), (3, "http://a.org/2", "", "x"), (4, "nothing", "plain < text & more", "x"), (5, "http://b.org", bare, "x")]
    rows += [(100 + i, "http://c.org/x", f"<body><div class=top>Same words</div><div class=main>Own words {i}</div></body>", "x") for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(df).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == (text, "", "", "plain < text & more", "part 0 part 1 part 2")
    assert got[103] == "Own words 3"
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><div class=top>Menu words</div><div class=text>The only text of it</div></body>"
    rows = [(i, "http://a.org/x", page) for i in range(200)] + [(200, "http://a.org/y", page.replace("only", "other"))]
    # a host of distinct pages and copies of one
    rows += [(300 + i, "http://b.org/x", f"<body><div class=top>Menu words</div><div class=text>Own words {i % 20}</div></body>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(200)} == {"Menu words The only text of it"} and got[200] == "Menu words The other text of it"
    assert all(got[300 + i] == f"Own words {i % 20}" for i in range(60))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article class='post has-sidebar'><p>Own text</p></article>", "Own text"),
        ("<article class=sidebar><p>Own text</p></article>", "Own text"),
        ("<main class='content no-comments widget'><p>Own text</p></main>", "Own text"),
        ("<div id='page' class='right-sidebar'>Own text<div class='sidebar'>side</div><div id=adBanner>ad</div><i class=share>s</i></div>", "Own text"),
        ("<div class=widget><a class=promo><main><article class=search><p>Own text</p><div class=comments><article>no</article></div></article></main></a></div><div class=widget>no</div>", "Own text"),
        ("<article><p>Sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> and <object data=x>picture</object> here</p></article>", "Sum a+b and picture here"),
        ("<p>One<p><select><option>Two<p>Three", "One Two Three"),
        ("<p>One<script src=x><p>Two<title>a<p>Three", "One Two Three"),
        ("\u0130" * 12 + "<p>One<SCRIPT>x</Script >two</p><style>y</style>three", "\u0130" * 12 + " Onetwo three"),
        ("<script>a</scripts></script>One", "One"),
    ],
)
def test_cue_words_and_raw_elements(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=don't>The link and it's more</p>", "The link and it's more"),
        ("""<p data-x="a>b" title='c>d' e=f'g>One</p>""", "One"),
        ("<main><fieldset>Only words</fieldset></main>", "Only words"),
        ("<main><p>Text</p><fieldset>Your name</fieldset></main>", "Text"),
        ("<div class=widget><h1>Head</h1><p>Words</p></div>", "Head Words"),
        ("<div class=ad>Buy now</div>", ""),
        ("<article></article><div class=ad>Buy now</div>", ""),
        ("<div>Own words<div class=comments><p>I agree</p></div><h2 id=related-work>Related work</h2></div>", "Own words Related work"),
        ("<p>one <span class=share>share me</span> two</p>", "one two"),
    ],
)
def test_names_are_priors(page, text):
    assert html_text.main_text(page) == text


def _site(n, rng):
    """Pages without article and without telling names: a head line, links in
    one of two orders, text and a closing line."""
    out = []
    for i in range(n):
        links = "<div class=x1><span>Home</span></div><div class=x2><span>About us</span></div>"
        own = "".join(f"<div class=c><div>{_words(rng, 12)} {i}</div></div>" for _ in range(rng.randint(1, 3)))
        out.append(f"<body><div class=a{i}>Daily words for all</div><div class=b>{links}</div><div class=q>{own}</div><div class=z>All rights are ours, {('2023', '2024')[i % 2]}</div></body>")
    return out


def test_importance_decides(spark):
    """Without names only the merged tree tells what is of the page."""
    rng = random.Random(8)
    pages = _site(40, rng)
    rows = [(i, "http://a.org/x", p) for i, p in enumerate(pages)] + [(100, "http://b.org/x", pages[0])]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, p in enumerate(pages):
        own = " ".join(re.findall(r"<div>(w[^<]*)</div>", p))
        assert got[i] == own != html_text.main_text(p)
    assert got[100] == html_text.main_text(pages[0])  # one page of a host says nothing


def test_importance_by_hand(spark):
    rng = random.Random(9)
    pages = [*_site(12, rng), *_site(1, rng) * 5]
    got = {r["path"]: (r["pages"], r["importance"]) for r in html_text.node_importance(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).collect()}
    content, shape, seen = defaultdict(Counter), defaultdict(Counter), set()
    for p in pages:
        found, runs = html_text.blocks(p)
        text = "|".join(x.text for x in found)
        if text not in seen:
            seen.add(text)
            for path, value in {(x.path, x.text) for x in found}:
                content[path][value] += 1
            for path, value in set(runs):
                shape[path][value] += 1

    def spread(c):
        m = sum(c.values())
        return 1.0 if m == 1 else 1 - sum(k * np.log(k) for k in c.values()) / m / np.log(m)

    want = {p: (sum(c.values()), 0.1 * spread(shape[p.rsplit("/", 1)[0]]) + 0.9 * spread(c)) for p, c in content.items()}
    assert {p: n for p, (n, _) in got.items()} == {p: n for p, (n, _) in want.items()}
    assert {p: i for p, (_, i) in got.items()} == pytest.approx({p: i for p, (_, i) in want.items()})


def test_near_copies_of_an_article_keep_it(spark):
    """One article on all pages of a host, with other adverts or an edit."""
    rng = random.Random(10)
    text = [_words(rng, 20) for _ in range(4)]
    page = lambda i, last: f"<nav>n{i}</nav><div class=ad>ad {i}</div><article><h1>Head</h1>{''.join(f'<p>{t}</p>' for t in [*text, last])}</article>"
    rows = [(i, "http://a.org", page(i, "the same")) for i in range(60)] + [(100 + i, "http://b.org", page(i, f"edit {i}")) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(["Head", *text, "the same" if i < 100 else f"edit {i - 100}"]) for i in got)


@pytest.mark.parametrize("limit", [0, 16 << 20])
def test_branches_of_many_hosts(spark, monkeypatch, limit):
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", limit)
    rows = [(i, f"http://h{i % 4}.org", f"<div class=a>Same words</div><div class=b>Own words {i}</div>") for i in range(60)] + [(99, None, "<p>x</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words {i}" for i in range(60)} | {99: "x"}


# --- 9: URLs ------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://Example.ORG/es/1", "https://www.example.org/en/12?q", "https://example.org/en/2#x", "http://other.org", "http://other.org/", "ftp://a.com/fr/x", "http://a.com/de/", "http://a.net/de/", None, "no scheme", "http://notexample.org/es/", "http:///x", "http://a.com/es/", "http://a.b://c"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(0, urls[0], "c")], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in judge_urls(pages, rule_table(spark)).collect()}
    assert [got[i][1] for i in range(len(urls))] == ["example.org/es/", "example.org/en/1", "org/", None, "org/", "com/fr/", "com/de/", None, None, None, "org/", None, None, None]
    assert [got[i][2] for i in (0, 1, 2, 6, 7)] == ["block", "block", "allow", "block", "allow"] and got[0][0] == "example.org" and got[9][0] == ""
    nothing = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in judge_urls(pages, nothing, "block").collect()} == {"block"}
    assert judge_urls(pages.limit(0), rule_table(spark)).count() == 0


# --- 10: repeats --------------------------------------------------------------


def _kept(rows, length=50):
    out, first = [], {}
    order = lambda d: float("inf") if d is None else d
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, float("inf")), order(d))
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order(d):
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats(spark):
    rng = random.Random(2)
    passage = _words(rng, 60)
    rows = [(i, _words(rng, 40)) for i in range(20)]
    rows += [(100 + i, f"{_words(rng, rng.randint(0, 20))} {passage[rng.randint(0, 30):]} {_words(rng, 5)}") for i in range(15)]
    rows += [(200, "ab" * 300), (201, "ab" * 200), (202, "a" * 49), (203, "a" * 49), (204, None), (205, ""), (206, "é" * 40), (207, "xé" + "é" * 39), (7, rows[3][1]), (3, rows[3][1]), (None, passage), (None, passage + "!"), (-5, "z" * 70_000), (300, "z" * 70_100 + passage)]
    got = sorted((tuple(r)[:5] for r in remove_repeats(_docs(spark, rows)).collect()), key=str)
    assert got == sorted(_kept(rows), key=str)
    assert remove_repeats(_docs(spark, [])).count() == 0


def test_hot_anchors_change_nothing(spark):
    rng = random.Random(4)
    passage = _words(rng, 40)
    keyed = _keyed(_docs(spark, [(i, f"{_words(rng, 10)} {passage} {_words(rng, 10)}") for i in range(30)]))

    def covered(spans):
        out = defaultdict(set)
        for r in spans.collect():
            out[r["order"]].update(range(r["lo"], r["hi"]))
        return out

    assert covered(repeated_spans(keyed, 10**6)) == covered(repeated_spans(keyed, 10**6, hot_rows=4))


def test_prefixes_of_long_repeats():
    rng = random.Random(7)
    for _ in range(40):
        part = [rng.randint(1, rng.choice((3, 60_000, 200_000))) for _ in range(rng.randint(1, 25))]
        t = np.array(part * rng.randint(1, 4) + [rng.randint(1, 9)] + part + [0])
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix_array(t)
        assert sa.tolist() == order
        p = common_prefixes(t, sa)
        assert p[order[0]] == 0
        for a, b in itertools.pairwise(order):
            assert p[b] == next(k for k in range(len(t)) if t[a + k] != t[b + k])


def test_large_alphabets_are_induced(monkeypatch):
    """No level is sorted in another way, however many names there are."""
    rng = np.random.default_rng(5)
    t = np.append(rng.integers(1, 40, 60_000), 0)
    levels = []
    counted = sa_module._induce_counted
    monkeypatch.setattr(sa_module, "_induce_counted", lambda t, s, k, lms: levels.append(k) or counted(t, s, k, lms))
    sa = suffix_array(t)
    assert levels and max(levels) > sa_module.BUCKETS
    raw = t.astype(">u2").tobytes()
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[2 * i : 2 * i + 100])


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(200):
        t = np.array([rng.randint(1, rng.choice((2, 5, 3000))) for _ in range(rng.randint(1, 60))] + [0])
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix_array(t)
        assert sa.tolist() == order
        p = common_prefixes(t, sa, 6)
        for a, b in itertools.pairwise(order):
            n = next((k for k in range(6) if a + k >= len(t) or b + k >= len(t) or t[a + k] != t[b + k]), 6)
            assert p[b] == n
        assert (full_prefixes(t, sa, 3) == (common_prefixes(t, sa, 3) == 3)).all()
