"""Language-model scores by Katz backoff over words.

The model has two tables, partitioned by hashes of their keys: words with their
counts, and pairs of a context and a word with their counts, Good-Turing
discounts and what a context needs for its backoff weight. Texts are read once,
into blocks of whole documents that hold their words as numbers. A block sends
each partition of a table the keys that it has, each once, with its own counts;
the partition adds up, keeps its part of the model and answers each block with
the counts of its keys. So what moves are distinct keys of blocks, packed as
arrays, never words one by one, and a frequent word is one key of a block.
Pairs of a context that is too frequent for one partition are split by their
words. When all answers are there, each block evaluates its documents word by
word: a known pair by its discounted count, any other by the context's backoff
weight and, recursively, the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix, word_hashes
from .storage import bounded_batches, materialise, released

FOLDS, ADDED = 10, 0.1
#: Counts up to this are discounted.
K = 5
#: Words of a block (whole texts: the last one may exceed it), and keys of a partition on average.
BLOCK_WORDS = 1 << 19
PART_KEYS = 1 << 20
#: Contexts that occur more often are split to pieces of about so many
#: occurrences; there are at most all words / HOT_CONTEXT of them.
HOT_CONTEXT = 1 << 21
_U = np.uint64
#: Hashes of the start of a text, which is a context only, and of its end.
START, END = _U(1), _U(2)


# --- arrays as bytes ------------------------------------------------------------


def packed(a: np.ndarray, ascending: bool = False) -> bytes:
    """An array of numbers as compressed byte planes; of an ascending one the
    differences."""
    if ascending:
        a = np.diff(a, prepend=a.dtype.type(0))
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(b: bytes, ascending: bool = False) -> np.ndarray:
    n, dtype = int.from_bytes(b[:8], "little"), np.dtype(b[8:12].decode().strip())
    raw = pa.decompress(b[12:], n * dtype.itemsize, "zstd", asbytes=True) if n else b""
    a = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if ascending else a


def _least(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the least of the unsigned types."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def distinct_pairs(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the place of each given pair among them."""
    if max(v.max(initial=0), w.max(initial=0)) < 1 << 32:
        key, place = np.unique(v.astype(_U) << _U(32) | w.astype(_U), return_inverse=True)
        return (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64), place
    order = np.lexsort((w, v))
    new = np.ones(len(v), bool)
    new[1:] = (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0)
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(new) - 1
    return v[order][new], w[order][new], place


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each hash: ranges of its upper half."""
    return ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _by(frames: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    rows = (r for frame in frames for r in frame.to_pylist())
    return ((k, list(own)) for k, own in groupby(rows, lambda r: r[key]))


def _row(schema: str, **values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds[k]) for n, k in names], names=[n for n, _ in names])


# --- blocks ----------------------------------------------------------------------

BLOCK = "block long, n_docs long, n_train long, n_words long, n_keys long, ids binary, has_id binary, held binary, sizes binary, words binary, counts binary, own binary, at binary"


def _encode(block_words: int):
    """Documents (doc_id, held, text) as blocks. A document's words stand
    between START and END; ``at`` numbers them by their frequency in the block
    (ties by hash), ``words`` are the hashes in order with the counts in all
    documents (counts) and in those learnt from (own)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, held, sizes, parts = [], [], [], []

        def row():
            nonlocal made
            h, n = np.concatenate(parts), np.concatenate(sizes)
            out = np.concatenate(held)
            words, place, counts = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            rank[np.lexsort((words, -counts))] = np.arange(len(words))
            own = np.bincount(place[np.repeat(~out, n)], minlength=len(words))
            has = np.array([x is not None for x in ids])
            batch = _row(BLOCK, block=base + made, n_docs=len(n), n_train=int((~out).sum()), n_words=len(h), n_keys=len(words), ids=packed(np.array([x or 0 for x in ids], np.int64)), has_id=packed(has.view(np.uint8)), held=packed(out.view(np.uint8)), sizes=packed(_least(n)), words=packed(words, True), counts=packed(_least(counts)), own=packed(_least(own)), at=packed(rank[place].astype(np.uint32)))
            made += 1
            for x in (ids, held, sizes, parts):
                x.clear()
            return batch

        size = 0
        for frame in frames:
            texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in frame["text"].to_pylist()]
            doc, h = word_hashes(texts)
            n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
            h = _framed(h, n)
            ids += frame["doc_id"].to_pylist()
            held.append(np.array(frame["held"].to_pylist(), bool))
            sizes.append(n + 2)
            parts.append(h)
            size += len(h)
            if size >= block_words:
                yield row()
                size = 0
        if ids:
            yield row()

    return run


def _framed(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words of documents of ``n`` words with START and END around each."""
    out = np.empty(len(h) + 2 * len(n), _U)
    ends = np.cumsum(n + 2)
    edge = np.zeros(len(out), bool)
    edge[ends - 1] = edge[ends - n - 2] = True
    out[~edge] = h
    out[ends - 1], out[ends - n - 2] = END, START
    return out


# --- words -----------------------------------------------------------------------

ASK_WORDS = "part int, block long, words binary, own binary"
WORDS = "kind string, part int, block long, n long, v long, a binary, b binary, c binary"


def _ask_words(parts: int):
    def run(frames):
        for frame in frames:
            for r in frame.to_pylist():
                words, own = unpacked(r["words"], True), unpacked(r["own"])
                cut = np.searchsorted(_part(words, parts), np.arange(parts + 1))
                for p in range(parts):
                    lo, hi = cut[p : p + 2]
                    if hi > lo:
                        yield _row(ASK_WORDS, part=p, block=r["block"], words=packed(words[lo:hi], True), own=packed(own[lo:hi]))

    return run


def _answer_words(parts: int):
    """kind word: a part of the table of words (hashes, numbers, counts);
    kind reply: numbers and counts of a block's words, 0 for unknown ones.
    Frequent words have small numbers, whatever their part."""

    def run(frames):
        for p, rows in _by(frames, "part"):
            asked = [unpacked(r["words"], True) for r in rows]
            words, place = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(place, np.concatenate([unpacked(r["own"]) for r in rows]).astype(float), len(words)).astype(np.int64)
            known, number = np.flatnonzero(total), np.zeros(len(words), np.int64)
            order = known[np.argsort(-total[known], kind="stable")]
            number[order] = 1 + p + parts * np.arange(len(order))
            yield _row(WORDS, kind="word", part=p, n=int(total.sum()), v=len(known), a=packed(words[known], True), b=packed(number[known]), c=packed(_least(total[known])))
            lo = 0
            for r, own in zip(rows, asked, strict=True):
                at = place[lo : lo + len(own)]
                lo += len(own)
                yield _row(WORDS, kind="reply", part=p, block=r["block"], b=packed(_least(number[at])), c=packed(_least(total[at])))

    return run


# --- pairs -----------------------------------------------------------------------

ASK_PAIRS = "part int, block long, v binary, at binary, own binary, w binary, c binary"
PAIRS = "kind string, part int, block long, a binary, b binary, c binary, d binary"


class _Numbered:
    """A block with the numbers and counts of its words."""

    def __init__(self, r: dict, parts: int, hot_context: int) -> None:
        counts = unpacked(r["counts"]).astype(np.int64)
        reply = sorted(r["words_reply"], key=lambda x: x["part"])
        number, total = (_least(np.concatenate([unpacked(x[c]) for x in reply])) for c in "bc")
        rank = np.lexsort((np.arange(len(counts)), -counts))
        at, self.sizes = unpacked(r["at"]), unpacked(r["sizes"]).astype(np.int64)
        self.held = unpacked(r["held"]).astype(bool)
        self.number, self.total = number[rank][at], total[rank][at]
        #: Places of words and ends, the others are starts.
        self.said = np.ones(len(at), bool)
        self.said[np.cumsum(self.sizes) - self.sizes] = False
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        known = self.said.copy()
        known[1:] &= self.number[:-1] > 0
        self.with_context = np.flatnonzero(known)
        self.v, self.w, place = distinct_pairs(self.number[self.with_context - 1], self.number[self.with_context])
        n = len(self.v)
        self.context_total, self.word_total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.context_total[place], self.word_total[place] = self.total[self.with_context - 1], self.total[self.with_context]
        pieces = 1 + self.context_total // hot_context
        self.part = _part(mix(self.v.astype(_U) * _U(0x9E3779B97F4A7C15) + (self.w % pieces).astype(_U)), parts)
        order = np.argsort(self.part, kind="stable")
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.v, self.w, self.part, self.context_total, self.word_total = (x[order] for x in (self.v, self.w, self.part, self.context_total, self.word_total))
        #: The pair of each place in with_context.
        self.pair = back[place]


def _ask_pairs(parts: int, hot_context: int):
    def run(frames):
        for frame in frames:
            for r in frame.to_pylist():
                own = _Numbered(r, parts, hot_context)
                if not len(own.v):
                    continue
                learnt = ~own.held[own.doc[own.with_context]]
                counts = np.bincount(own.pair[learnt], minlength=len(own.v))
                cuts = np.flatnonzero(np.diff(own.part, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(own.v)], strict=True):
                    # words of a partition once, with their counts, in order of number, so of frequency
                    w, first, at = np.unique(own.w[lo:hi], return_index=True, return_inverse=True)
                    yield _row(ASK_PAIRS, part=int(own.part[lo]), block=r["block"], v=packed(own.v[lo:hi], True), at=packed(_least(at)), own=packed(_least(counts[lo:hi])), w=packed(w, True), c=packed(own.word_total[lo:hi][first]))

    return run


def word_probability(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return (c + ADDED) / (n + ADDED * (v + 1))


def _contexts(v: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts of known pairs; how many of their words have each of
    the counts 1 to K; and the probability of all their words as words alone."""
    own, place = np.unique(v, return_inverse=True)
    low = np.flatnonzero(c <= K)
    few = np.bincount(place[low] * K + c[low] - 1, minlength=len(own) * K).reshape(len(own), K)
    return own, few, np.bincount(place, p, len(own))


def _answer_pairs(n: int, vocabulary: int):
    """kind pair: a part of the table of pairs (contexts, words, counts); kind
    context: its contexts (numbers, few, p); kind hot: those of split contexts;
    kind times: how many pairs have each count up to K + 1; kind reply: counts
    of a block's pairs, and the contexts that the block needs: those of pairs
    that aren't known, and those without counts up to K."""

    def run(frames):
        for part, rows in _by(frames, "part"):
            vs, ws, cs = [], [], []
            for r in rows:
                at, w = unpacked(r["at"]), unpacked(r["w"], True)
                vs.append(unpacked(r["v"], True))
                ws.append(w[at])
                cs.append(unpacked(r["c"])[at])
            v, w, place = distinct_pairs(np.concatenate(vs), np.concatenate(ws))
            total = np.bincount(place, np.concatenate([unpacked(r["own"]) for r in rows]).astype(float), len(v)).astype(np.int64)
            alone = np.empty(len(v), np.int64)
            alone[place] = np.concatenate(cs)
            known = np.flatnonzero(total)
            own, few, p = _contexts(v[known], total[known], word_probability(alone[known], n, vocabulary))
            yield _row(PAIRS, kind="pair", part=part, a=packed(v[known], True), b=packed(_least(w[known])), c=packed(_least(total[known])))
            yield _row(PAIRS, kind="context", part=part, a=packed(own, True), b=packed(_least(few.ravel())), c=packed(p))
            yield _row(PAIRS, kind="times", part=part, a=packed(np.bincount(total[known][total[known] <= K + 1], minlength=K + 2)[1:]))
            some = few.any(axis=1)
            lo = 0
            for r, asked in zip(rows, vs, strict=True):
                counts = total[place[lo : lo + len(asked)]]
                lo += len(asked)
                mine, at = np.unique(asked, return_inverse=True)
                need = np.zeros(len(mine), bool)
                need[at[counts == 0]] = True
                where = np.minimum(np.searchsorted(own, mine), max(0, len(own) - 1))
                there = own[where] == mine if len(own) else np.zeros(len(mine), bool)
                send = there & (need | ~some[where] if len(own) else need)
                yield _row(PAIRS, kind="reply", part=part, block=r["block"], a=packed(_least(counts)), b=packed(mine[send], True), c=packed(_least(few[where[send]].ravel())), d=packed(p[where[send]]))

    return run


def _hot_contexts(words: DataFrame, pairs: DataFrame, hot_context: int) -> dict[int, tuple[np.ndarray, float]]:
    """few and p of the contexts that are split, summed over their pieces;
    at most all words / ``hot_context`` of them, looked for in tasks."""

    def often(frames):
        for frame in frames:
            for r in frame.to_pylist():
                total = unpacked(r["c"]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"v": pa.array(unpacked(r["b"])[total >= hot_context], pa.int64())})

    hot = sorted(r["v"] for r in words.where("kind = 'word'").select("b", "c").mapInArrow(often, "v long").collect())
    if not hot:
        return {}
    wanted = np.array(hot)

    def of(frames):
        for frame in frames:
            for r in frame.to_pylist():
                v, few, p = unpacked(r["a"], True), unpacked(r["b"]).astype(np.int64).reshape(-1, K), unpacked(r["c"])
                at = np.flatnonzero(np.isin(v, wanted))
                yield pa.RecordBatch.from_pydict({"v": pa.array(v[at], pa.int64()), "few": pa.array(few[at].tolist(), pa.list_(pa.int64())), "p": pa.array(p[at], pa.float64())})

    rows = pairs.where("kind = 'context'").select("a", "b", "c").mapInArrow(of, "v long, few array<long>, p double")
    sums = rows.groupBy("v").agg(*[F.sum(F.col("few")[i]).alias(f"n{i}") for i in range(K)], F.sum("p").alias("p"))
    return {r["v"]: (np.array([r[f"n{i}"] for i in range(K)]), r["p"]) for r in sums.collect()}


def discounts(times: list[int]) -> np.ndarray:
    """The share of itself that a count of 0 to K keeps, from how many pairs
    have the counts 1 to K + 1 (the one of 0 is 1).

    Good and Turing's, as Katz has it; where it gives a count no share between
    0 and 1, that count loses what absolute discounting takes, n1 / (n1 + 2 n2),
    or a half where one of these is 0.
    """
    n = [0, *times]
    lost = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    rest = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    out = [1.0]
    for r in range(1, K + 1):
        share = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out.append(share if 0 < share < 1 else (r - lost) / r)
    return np.array(out)


def backoff(few: np.ndarray, p: np.ndarray, total: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, divisor) of contexts from few, p and how often they occur.

    What discounting takes from a context's words goes to all others in
    proportion to their probability alone. A context all of whose counts are
    above K loses nothing; one is added to its divisor, and that is left.
    """
    taken = few @ ((1 - share[1:]) * np.arange(1, K + 1))
    none = taken == 0
    divisor = total + none
    return np.where(none, 1.0, taken) / divisor / (1 - p), divisor.astype(float)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _evaluate(parts: int, hot_context: int, n: int, vocabulary: int, share: np.ndarray, hot: dict):
    def run(frames):
        for frame in frames:
            for r in frame.to_pylist():
                own = _Numbered(r, parts, hot_context)
                log_p = np.log10(word_probability(own.total, n, vocabulary))
                log_p[~own.said] = 0
                score = log_p.copy()
                if len(own.v):
                    reply = sorted(r["pairs_reply"], key=lambda x: x["part"])
                    counts = np.concatenate([unpacked(x["a"]).astype(np.int64) for x in reply])
                    v = np.concatenate([unpacked(x["b"], True) for x in reply])
                    few = np.concatenate([unpacked(x["c"]).astype(np.int64).reshape(-1, K) for x in reply])
                    p = np.concatenate([unpacked(x["d"]) for x in reply])
                    keep = ~np.isin(v, np.array(list(hot), np.int64))
                    mine = np.intersect1d(np.array(list(hot), np.int64), own.v)
                    v, few, p = (np.concatenate(x) for x in ((v[keep], mine), (few[keep], np.array([hot[x][0] for x in mine.tolist()], np.int64).reshape(-1, K)), (p[keep], np.array([hot[x][1] for x in mine.tolist()], float))))
                    order = np.argsort(v)
                    v, few, p = v[order], few[order], p[order]
                    # the contexts at hand; all others have counts up to K and only known pairs here
                    where = np.minimum(np.searchsorted(v, own.v), max(0, len(v) - 1))
                    there = v[where] == own.v if len(v) else np.zeros(len(own.v), bool)
                    weight, divisor = np.ones(len(own.v)), own.context_total.astype(float)
                    if there.any():
                        weight[there], divisor[there] = backoff(few[where[there]], p[where[there]], own.context_total[there], share)
                    kept = np.where(counts <= K, share[np.minimum(counts, K)], 1.0)
                    direct = np.log10(np.maximum(kept * counts, 1e-300) / divisor)
                    at, pair = own.with_context, own.pair
                    score[at] = np.where(counts[pair] > 0, direct[pair], np.log10(weight)[pair] + log_p[at])
                m = len(own.sizes)
                has, ids = unpacked(r["has_id"]).astype(bool), unpacked(r["ids"])
                columns = [pa.array(ids, pa.int64(), mask=~has), pa.array(own.held), pa.array(own.sizes - 1), pa.array(np.bincount(own.doc, own.said & (own.total > 0), m).astype(np.int64)), pa.array(np.bincount(own.doc, log_p, m)), pa.array(np.bincount(own.doc, score, m))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _gathered(replies: DataFrame, name: str, *columns: str) -> DataFrame:
    return replies.where("kind = 'reply'").groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("part", *columns)).alias(name))


def _parted(asks: DataFrame) -> DataFrame:
    return asks.repartition("part").sortWithinPartitions("part")


def score_language(docs: DataFrame, folds: int = FOLDS, block_words: int = BLOCK_WORDS, part_keys: int = PART_KEYS, hot_context: int = HOT_CONTEXT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    of each row of ``docs`` (doc_id, text), by a model of the rows that aren't
    held out.

    Words are runs of other than space and 0x09-0x0D after lower-casing A-Z; a
    text's tokens are its words and one end. n_known: tokens that training
    texts have; train_tokens: tokens of all of these. base_score: sum of the
    log10 probabilities of the tokens alone, ADDED to each count and to that
    of one unknown word. score: sum of the log10 probabilities of the tokens
    after each other; after each context those of all known words and one
    unknown word sum to 1. After an unknown word a token counts alone.

    Null and empty texts are an end alone. Rows without doc_id are learnt from.
    Repeated rows are scored, and learnt from, as often as they occur. Without
    training rows every token has probability 1. An empty table gives an empty
    one; other columns are ignored. Words are told apart by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = materialise(own.mapInArrow(released(_encode(block_words)), BLOCK), "blocks")
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_words", "n_keys")]).first()
    word_parts, pair_parts = (max(1, -(-sums[c] // part_keys)) for c in ("n_keys", "n_words"))

    asks = _parted(blocks.select("block", "words", "own").mapInArrow(released(_ask_words(word_parts)), ASK_WORDS))
    words = materialise(asks.mapInArrow(released(_answer_words(word_parts)), WORDS), "words")
    all_words = words.where("kind = 'word'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, vocabulary = all_words["n"] - sums["n_train"], all_words["v"] - (1 if sums["n_train"] else 0)  # without START
    numbered = blocks.select("block", "ids", "has_id", "held", "sizes", "counts", "at").join(_gathered(words, "words_reply", "b", "c"), F.col("block") == F.col("of")).drop("of")

    asks = _parted(numbered.drop("ids", "has_id").mapInArrow(released(_ask_pairs(pair_parts, hot_context)), ASK_PAIRS))
    pairs = materialise(asks.mapInArrow(released(_answer_pairs(n, vocabulary)), PAIRS), "pairs")
    share = discounts(_times(pairs))
    answered = numbered.join(_gathered(pairs, "pairs_reply", "a", "b", "c", "d"), F.col("block") == F.col("of"), "left").drop("of")
    scores = answered.mapInArrow(released(_evaluate(pair_parts, hot_context, n, vocabulary, share, _hot_contexts(words, pairs, hot_context))), SCORES)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _times(pairs: DataFrame) -> list[int]:
    """How many pairs have each of the counts 1 to K + 1; summed in tasks, a
    row of each partition of the table."""

    def run(frames):
        for frame in frames:
            total = sum((unpacked(x) for x in frame["a"].to_pylist()), np.zeros(K + 1, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(K + 1)), pa.array(total)], names=["i", "n"])

    rows = pairs.where("kind = 'times'").select("a").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    found = {r["i"]: r["n"] for r in rows}
    return [found.get(i, 0) for i in range(K + 1)]
