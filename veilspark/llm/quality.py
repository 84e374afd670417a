"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken over whole texts. Trees are grown on the driver from a
bounded sample of labelled rows, on quantile bins of each statistic, and
flattened into arrays which numpy walks for all rows of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_batches, released

#: Labelled rows that are learnt from at most: those with the least hash of
#: their doc_id, so the choice is the same in every run.
SAMPLE_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, LEAF_ROWS, L2 = 64, 80, 4, 0.1, 10, 1.0

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "upper", "digits", "spaces", "high", "marks", "exclaims", "signs", "bars", "stops",
    "entropy", "distinct_words", "top_word", "capital_words", "shouted_words", "marked_words", "line_bytes", "distinct_lines", "long_words", "short_words", "doubled_words",
)

_CLASS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "spaces": (9, 10, 11, 12, 13, 32), "high": range(128, 256),
    "marks": [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], "exclaims": (33,), "signs": (35, 36, 37, 38, 42), "bars": (124,), "stops": (46, 63),
}
_TABLE = np.zeros((256, len(_CLASS)))
for _k, _v in enumerate(_CLASS.values()):
    _TABLE[list(_v), _k] = 1
_NAMES = list(_CLASS)


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text; all 0 for null and empty ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = dict(zip(_NAMES, (counts @ _TABLE / n).tolist(), strict=True))
    p = counts[counts > 0] / n
    words, lines = raw.split(), raw.split(b"\n")
    seen = Counter(words)
    m = max(1, len(words))
    upper = sum(c for w, c in seen.items() if w[:1].isupper())
    shout = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    marked = sum(c for w, c in seen.items() if w[-1:] in b"#$%&*!|~^=+@")
    long_ = sum(c for w, c in seen.items() if len(w) > 20)
    short = sum(c for w, c in seen.items() if len(w) < 3)
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    size = sum(len(w) * c for w, c in seen.items())
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), size / m, share["upper"], share["digits"], share["spaces"], share["high"], share["marks"], share["exclaims"], share["signs"], share["bars"], share["stops"],
        float(-(p * np.log2(p)).sum()), len(seen) / m, max(seen.values(), default=0) / m, upper / m, shout / m, marked / m, n / len(lines), len(set(lines)) / len(lines), long_ / m, short / m, doubled / m,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees end to end: inner nodes have a feature and send values up to
    ``threshold`` to ``left``, others to the node after it; leaves (feature
    -1) have a value."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.where(inner, self.feature[at], 0)
                to = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.left[at] + 1)
                at = np.where(inner, to, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, bins=BINS, trees=TREES, depth=DEPTH, rate=RATE, leaf_rows=LEAF_ROWS, l2=L2) -> Forest:
    """Boosts trees on logistic loss. One class or no rows: a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        width = x.shape[1]
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[1:-1])) for k in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(width) * bins
        last = np.array([len(e) for e in edges])
        f = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            roots.append(len(feature))
            todo = [(np.arange(len(y)), 0, len(feature))]
            for part in (feature, threshold, left, value):
                part.append(0)
            while todo:
                rows, level, node = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                best, gain = None, 1e-9
                if level < depth and len(rows) >= 2 * leaf_rows:
                    at = flat[rows].ravel()
                    gh, hh, nh = (np.bincount(at, np.repeat(w, width), width * bins).reshape(width, bins).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows))))
                    ok = (nh >= leaf_rows) & (len(rows) - nh >= leaf_rows) & (np.arange(bins) < last[:, None])
                    gains = np.where(ok, gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2), -np.inf)
                    k = int(gains.argmax())
                    if gains.flat[k] > gain:
                        best = divmod(k, bins)
                if best is None:
                    feature[node], threshold[node], left[node], value[node] = -1, 0.0, 0, rate * gs / (hs + l2)
                    f[rows] += value[node]
                    continue
                feature[node], threshold[node], left[node] = best[0], float(edges[best[0]][best[1]]), len(feature)
                goes = binned[rows, best[0]] <= best[1]
                todo += [(rows[goes], level + 1, len(feature)), (rows[~goes], level + 1, len(feature) + 1)]
                for part in (feature, threshold, left, value):
                    part.extend((0, 0))
    return Forest(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(value, float))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True for the fold whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _measure(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        x = [statistics(t) for t in frame["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": frame["doc_id"], "y": frame["y"], "x": pa.array(x, pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Forest:
    """Learns quality from labelled rows outside the held-out fold.

    docs: (doc_id, text); labels: (doc_id, quality). Labels that are null or
    without doc_id don't count; of several of one doc_id the mean, from 0.5
    on 1. At most ``sample_rows`` labels are used (SAMPLE_ROWS says which). Of
    several texts of one doc_id the one with the least statistics counts.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"), folds)).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", "y", "text")
    measured = met.mapInArrow(released(_measure), "doc_id long, y double, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    rows = sorted((r["doc_id"], r["y"], *r["x"]) for r in measured.collect())
    table = np.array(rows, float).reshape(-1, 2 + len(FEATURES))
    return grow(table[:, 2:], table[:, 1])


def _apply(forest: Forest):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            x = np.array([statistics(t) for t in frame["text"].to_pylist()], float).reshape(-1, len(FEATURES))
            columns = [*frame.columns, pa.array(forest.scores(x))]
            yield pa.RecordBatch.from_arrays(columns, names=[*frame.schema.names, "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` with held_out, score and predicted.

    score: 0 to 1, higher where quality 1 is likelier; predicted: 1 from
    ``threshold`` on. Only the text is looked at: equal texts have equal
    scores. Null and empty texts have the score of all-zero statistics. Rows
    without doc_id are scored and not held out. Without usable labels all
    scores are 0.5. Repeated rows are scored alike; an empty table gives an
    empty one; other columns are passed through, but for those of the three
    names, which are replaced.
    """
    forest = train(docs, labels, sample_rows)
    base = docs.drop("held_out", "score", "predicted")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])
    scored = base.mapInArrow(released(_apply(forest)), schema)
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
