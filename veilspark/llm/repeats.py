"""Removal of byte strings that repeat across documents, by suffix arrays.

0. Texts that repeat as a whole lose every byte but in the smallest document
   and take no further part, so groups of copies never meet anywhere.
1. In each window of ``length`` bytes the k-gram with the least hash is its
   anchor. Windows with the same bytes have the same anchor, so all copies of
   a window are found among the windows of one anchor.
2. Anchors are counted in the buckets of their hash. A bit filter of fixed
   size keeps those that occur in two documents (where most of its bits would
   be set it keeps nothing out and isn't sent). Anchors of very many documents
   are listed: their windows are dealt out one by one, by their own hash, so
   that no shard holds a frequent passage's surroundings in all documents.
3. The stretches around the kept anchors go to the bucket of the anchor, the
   windows of listed anchors to that of their hash. A bucket's stretches are
   one shard: its suffix array is built by induced sorting, and runs of
   permuted common prefixes of ``length`` bytes give the smallest document of
   each window.
4. Windows that also start in a smaller document cover the bytes to remove.

Stretches and windows that are alike within a batch are sent once, with the
smallest document; in the others every window is known to repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise, released
from .suffix_array import PrefixHashes, common_prefixes, suffix_array

LENGTH = 50
GRAM = 20
FILTER_BITS = 1 << 27
#: 128 MiB in each worker; bits for each repeated anchor, up to that.
MOST_FILTER_BITS, BITS_EACH = 1 << 30, 8
BUCKET_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
HOT_ROWS = 2048
HOT_ANCHORS = 1_000_000
BROADCAST_ROWS = 100_000
#: Tasks that the buckets are dealt to at most; a task has one bucket at a time.
MOST_TASKS = 1 << 15
LAST = np.iinfo(np.int64).max

_U = np.uint64
_CHUNK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the 20 bytes at each position of ``buf``."""
    n = len(buf) - GRAM + 1
    word = np.lib.stride_tricks.as_strided(buf[: len(buf) - 7].view(), (len(buf) - 7, 8), (1, 1)).view(_U)[:, 0] if len(buf) >= 8 else np.zeros(0, _U)
    x = word[:n] * _U(0x9E3779B97F4A7C15)
    x ^= _mix(word[8 : 8 + n] * _U(0xD1B54A32D192ED03))
    x += word[12 : 12 + n] * _U(0x8CB92BA72F3D8DD7)
    return _mix(_mix(x) * _U(0x94D049BB133111EB))


def _chunk_runs(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int):
    """Runs of windows with one anchor: first, last, hash of the anchor."""
    g = _grams(buf)
    span = length - GRAM + 1
    key = (g & ~_U(0xFFFFF)) | np.arange(len(g), dtype=_U)
    m, size = key, 1
    while size * 2 <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if span > size:
        m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
    least = (m & _U(0xFFFFF)).astype(np.int64)
    ok = np.zeros(len(least), bool)
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        if hi - lo >= length:
            ok[lo : hi - length + 1] = True
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
    lo = np.flatnonzero(new & ok)
    stop = np.append(np.flatnonzero(new | ~ok), len(least))
    hi = stop[np.searchsorted(stop, lo, side="right")] - 1
    # least hashes are small ones; mixed again they are even over all buckets
    return lo, hi, _mix(g[least[lo]] * _U(0xC2B2AE3D27D4EB4F))


def runs(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, last window, hash of the anchor) of each run.

    Texts are joined to buffers of about 64 KiB; longer texts are cut into
    parts that overlap by a window less one byte.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        buf = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in parts])
        starts = np.concatenate(([0], ends[:-1]))
        lo, hi, h = _chunk_runs(buf, ends, starts, length)
        k = np.searchsorted(ends, lo, side="right")
        shift = np.array([o for _, o, _ in parts]) - starts
        return np.array([i for i, _, _ in parts])[k], lo + shift[k], hi + shift[k], h

    for i, text in enumerate(texts):
        for lo in range(0, max(0, len(text) - length + 1), _CHUNK):
            part = text[lo : lo + _CHUNK + length - 1]
            if parts and size + len(part) > 2 * _CHUNK:
                yield flush()
                parts, size = [], 0
            parts.append((i, lo, part))
            size += len(part)
    if parts:
        yield flush()


def _bytes(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _all_runs(texts: list[bytes], length: int) -> list[np.ndarray] | None:
    found = list(runs(texts, length))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def _count_anchors(length: int, buckets: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            got = _all_runs(_bytes(frame["text"]), length)
            if got is None:
                continue
            doc, _, _, h = got
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
            h, n = np.unique(h[once], return_counts=True)
            b = (h >> _U(37)).astype(np.int64) * buckets >> 27
            cut = np.searchsorted(b, np.arange(buckets + 1))
            keep = np.flatnonzero(np.diff(cut))
            raw = ((h & ~_U(0xFFFF)) | np.minimum(n, 0xFFFF).astype(np.uint64)).astype("<u8")
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(keep, pa.int32()), "anchors": [raw[cut[i] : cut[i + 1]].tobytes() for i in keep]})

    return run


def _repeated_bits(hot_rows: int):
    """The filter bits of each bucket's repeated anchors, and its hot ones.

    An anchor is its hash's upper 48 bits; the lower 16 count a batch's rows.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _by_bucket(frames, ["anchors"]):
            h = np.sort(np.frombuffer(b"".join(rows["anchors"]), "<u8"))
            first = np.concatenate(([0], np.flatnonzero((h[1:] ^ h[:-1]) >> _U(16)) + 1))
            n = np.add.reduceat((h & _U(0xFFFF)).astype(np.int64), first)
            anchors = h[first] >> _U(16)
            bits = np.unique((anchors[n > 1] >> _U(16)).astype(np.int64))
            hot = anchors[n >= hot_rows]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "bits": [bits.astype("<u4").tobytes()], "hot": [hot.astype("<u8").tobytes()], "n": [int(n.sum())]})

    return run


def _by_bucket(frames: Iterator[pa.RecordBatch], names: list[str]):
    """The rows of each bucket, from frames sorted by bucket."""
    at, rows = None, {k: [] for k in names}
    for frame in frames:
        columns = {k: frame[k].to_pylist() for k in names}
        for i, b in enumerate(frame["bucket"].to_pylist()):
            if b != at:
                if at is not None:
                    yield at, rows
                at, rows = b, {k: [] for k in names}
            for k in names:
                rows[k].append(columns[k][i])
    if at is not None:
        yield at, rows


_STRETCH = np.dtype([("anchor", "<u8"), ("row", "<i4"), ("at", "<i8"), ("n", "<i4"), ("kind", "<i4")])
_BYTES, _KNOWN = 0, 1


def _windows(texts: list[bytes], doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, hash) of each window of the given runs."""
    buf = np.frombuffer(b"".join(texts[d][a : z + length] for d, a, z in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True)), np.uint8)
    n = hi - lo + 1
    run = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(n + length - 1) - (n + length - 1))[run] + offset
    g = _grams(buf)
    h = g[at]
    for k in range(GRAM, length, GRAM):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + g[at + min(k, length - GRAM)])
    return run, lo[run] + offset, h


def _stretches(length: int, buckets: int, bits, hot):
    """The stretches of kept anchors, packed for each bucket.

    One row per batch and bucket: the documents, the table of stretches and
    their bytes end to end. Kinds: a stretch (or a window of a hot anchor)
    with its bytes, and a part that is known to repeat.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(bits.value, np.uint8)
        hots = np.frombuffer(hot.value, "<u8")
        for frame in frames:
            texts = _bytes(frame["text"])
            ids = np.array([LAST if x is None else x for x in frame["doc_id"].to_pylist()], np.int64)
            hashes = frame["th"].to_numpy(zero_copy_only=False)
            got = _all_runs(texts, length)
            if got is None:
                continue
            doc, lo, hi, h = got
            b = (h >> _U(65 - (len(flags) * 8).bit_length())).astype(np.int64)
            kept = (flags[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
            doc, lo, hi, h = doc[kept], lo[kept], hi[kept], h[kept]
            is_hot = np.isin(h >> _U(16), hots)
            table, raw = [np.zeros(0, _STRETCH)], []
            if is_hot.any():
                which, at, key = _windows(texts, doc[is_hot], lo[is_hot], hi[is_hot], length)
                row = doc[is_hot][which]
                order = np.lexsort((at, ids[row], key))
                # alike: the hash and then the bytes
                windows = [texts[d][a : a + length] for d, a in zip(row[order].tolist(), at[order].tolist(), strict=True)]
                lows: dict[bytes, int] = {}
                known = np.empty(len(order), bool)
                sent = np.zeros(len(order), bool)
                for j, w, i in zip(order.tolist(), windows, ids[row[order]].tolist(), strict=True):
                    known[j] = (low := lows.setdefault(w, i)) < i
                    sent[j] = low == i
                table.append(_rows(key[sent], row[sent], at[sent], length, _BYTES))
                raw += [texts[d][a : a + length] for d, a in zip(row[sent].tolist(), at[sent].tolist(), strict=True)]
                row, at = row[known], at[known]
                order = np.lexsort((at, row))
                row, at = row[order], at[order]
                start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))) if len(row) else np.zeros(0, np.int64)
                stop = np.append(start[1:], len(row)) - 1
                table.append(_rows(_mix(row[start].astype(np.uint64)), row[start], at[start], at[stop] - at[start] + length if len(start) else 0, _KNOWN))
                raw += [b""] * len(start)
            doc, lo, hi, h = doc[~is_hot], lo[~is_hot], hi[~is_hot], h[~is_hot]
            order = np.lexsort((lo, hashes[doc], ids[doc], h))
            seen: dict[bytes, int] = {}
            anchor, kinds = None, []
            for j, d, a, z in zip(h[order].tolist(), doc[order].tolist(), lo[order].tolist(), hi[order].tolist(), strict=True):
                if j != anchor:
                    anchor, seen = j, {}
                text = texts[d][a : z + length]
                more = seen.setdefault(text, int(ids[d])) < ids[d]
                kinds.append(_KNOWN if more else _BYTES)
                raw.append(b"" if more else text)
            table.append(_rows(h[order], doc[order], lo[order], hi[order] - lo[order] + length, np.array(kinds, np.int64)))
            t = np.concatenate(table)
            b = (t["anchor"] >> _U(37)).astype(np.int64) * buckets >> 27
            order = np.argsort(b, kind="stable")
            t = t[order]
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            keep = np.flatnonzero(np.diff(cut))
            out = {"bucket": pa.array(keep, pa.int32()), "ids": [], "hashes": [], "table": [], "bytes": []}
            for i in keep:
                part = t[cut[i] : cut[i + 1]].copy()
                rows, part["row"] = np.unique(part["row"], return_inverse=True)
                out["ids"].append(ids[rows].tobytes())
                out["hashes"].append(hashes[rows].astype(np.int64).tobytes())
                out["table"].append(part.tobytes())
                out["bytes"].append(b"".join([raw[k] for k in order[cut[i] : cut[i + 1]].tolist()]))
            if len(keep):
                yield pa.RecordBatch.from_pydict(out)

    return run


def _rows(anchor, row, at, n, kind) -> np.ndarray:
    out = np.zeros(len(anchor), _STRETCH)
    out["anchor"], out["row"], out["at"], out["n"], out["kind"] = anchor, row, at, n, kind
    return out


def _shard(anchor: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one shard that also start in a smaller document:
    (stretch, first window, number of windows).

    Stretches of one anchor with the same bytes (a hash, and then the bytes)
    are one in the suffix array, with their smallest document.
    """
    base = start - (np.cumsum(n) - n)
    text = raw[np.arange(n.sum()) + np.repeat(base, n)]
    ends = np.cumsum(n)
    h = PrefixHashes(text).of(ends - n, ends) + anchor * _U(0x9E3779B97F4A7C15) + n.astype(_U)
    _, one, of = np.unique(h, return_index=True, return_inverse=True)
    other = n != n[one][of]
    if not other.any():
        other = np.add.reduceat(text != text[np.arange(n.sum()) + np.repeat((ends - n)[one][of] - (ends - n), n)], ends - n) > 0
    if other.any():  # one hash of different bytes: all are kept apart
        one = of = np.arange(len(n))
    lows = np.full(len(one), LAST, np.int64)
    np.minimum.at(lows, of, ids)
    m = n[one]
    begin = np.cumsum(m) - m
    inner = np.arange(m.sum()) - np.repeat(begin, m)
    where = inner + np.repeat(begin + np.arange(len(m)), m)
    t = np.zeros(m.sum() + len(m) + 1, np.uint16)
    t[where] = text[inner + np.repeat((ends - n)[one], m)].astype(np.uint16) + 2
    t[np.cumsum(m + 1) - 1] = 1
    sa = suffix_array(t)
    shared = common_prefixes(t, sa)[sa] >= length
    stretch = np.append(np.repeat(np.arange(len(m)), m + 1), len(m) - 1)
    inside = np.zeros(len(t), bool)
    inside[where] = inner <= np.repeat(m, m) - length
    group = np.cumsum(~shared)
    order = np.flatnonzero(inside[sa])
    first = np.concatenate(([0], np.flatnonzero(np.diff(group[order])) + 1))
    lowest = np.full(group[-1] + 1, LAST, np.int64)
    lowest[group[order[first]]] = np.minimum.reduceat(lows[stretch[sa[order]]], first)
    low = np.empty(len(t), np.int64)
    low[sa] = lowest[group]
    low = low[inside]  # of the windows of distinct stretches, in order
    w = n - length + 1
    at = (np.cumsum(m - length + 1) - (m - length + 1))[of]
    which = np.repeat(np.arange(len(n)), w)
    offset = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    hit = low[at[which] + offset] < ids[which]
    which, offset = which[hit], offset[hit]
    if not len(which):
        return which, offset, offset
    a = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1))))
    return which[a], offset[a], np.diff(np.append(a, len(which)))


def _repeats(length: int, shard_bytes: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(frames, ["ids", "hashes", "table", "bytes"]):
            tables = [np.frombuffer(x, _STRETCH) for x in rows["table"]]
            base = np.concatenate(([0], np.cumsum([len(x) // 8 for x in rows["ids"]])))
            ids, hashes = (np.frombuffer(b"".join(rows[k]), np.int64) for k in ("ids", "hashes"))
            t = np.concatenate(tables).copy()
            t["row"] += np.repeat(base[:-1], [len(x) for x in tables]).astype(np.int32)
            raw = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
            n = np.where(t["kind"] == _BYTES, t["n"], 0).astype(np.int64)
            start = np.cumsum(n) - n
            known = t[t["kind"] == _KNOWN]
            spans = [(known["row"], known["at"], known["at"] + known["n"])]
            own = np.flatnonzero(t["kind"] == _BYTES)
            own = own[np.argsort(t["anchor"][own], kind="stable")]
            size = np.cumsum(n[own])
            cut, last = [0], 0
            for e in (np.flatnonzero(np.diff(t["anchor"][own])) + 1).tolist():
                if size[e - 1] - last >= shard_bytes:
                    cut.append(e)
                    last = size[e - 1]
            cut.append(len(own))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                k = own[lo:hi]
                if len(k):
                    which, offset, many = _shard(t["anchor"][k], start[k], n[k], ids[t["row"][k]], raw, length)
                    at = t["at"][k][which] + offset
                    spans.append((t["row"][k][which], at, at + many + length - 1))
            row, lo, hi = (np.concatenate(x) for x in zip(*spans, strict=True))
            yield pa.RecordBatch.from_pydict({"doc_id": ids[row], "th": hashes[row], "lo": lo.astype(np.int64), "hi": hi.astype(np.int64)})

    return run


def _keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of what is left of each text without its spans."""
    for frame in frames:
        out = {"doc_id": frame["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        for text, los, his in zip(_bytes(frame["text"]), frame["los"].to_pylist(), frame["his"].to_pylist(), strict=True):
            merged: list[list[int]] = []
            for lo, hi in sorted(zip(los or (), his or (), strict=True)):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            digest, at = hashlib.sha256(), 0
            for lo, hi in merged:
                digest.update(text[at:lo])
                at = hi
            digest.update(text[at:])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(sum(hi - lo for lo, hi in merged))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(digest.hexdigest())
            out["spans"].append([{"lo": lo, "hi": hi} for lo, hi in merged])
        yield pa.RecordBatch.from_pydict(out, schema=_KEPT)


_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
)
_KEPT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, order, th, th2, n): order is doc_id or, for null, LAST."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.withColumns({"order": F.coalesce("doc_id", F.lit(int(LAST))), "th": F.xxhash64("text"), "th2": F.xxhash64(F.lit(1), F.col("text")), "n": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})


def _without_copies(keyed: DataFrame, rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows that aren't copies of a smaller document's text, and the copies
    (from ``rows``, without texts)."""
    key = ["th", "th2", "n"]
    low = rows.where(F.col("n") >= length).groupBy(*key).agg(F.min("order").alias("low"), F.max("order").alias("high")).where("low < high").drop("high")
    low = materialise(low, "copies")
    small = low.count() <= BROADCAST_ROWS
    marked = keyed.join(F.broadcast(low) if small else low, key, "left")
    if not small:
        marked = materialise(marked, "marked")
    copies = rows.join(F.broadcast(low) if small else low, key).where("order > low")
    return marked.where("low is null or order = low").drop("low"), copies.select("doc_id", "n")


def filter_bits(anchors: int) -> int:
    """Bits of the filter for so many repeated anchors: a power of two."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << max(0, int(anchors) * BITS_EACH - 1).bit_length()))


def repeated_spans(keyed: DataFrame, total: int, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(order, th, lo, hi): parts of windows of ``length`` bytes that also
    start in a document with a smaller order; parts may overlap.

    keyed: (order, text, th) with about ``total`` bytes of text. An anchor of
    ``hot_rows`` documents or more is hot; the number is raised until at most
    HOT_ANCHORS can be.
    """
    spark = keyed.sparkSession
    buckets = int(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)), FILTER_BITS))
    counted = keyed.select("text").mapInArrow(released(_count_anchors(length, buckets)), "bucket int, anchors binary")
    found = counted.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(released(_repeated_bits(hot_rows)), "bucket int, bits binary, hot binary, n long")
    found = materialise(found, "anchors")
    n_set, n_all = (x or 0 for x in found.agg(F.sum(F.length("bits") / 4), F.sum("n")).first())
    if n_all > hot_rows * HOT_ANCHORS:
        return repeated_spans(keyed, total, length, -(-n_all // HOT_ANCHORS))
    size = filter_bits(n_set)
    flags = np.zeros(size >> 3, np.uint8)
    for row in found.select("bits").toLocalIterator():
        at = (np.frombuffer(row["bits"], "<u4") >> np.uint32(33 - size.bit_length())).astype(np.int64)
        np.bitwise_or.at(flags, at >> 3, (1 << (at & 7)).astype(np.uint8))
    bits = spark.sparkContext.broadcast(flags.tobytes())
    hot = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(r["hot"] for r in found.select("hot").where(F.length("hot") > 0).toLocalIterator()), "<u8")).tobytes())
    packed = keyed.select(F.col("order").alias("doc_id"), "text", "th").mapInArrow(released(_stretches(length, buckets, bits, hot)), "bucket int, ids binary, hashes binary, table binary, bytes binary")
    spans = packed.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(released(_repeats(length, SHARD_BYTES)), "doc_id long, th long, lo long, hi long")
    return spans.withColumnRenamed("doc_id", "order")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what is left of its bytes.

    Removes each byte covered by a string of ``length`` bytes that also starts
    in a document with a smaller doc_id; matches never cross documents, and
    strings are judged on the input. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 and spans (their lo and hi).

    Null and empty texts and texts shorter than ``length`` lose nothing.
    Repeated doc_ids don't remove each other's bytes; a null doc_id counts as
    larger than all others. An empty table gives an empty one; other columns
    of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    rows = materialise(keyed.drop("text"), "texts")
    own, copies = _without_copies(keyed, rows, length)
    spans = materialise(repeated_spans(own, rows.agg(F.sum("n")).first()[0] or 0, length), "spans")
    grouped = spans.groupBy("order", "th").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    cut = own.join(grouped, ["order", "th"], "left").select("doc_id", "text", "los", "his").mapInArrow(released(_keep), _KEPT_SQL)
    zero = F.lit(0).cast("long")
    gone = copies.select("doc_id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.array(F.struct(zero.alias("lo"), F.col("n").alias("hi"))).alias("spans"))
    return cut.union(gone)
