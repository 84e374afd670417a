"""Vectorised word and shingle hashing over batches of texts.

Words are runs of bytes other than space and 0x09-0x0D after lower-casing
A-Z. A shingle is five consecutive words; a text of one to four words is one
shingle as a whole. All hashes are 64 bits and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
CHUNK = 1 << 19

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_A = _U(0xD1B54A32D192ED03)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, CHUNK + 4096)
        for k, base in (("p", _P), ("i", _P_INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of one buffer."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([True], _WS[buf], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    p, inv = _pow(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[:n], out=c[1:])
    h = (c[ends] - c[starts]) * inv[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of each word of already lower-cased texts.

    Works in buffers of about CHUNK bytes. Longer texts are cut at white
    space, so no buffer grows with a text; only a single word longer than
    CHUNK makes a longer buffer.
    """
    docs, hashes = [], []
    at: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if parts:
            buf = np.frombuffer(b" ".join(parts), np.uint8)
            ends = np.cumsum([len(x) + 1 for x in parts])
            starts, h = _word_hashes(buf)
            docs.append(np.asarray(at)[np.searchsorted(ends, starts, side="right")])
            hashes.append(h)
        at.clear()
        parts.clear()
        size = 0

    for i, text in enumerate(texts):
        lo = 0
        while lo < len(text):
            hi = min(len(text), lo + CHUNK)
            while hi < len(text) and not _WS[text[hi]]:
                hi += 1
            if size + hi - lo > CHUNK:
                flush()
            at.append(i)
            parts.append(text[lo:hi])
            size += hi - lo
            lo = hi
    flush()
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and offsets.

    The set of text i is ``values[offsets[i]:offsets[i + 1]]``; it is empty for
    null texts and texts without words.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    doc, h = word_hashes(raw)
    n = np.bincount(doc, minlength=len(raw)) if len(doc) else np.zeros(len(raw), np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    full = np.zeros(0, np.uint64)
    if len(h) >= words:
        full = h[: len(h) - words + 1].copy()
        for k in range(1, words):
            full = full * _A + h[k : len(h) - words + 1 + k]
        full = mix(full, 1)
    out, sizes = [], np.zeros(len(raw) + 1, np.int64)
    for i in range(len(raw)):
        if n[i] >= words:
            s = np.unique(full[first[i] : first[i + 1] - words + 1])
        elif n[i]:
            x = _U(0)
            with np.errstate(over="ignore"):
                for w in h[first[i] : first[i + 1]]:
                    x = x * _A + w
            s = mix(np.array([x], np.uint64), 2 + int(n[i]))
        else:
            s = full[:0]
        out.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def batches(texts: list[str | None], limit: int = 2 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
