"""Automata of dictionary values, one of each content in a worker."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

_built: dict[str, object] = {}
#: Automata that a worker holds at most.
KEPT = 2


def content_key(values: dict[str, str]) -> str:
    """A hash of (value, category) pairs in order of the values."""
    digest = hashlib.sha256()
    for v in sorted(values):
        digest.update(f"{len(v)}:{v}{values[v]}\x1f".encode())
    return digest.hexdigest()


def automaton(key: str, values: dict[str, str]):
    """The automaton of ``values``, built by the first task that asks for it."""
    import ahocorasick

    if key not in _built:
        own = ahocorasick.Automaton()
        for v, c in values.items():
            own.add_word(v, (v, c))
        own.make_automaton()
        while len(_built) >= KEPT:
            _built.pop(next(iter(_built)))
        _built[key] = own
    return _built[key]


def leftmost_longest(own, text: str) -> list[tuple[int, str, str]]:
    """(start, value, category) of the matches that don't overlap."""
    longest: dict[int, tuple[str, str]] = {}
    # all matches: iter_long misses some behind a longer one that fails
    for end, (v, c) in own.iter(text):
        start = end + 1 - len(v)
        if len(v) > len(longest.get(start, ("",))[0]):
            longest[start] = v, c
    at, out = 0, []
    for start in sorted(longest):
        if start >= at:
            v, c = longest[start]
            out.append((start, v, c))
            at = start + len(v)
    return out


#: Bytes of texts, about, whose parts a worker holds at once.
SLICE_BYTES = 1 << 20


def slices(frames: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The frames cut to rows with about SLICE_BYTES of ``column``, one row at
    least; what is made of a text is many times its size in Python."""
    for frame in frames:
        n, at = frame.num_rows, 0
        sizes = [0 if x is None else x for x in pc.binary_length(frame[column]).to_pylist()]
        while at < n:
            to, size = at, 0
            while to < n and (to == at or size + sizes[to] <= SLICE_BYTES):
                size += sizes[to]
                to += 1
            yield frame.slice(at, to - at)
            at = to


def parts(column: str, name: str, key: str, shared):
    """Adds ``name``: the text of ``column`` in parts (before, value, category)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("before", pa.string()), ("value", pa.string()), ("category", pa.string())]))
        for frame in slices(frames, column):
            own, out = automaton(key, shared.value), []
            for text in frame[column].to_pylist():
                at, row = 0, []
                for start, v, c in leftmost_longest(own, text or ""):
                    row.append({"before": text[at:start], "value": v, "category": c})
                    at = start + len(v)
                out.append([*row, {"before": (text or "")[at:], "value": None, "category": None}])
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(out, kind)], names=[*frame.schema.names, name])

    return run


def contained(column: str, name: str, key: str, shared):
    """Adds ``name``: the values that stand in ``column``, overlaps included,
    each once, in order."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in slices(frames, column):
            own = automaton(key, shared.value)
            out = [sorted({v for _, (v, _) in own.iter(text)}) if text else [] for text in frame[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(out, pa.list_(pa.string()))], names=[*frame.schema.names, name])

    return run


def held(column: str, name: str, key: str, shared):
    """Adds ``name``: (value, category) of the values that stand in ``column``,
    overlaps included, each once, in order."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("value", pa.string()), ("category", pa.string())]))
        for frame in slices(frames, column):
            own = automaton(key, shared.value)
            out = [[{"value": v, "category": c} for v, c in sorted({x for _, x in own.iter(text)})] if text else [] for text in frame[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(out, kind)], names=[*frame.schema.names, name])

    return run
