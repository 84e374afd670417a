"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The tokens of a byte-level vocabulary
are the text's bytes end to end, so running sums of token lengths are their
spans; an interval join by binary search gives each token the section in which
it lies, and a rule decides about tokens that cross a boundary.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, released

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the vocabulary's texts were split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
PIECE = 1 << 16


#: The pattern's engine recurses on white space; longer runs are split off first.
LONG_RUN = 4096
#: The characters that the pattern's \\s stands for.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACES}]{{{LONG_RUN},}}")


@lru_cache(maxsize=2)
def built(vocabulary: bytes):
    """The encoding of a vocabulary file's content and the length in bytes of
    each of its tokens; once in each worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        sizes[k] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encoder(vocabulary: str):
    """built() of the file at a path."""
    with open(vocabulary, "rb") as file:
        return built(file.read())


def encode(encoding, text: str) -> list[int]:
    """The tokens of ``text``, whatever the length of its white space.

    The pattern takes a run of white space as one piece, but for its last
    character where other text follows. Long runs are given to the encoder as
    such pieces; what stands before and after them is encoded by itself, with
    that last character, so the tokens are those of the whole text.
    """
    out, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section of one text.

    sizes: lengths of the tokens in order; ends: where each section ends, in
    order, the last one at the text's end. rule: a token that crosses
    boundaries goes to the section of its first byte, of its last byte, or to
    the one with most of its bytes (the first of several such).
    """
    if not len(ends):
        return np.zeros(0, np.int64)
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.searchsorted(ends, start, side="right")
    last = np.searchsorted(ends, stop - 1, side="right")
    at = last if rule == "last" else first
    if rule == "most":
        at = first.copy()
        for i in np.flatnonzero(first != last).tolist():
            bounds = np.clip(np.concatenate(([0], ends))[first[i] : last[i] + 2], start[i], stop[i])
            at[i] = first[i] + int(np.argmax(np.diff(bounds)))
    return np.bincount(at, minlength=len(ends))


def _attributed(columns: list[str], by_line: bool, vocabulary, rule: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size_of = built(vocabulary.value)
        for frame in frames:
            fields = [frame[c].to_pylist() for c in columns]
            ids, out = frame["doc_id"].to_pylist(), {k: [] for k in ("doc_id", "field", "section", "start", "end", "n_tokens")}
            for i, doc_id in enumerate(ids):
                names, chars, parts = [], [], []
                for c, values in zip(columns, fields, strict=True):
                    text = values[i] or ""
                    pieces = text.split("\n") if by_line else [text]
                    pieces = [p + "\n" if k + 1 < len(pieces) else p for k, p in enumerate(pieces)]
                    names += [(c, k) for k in range(len(pieces))]
                    chars += [len(p) for p in pieces]
                    parts += pieces
                ends = np.cumsum([len(p.encode()) for p in parts])
                tokens = np.array(encode(encoding, "".join(parts)), np.int64)
                counts = attribute(size_of[tokens], ends, rule)
                at = 0
                for (c, k), n, m in zip(names, chars, counts.tolist(), strict=True):
                    at = 0 if not k else at
                    for key, x in zip(out, (doc_id, c, k, at, at + n, m), strict=True):
                        out[key].append(x)
                    at += n
                if len(out["doc_id"]) >= PIECE:
                    yield pa.RecordBatch.from_pydict(out, schema=_OUT)
                    out = {k: [] for k in out}
            yield pa.RecordBatch.from_pydict(out, schema=_OUT)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), by_line: bool = True, vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """Tokens of each section of each row of ``docs``: doc_id, field, section
    (from 0), start and end (code points in the field), n_tokens.

    A document is its ``fields`` end to end, encoded at once; sections are the
    fields or, by_line, their lines with their line feeds. Every byte lies in
    one section, so a document's counts add up to its tokens. ``rule``: see
    attribute().

    A null field is empty; an empty field is one section without tokens. A
    null doc_id stays null; repeated rows give their sections again. An empty
    table gives an empty one; other columns are ignored.

    ``vocabulary``: path of the file on the driver, whose content (a few MB)
    goes to the workers.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    bounded_batches(docs.sparkSession)
    names = [f"__field{k}" for k in range(len(fields))]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)])
    counted = base.mapInArrow(released(_attributed(names, by_line, content, rule)), "doc_id long, field string, section int, start long, end long, n_tokens long")
    field = F.element_at(F.array(*[F.lit(c) for c in fields]), F.replace(F.col("field"), F.lit("__field"), F.lit("")).cast("int") + 1)
    return counted.withColumn("field", field)
