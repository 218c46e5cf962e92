"""Vectorised word kernel shared by the text operators.

Texts arrive as Arrow string arrays that the JVM has lower-cased already. A *word* is a maximal run of
``[a-z0-9]`` or non-ASCII characters; everything else separates. Words and shingles (``k`` consecutive
words) are represented by 64-bit hashes computed with NumPy over the raw UTF-8 buffer, a bounded slice of
documents at a time, so no Python object is made per word and memory does not depend on the batch size.

Defined edge cases: a null text counts as an empty one here (callers keep the null apart where it matters);
a text of fewer than ``k`` words but at least one has exactly one shingle, made of all of its words; a text
without words has none. SQL spelling of the words: ``[a-z0-9\\x{80}-\\x{10FFFF}]+`` over ``lower(text)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kinetrace.session import shared_dir, shared_root

__all__ = ["Words", "cut", "fresh", "mix64", "shared_dir", "shared_root", "shingles", "slices", "words"]

#: Bytes of text handled at once inside a worker; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_BYTE_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        for name, base in (("up", _BASE), ("down", _INV)):
            seq = np.full(size, base, dtype=np.uint64)
            seq[0] = 1
            _powers[name] = np.cumprod(seq, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """The words of consecutive documents: byte spans, hashes and, per document, where its words begin."""

    first_row: int
    n_docs: int
    begin: np.ndarray  # byte of each word's start, relative to the slice
    end: np.ndarray
    code: np.ndarray  # uint64 per word
    doc_at: np.ndarray  # n_docs + 1 positions in the word arrays
    byte_at: np.ndarray  # n_docs + 1 byte offsets
    data: np.ndarray  # the slice's bytes

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets from the slice's start) for bounded runs of rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield row, stop - row, raw[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounded runs of bytes that end where no word goes on; a word longer than a run makes the run longer."""
    low = 0
    while low < len(data):
        high = low + SLICE_BYTES + (1 << 16)
        while high < len(data):
            gap = np.flatnonzero(~IS_WORD[data[high : high + (1 << 16)]])
            if len(gap):
                high += int(gap[0])
                break
            high += 1 << 16
        yield low, min(high, len(data))
        low = high


def words(texts: pa.Array) -> Iterator[Words]:
    for row, n, data, offs in slices(texts):
        parts = [_spell(data[low:high], offs - low) for low, high in _segments(data)] or [_spell(data, offs)]
        at = [low for low, _ in _segments(data)] or [0]
        begin, end = (np.concatenate([p[i] + low for p, low in zip(parts, at, strict=True)]) for i in (0, 1))
        yield Words(row, n, begin, end, np.concatenate([p[2] for p in parts]), np.searchsorted(begin, offs), offs, data)


def _spell(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each word of a run of bytes; no word crosses one of the offsets."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = IS_WORD[data]
    head = inside[1:-1] & ~inside[:-2]
    tail = inside[1:-1] & ~inside[2:]
    edge = offs[(offs > 0) & (offs < len(data))]  # texts touch in the buffer: a word never crosses an edge
    head[edge] = inside[1:-1][edge]
    tail[edge - 1] = inside[1:-1][edge - 1]
    begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return begin, end, mix64((total[end] - total[begin]) * down[begin])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in text order, n_docs + 1 positions of the documents in it)."""
    n = len(w.code)
    size = w.counts()
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    if n == 0:
        return np.zeros(0, dtype=np.uint64), at
    left = np.repeat(w.doc_at[1:], size) - np.arange(n)  # words from here to the document's end
    total = np.zeros(n, dtype=np.uint64)
    step = np.uint64(1)
    for j in range(k):
        part = w.code[j:] * step
        if j:
            part = np.where(left[: n - j] > j, part, np.uint64(0))
        total[: n - j] += part
        step = np.uint64((int(step) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
        if n - j <= 1:
            break
    keep = left >= k
    short = np.flatnonzero((size > 0) & (size < k))
    keep[w.doc_at[short]] = True
    return mix64(total[keep]), at


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that outlive any executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
