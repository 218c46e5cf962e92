"""Exact token counts by byte-pair merging with a heap and a linked list.

A text is split into pre-tokens; each starts as a linked list of bytes. A heap holds the adjacent pairs that the vocabulary
can merge; the pair of the lowest rank (the leftmost of equals) is popped again and again, merged, and its new
neighbours are pushed. A pre-token counts as many tokens as it had bytes, less its merges: identifiers
are never looked up or emitted.

Scale: one scan, no shuffle. The vocabulary (under a megabyte) is broadcast. Each worker remembers the counts of up to
``MEMO`` distinct pre-tokens of at most ``KEPT`` characters, ``HELD`` characters in all, and forgets all of them beyond that, so its memory is bounded; this
never changes a count. The pre-tokens of a text of over ``LONG`` characters are taken one by one.

Defined edge cases: a null text has null counts, an empty one 0; repeated rows are counted each; strings of special
tokens are ordinary text; long texts are counted whole; pairs of one rank are merged from the left; an empty table gives no rows; only
the text is read, extra columns are of no account.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO, KEPT, HELD, LONG = 500_000, 1000, 20_000_000, 1_000_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def count_merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols that are left of a pre-token when no pair can be merged any more."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    stop = list(range(1, n + 1))  # where the symbol that begins at i ends; 0 once it is merged away
    before = list(range(-1, n - 1))  # the symbol to its left
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = stop[i]
        if not mid or mid >= n or stop[mid] != end:  # one of the two was merged since
            continue
        stop[i], stop[mid] = end, 0
        left -= 1
        if end < n:
            before[end] = i
            far = stop[end]
            if (r := ranks.get(piece[i:far])) is not None:
                heapq.heappush(heap, (r, i, far))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return left


class Counter(dict):
    """Pre-token -> tokens, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO, held: int = HELD):
        super().__init__()
        pattern = regex.compile(PATTERN)
        self.ranks, self.memo, self.most, self.held, self.split, self.each = ranks, memo, held, 0, pattern.findall, pattern.finditer

    def __missing__(self, piece: str) -> int:
        n = count_merged(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= KEPT:
            if len(self) >= self.memo or self.held > self.most:
                self.clear()
                self.held = 0
            self[piece] = n
            self.held += len(piece)
        return n

    def tokens(self, text: str) -> int:
        pieces = self.split(text) if len(text) <= LONG else (m[0] for m in self.each(text))
        return sum(map(self.__getitem__, pieces))


_counters: dict[int, Counter] = {}


def _udf(vocabulary: Broadcast) -> object:
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        content = vocabulary.value
        key = hash(content)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(read_ranks(content))
        tokens = _counters[key].tokens
        for texts in it:
            yield pa.array([None if t is None else tokens(t) for t in texts.to_pylist()], type=pa.int64())

    return F.arrow_udf(run, "bigint").asNondeterministic()


def token_count(spark: SparkSession, text_col: str = "text", vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text column under a rank file on the driver."""
    with open(vocabulary, "rb") as f:
        return _udf(spark.sparkContext.broadcast(f.read()))(F.col(text_col))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.octet_length("text").alias("n_bytes"), token_count(spark).alias("n_tokens"))
