"""Sum-of-squares packing of documents into training sequences.

A bin is a sequence of ``CAPACITY`` units. N(g) counts the open bins with residual gap g. A piece of size s goes to the bin
(a gap g >= s, or a new one) that makes the sum of N(g)^2 over the gaps smallest; a full bin is closed and no longer
counted. Of equally good choices the smallest gap wins, a new bin last; of bins with one gap the one that was
opened last. Documents come in the order of doc_id. A document longer than a bin is cut: its full sequences are bins
of their own and the rest is packed. Units are by default words, numbers and punctuation runs, counted in the JVM; an exact token
count can be given as a column, and the capacity is then in tokens.

Scale: only (id, size) is shuffled, never a text. Rows are dealt evenly into groups of about ``GROUP_ROWS``,
as many as the input needs, each packed alone in O(CAPACITY) vectorised work a piece. The pieces in bins that a group leaves open are then packed anew by the same
rule, again in groups of that size, until one group holds them all or a pass closes under ``WORTH`` of their bins; so what
is lost at groups' edges is what one group loses (measured in the README). No state grows with the input.

Defined edge cases: null and empty texts have size 0 and appear with no bin; null ids are packed like others; repeated
rows are packed each, and spread over the groups; ties in id are ordered by size; ids come back as they were, of any type that sorts; an empty table gives
no rows; a long text is cut into as many full bins as it needs; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.textkernel import cut

CAPACITY, GROUP_ROWS, WORTH = 2048, 50_000, 0.01


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each piece (1 <= size <= capacity), in order of arrival."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # N(g) for 0 < g < capacity; N(0) stays 0: full bins are closed
    holding: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, opened = np.empty(len(sizes), dtype=np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # a bin of gap g becomes one of gap g - s: the sum changes by 2 * (N(g - s) - N(g) + 1), without the part of a gap 0
        rest = capacity - s
        own = count[s:capacity]
        change = 2 * (count[:rest] - own + 1) if rest else own[:0]
        if rest:
            change[0] = 1 - 2 * count[s]  # an exact fit
            change[own == 0] = np.iinfo(np.int64).max
            at = int(change.argmin())
            new = 2 * int(count[rest]) + 1
            if own[at] and change[at] <= new:
                b = holding[s + at].pop()
                count[s + at] -= 1
                if at:
                    holding[at].append(b)
                    count[at] += 1
                out[i] = b
                continue
            holding[rest].append(opened)
            count[rest] += 1
        out[i] = opened
        opened += 1
    return out


def token_size(text_col: str = "text") -> Column:
    """Words, digits and punctuation marks in a text, without leaving the JVM."""
    return F.regexp_count(F.col(text_col), F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+"))


def _packed(rows: DataFrame, id_type: str, capacity: int, level: int) -> DataFrame:
    """(doc_id, piece, start, size, bin, gap) of rows (doc_id, piece, start, size, part); gap: what stays open in the bin."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("doc_id", "start", "size")], null_placement="at_end"))
        total = t.column("size").to_numpy()
        n = np.maximum(1, -(-total // capacity))
        row = np.repeat(np.arange(len(total)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        piece, start = t.column("piece").to_numpy()[row] + nth, t.column("start").to_numpy()[row] + nth * capacity
        sizes = np.minimum(capacity, total[row] - nth * capacity)
        bins, gap = np.full(len(row), -1, dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        some = sizes > 0
        if some.any():
            bins[some] = sum_of_squares(sizes[some], capacity)
            gap[some] = (capacity - np.bincount(bins[some], weights=sizes[some]).astype(np.int64))[bins[some]]
            bins[some] += level << 56 | key[0].as_py() << 32
        return pa.Table.from_arrays(
            [t.column("doc_id").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (piece, start, sizes)), pa.array(bins, mask=~some), pa.array(gap.astype(np.int32))],
            names=["doc_id", "piece", "start", "size", "bin", "gap"],
        )

    return rows.groupBy("part").applyInArrow(run, f"doc_id {id_type}, piece int, start int, size int, bin bigint, gap int")


def pack(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, start, size, bin): where each piece of each document goes; bins are numbered pass * 2^56 + group * 2^32 + n."""
    id_type, level, zero = dict(docs.dtypes)[id_col], 0, F.lit(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), zero.alias("piece"), zero.alias("start"), F.coalesce(size if size is not None else token_size(text_col), zero).cast("int").alias("size"))
    n, done, before = docs.select(id_col).count(), [], math.inf
    while True:
        groups = max(1, -(-n // group_rows))
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)).cast("bigint")  # even, whatever repeats
        packed = _packed(rows.withColumn("part", part), id_type, capacity, level)
        if groups == 1:
            done.append(packed)
            break
        packed = cut(packed)
        loose = packed.where("gap > 0")
        n, opened = loose.agg(F.count("*"), F.count_distinct("bin")).first()
        if opened == 0 or opened > (1 - WORTH) * before:
            done.append(packed)
            break
        done.append(packed.where("gap = 0"))
        rows, before, level = loose.select("doc_id", "piece", "start", "size"), opened, level + 1
    return functools.reduce(DataFrame.unionAll, done).select("doc_id", "piece", "start", "size", "bin")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
