"""Benchmark decontamination by size-partitioned MinHash containment search.

Question: which documents hold at least ``THRESHOLD`` of a test item's 5-word shingles? Items are short and documents
long, so the Jaccard similarity of the two says little. Both sides are therefore partitioned by size: items by
the power of two ``u`` (from 1 on) not under their number of shingles, and for each such class every document is cut into consecutive
blocks of ``u`` shingles, which makes a containment bound a Jaccard bound that holds for any length of document. An item
and a block that agree in any of ``PERMUTATIONS`` minima are a candidate (bands of one row: there are few
items, so selectivity comes from the shingles themselves). An item that is spread over several blocks has a chance in
each of them, and the number of permutations is derived from the worst case (half in each of two blocks, smallest item
of its class) for at most ``MISS`` missed pairs. Blocks of a class are pairs of blocks of the class below, so the minima
of all classes cost one pass. Every candidate is then verified: exact containment of the item's shingle set
in the whole document's.

Scale: one scan of the documents, no shuffle; items are broadcast in slices of at most ``SLICE_SHINGLES`` shingles (16 MB), a
larger benchmark takes further scans. Nothing else is sent.

Defined edge cases: null or word-free texts match nothing, on either side; a text of fewer than five words has one
shingle, all of its words, so an item that short is found in documents that are equal to it; items that repeat each give their own pair; null ids are kept in the pairs, ids of
any type come back as they were; repeated document rows give repeated pairs; an empty table on either side gives no pairs; long texts are searched whole, about a megabyte
at a time; containment of exactly the threshold counts; extra columns are ignored, or kept by the filter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinetrace.llm.textkernel import shingles, words

SHINGLE, THRESHOLD, MISS = 5, 0.5, 0.001
SLICE_SHINGLES = 2_000_000


def _permutations(threshold: float, miss: float) -> int:
    part = threshold / 4  # of u: half of an item of u / 2 shingles, at the threshold
    jaccard = part / (1 + 0.5 - part)
    return math.ceil(math.log(miss) / (2 * math.log(1 - jaccard)))


def _up(starts: np.ndarray, count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of ``step`` elements inside runs that begin at ``starts``; and how many each run has."""
    n = -(-count // step)
    first = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(first, n)
    return np.repeat(starts, n) + step * within, n


class ItemIndex:
    """Minima of a slice of items by size class, with what is needed to verify a candidate."""

    def __init__(self, shingle_sets: list[np.ndarray], threshold: float = THRESHOLD, miss: float = MISS):
        self.sets, self.threshold = shingle_sets, threshold
        self.n_perm = _permutations(threshold, miss)
        rng = np.random.default_rng(4242)
        self.a = rng.integers(0, 1 << 31, self.n_perm, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.n_perm, dtype=np.uint32)
        by_level: dict[int, list[int]] = {}
        for i, s in enumerate(shingle_sets):
            if len(s):
                by_level.setdefault((len(s) - 1).bit_length(), []).append(i)
        self.levels = {}
        for level, ids in by_level.items():
            low = (np.concatenate([self.sets[i] for i in ids]) >> np.uint64(32)).astype(np.uint32)
            first = np.cumsum([0] + [len(self.sets[i]) for i in ids[:-1]])
            tables = []
            for p in range(self.n_perm):
                v = np.minimum.reduceat(low * self.a[p] + self.b[p], first)
                order = np.argsort(v, kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[v & np.uint32(0xFFFF)] = True
                tables.append((v[order], np.array(ids)[order], seen))
            self.levels[level] = tables

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item's position, shared shingles, item's shingles) of each contained item."""
        bottom, top = min(self.levels, default=0), max(self.levels, default=-1)
        for w in words(texts) if self.levels else ():
            x, at = shingles(w, SHINGLE)
            if not len(x):
                continue
            low, work = (x >> np.uint64(32)).astype(np.uint32), np.empty(len(x), dtype=np.uint32)
            shape, starts, count = [], at[:-1], np.diff(at)
            for level in range(bottom, top + 1):
                cuts, n = _up(starts, count, 1 << bottom if level == bottom else 2)
                shape.append((cuts, np.repeat(np.arange(w.n_docs), n)))
                starts, count = np.cumsum(n) - n, n
            pairs: set[tuple[int, int]] = set()
            for p in range(self.n_perm):
                np.multiply(low, self.a[p], out=work)
                np.add(work, self.b[p], out=work)
                least = work
                for level, (cuts, doc) in enumerate(shape, bottom):
                    least = np.minimum.reduceat(least, cuts)
                    if level in self.levels:
                        values, ids, seen = self.levels[level][p]
                        hit = np.flatnonzero(seen[least & np.uint32(0xFFFF)])
                        lo, hi = np.searchsorted(values, least[hit], "left"), np.searchsorted(values, least[hit], "right")
                        for h, i, j in zip(hit[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                            pairs.update((int(doc[h]), int(q)) for q in ids[i:j])
            last, own = -1, x
            for doc, q in sorted(pairs):
                if doc != last:
                    last, own = doc, np.sort(x[at[doc] : at[doc + 1]])
                s = self.sets[q]
                pos = np.minimum(np.searchsorted(own, s), len(own) - 1)
                shared = int(np.count_nonzero(own[pos] == s))
                if shared >= self.threshold * len(s):
                    yield w.first_row + doc, q, shared, len(s)


def item_slices(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, shingle sets) of the items, at most SLICE_SHINGLES at a time (one item at least)."""
    ids, sets, size = [], [], 0
    for row in items.select(F.col(id_col), F.lower(F.col(text_col))).toLocalIterator():
        w = next(words(pa.array([row[1]], type=pa.string())))
        s = np.unique(shingles(w, SHINGLE)[0])
        if sets and size + len(s) > SLICE_SHINGLES:
            yield ids, sets
            ids, sets, size = [], [], 0
        ids.append(row[0])
        sets.append(s)
        size += len(s)
    if sets:
        yield ids, sets


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared_shingles, item_shingles) for every document and item that it contains."""
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, shared_shingles int, item_shingles int"
    source = docs.select("doc_id", F.lower("text").alias("text"))
    out = spark.createDataFrame([], schema)
    for ids, sets in item_slices(items, "item_id", "text"):
        names = pa.array([bytes(i) if isinstance(i, bytearray) else i for i in ids], type=to_arrow_type(items.schema["item_id"].dataType))
        known = spark.sparkContext.broadcast((names, ItemIndex(sets, threshold)))

        def scan(it: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            names, index = known.value
            for b in it:
                found = list(index.find(b.column(1)))
                rows = pa.array([f[0] for f in found], type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), names.take(pa.array([f[1] for f in found], type=pa.int64()))] + [pa.array([f[i] for f in found], type=pa.int32()) for i in (2, 3)],
                    names=["doc_id", "item_id", "shared_shingles", "item_shingles"],
                )

        out = out.unionAll(source.mapInArrow(scan, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns stay, nothing is shuffled. Null texts stay."""
    spark = docs.sparkSession
    for _, sets in item_slices(items, "item_id", "text"):
        docs = docs.where(_clean(spark.sparkContext.broadcast(ItemIndex(sets, threshold)))(F.lower(F.col(text_col))))
    return docs


def _clean(known: Broadcast) -> Callable[[Column], Column]:
    def clean(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            keep = np.ones(len(texts), dtype=bool)
            keep[[f[0] for f in known.value.find(texts)]] = False
            yield pa.array(keep)

    return F.arrow_udf(clean, "boolean").asNondeterministic()


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SETS = """{name} AS (
  SELECT DISTINCT {id}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table}))"""
SQL = f"""
WITH {_SETS.format(name="d", id="doc_id", table="documents")},
{_SETS.format(name="b", id="item_id", table="benchmark")},
n AS (SELECT item_id, count(*) AS total FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, count(*)::INTEGER AS shared_shingles, any_value(n.total)::INTEGER AS item_shingles
FROM d JOIN b USING (g) JOIN n ON n.item_id = b.item_id
GROUP BY d.doc_id, b.item_id HAVING count(*) >= {THRESHOLD} * any_value(n.total)
"""
