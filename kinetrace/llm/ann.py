"""Nearest neighbours through an inverted multi-index.

Each half of a vector is quantised by a codebook of its own (k-means over at most about ``FIT_ROWS`` vectors, chosen by
hash); a pair of codes is a cell, and every vector is filed in one. For a query, the two lists of centroids are sorted by distance and a heap walks their pairs by increasing summed distance (the
multi-sequence algorithm) until the cells that it passed hold enough entries; those are reranked by exact distance.
How many are enough is measured, not guessed: the true neighbours of ``PROBES`` sample queries, found among all vectors, say
after how many entries the walk reaches a share ``RECALL`` of them. On data without structure that is most
of the table, on clustered data very little.

Scale: what is broadcast is two codebooks and the cells' counts, buckets and bits, at most 3 x ``MOST_CENTROIDS``^2 numbers whatever the input.
Entries lie in buckets of neighbouring cells, about ``BUCKET_ROWS`` each. A query is sent once to each bucket of which its walk passed filled
cells, with a bit for each filled cell of the bucket; entries come first and stay in
memory, queries stream past. Queries are the rows that a condition names, by default all; the registered query asks with
every id that 100 divides, against all rows. Beyond ``CELL_ROWS`` x ``MOST_CENTROIDS``^2 (52 million) vectors cells grow with the input.

Defined edge cases: null vectors, vectors with null or non-finite parts, and vectors whose length isn't the most frequent
one have no neighbours and are none; rows equal in id and vector count once; null ids are allowed; ties go to
the lower id; with fewer than ``k`` other vectors all of them are neighbours; zero vectors are ordinary points; an empty
table and a condition that no row meets (or that is null) give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.textkernel import cut

NEIGHBOURS, RECALL, PROBES, ITERATIONS = 10, 0.96, 256, 8
CELL_ROWS, MOST_CENTROIDS, BUCKET_ROWS, FIT_ROWS = 50, 1024, 4096, 250_000


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)] squared Euclidean distances."""
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> tuple[list[int], float, list[int]]:
    """(cells in order, summed distance of the last, entries passed so far) of one query's multi-sequence walk."""
    k = len(d2)
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, reached = [(s1[0] + s2[0], 0, 0)], [-1] * (len(s1) + 1)  # reached[i]: the last j popped with i
    cells, passed, total, last = [], [], 0, 0.0
    while heap:
        last, i, j = heapq.heappop(heap)
        reached[i] = j
        cell = o1[i] * k + o2[j]
        total += counts[cell]
        cells.append(cell)
        passed.append(total)
        if total >= enough:
            break
        if j + 1 < k and (i == 0 or reached[i - 1] >= j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < len(s1) and reached[i + 1] == j - 1:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return cells, last, passed


def _bits(counts: np.ndarray, bucket_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit of each filled cell, first byte of each bucket and their end): every bucket's bits begin at a byte."""
    full = np.flatnonzero(counts)
    per = np.bincount(bucket_of[full])
    first = np.concatenate([[0], np.cumsum((per + 7) // 8)])
    bit = np.zeros(len(counts), dtype=np.int64)
    bit[full] = 8 * first[bucket_of[full]] + np.arange(len(full)) - (np.cumsum(per) - per)[bucket_of[full]]
    return bit, first


def _codebooks(rows: DataFrame, dim: int, k: int, iterations: int) -> list[np.ndarray]:
    """k-means of each half over the rows given; begins at k vectors chosen by hash."""
    spark, half = rows.sparkSession, dim // 2
    start = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(k).collect()], dtype=np.float32).reshape(-1, dim)
    books = [start[:, :half].copy(), start[:, half:].copy()]
    for _ in range(iterations):
        known = spark.sparkContext.broadcast(books)

        def sums(it: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(b), b.shape[1] + 1)) for b in known.value]
            for b in it:
                x = matrix(b.column(0), dim)
                for lo in range(0, len(x), 4096):
                    for t, book, part in zip(total, known.value, (x[lo : lo + 4096, :half], x[lo : lo + 4096, half:]), strict=True):
                        near = squared(part, book).argmin(1)
                        order = np.argsort(near, kind="stable")
                        first = np.flatnonzero(np.diff(near[order], prepend=-1))
                        t[near[order][first], :-1] += np.add.reduceat(part[order].astype(np.float64), first, axis=0)
                        t[:, -1] += np.bincount(near, minlength=len(t))
            for h, t in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), h)), pa.array(np.arange(len(t))), pa.array(list(t), type=pa.list_(pa.float64()))], names=["h", "c", "s"])

        parts = rows.select("v").mapInArrow(sums, "h bigint, c bigint, s array<double>")
        added = parts.select("h", "c", F.posexplode("s").alias("p", "x")).groupBy("h", "c", "p").agg(F.sum("x").alias("x")).groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("p", "x")))["x"].alias("s"))
        for r in added.collect():
            if r["s"][-1] > 0:
                books[r["h"]][r["c"]] = np.array(r["s"][:-1]) / r["s"][-1]
    return books


def nearest_neighbours(
    vectors: DataFrame, k: int = NEIGHBOURS, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", bucket_rows: int = BUCKET_ROWS, queries: Column | None = None
) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the ``k`` nearest other vectors, among all, of every vector or of those that ``queries`` holds for."""
    spark, id_type = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    schema = f"vec_id {id_type}, neighbour_id {id_type}, rank int, distance double"
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    valid = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"), asks.alias("asks")).where("v is not null and size(v) > 1 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    common = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, half = common["d"], common["d"] // 2
    once = valid.where(F.size("v") == dim).groupBy("id", "v").agg(F.max("asks").alias("asks"))
    rows = cut(once.withColumn("key", F.monotonically_increasing_id()))  # written once, so a key stays
    n, chosen = rows.count(), F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
    fit = rows if n <= FIT_ROWS else cut(rows.where(chosen < (1 << 30) * FIT_ROWS // n))
    books = _codebooks(fit, dim, min(MOST_CENTROIDS, n, max(2, round(math.sqrt(n / CELL_ROWS)))), ITERATIONS)
    size = len(books[1])
    known = spark.sparkContext.broadcast(books)

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b.column("v"), dim)
            cell = np.zeros(len(x), dtype=np.int64)
            for lo in range(0, len(x), 4096):
                cell[lo : lo + 4096] = squared(x[lo : lo + 4096, :half], known.value[0]).argmin(1) * size + squared(x[lo : lo + 4096, half:], known.value[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)), b.column("asks")], names=["key", "id", "v", "cell", "asks"])

    coded = cut(rows.select("key", "id", "v", "asks").mapInArrow(code, f"key bigint, id {id_type}, v array<float>, cell int, asks boolean"))
    counts = np.zeros(len(books[0]) * size, dtype=np.int64)
    filled = coded.groupBy("cell").count().toArrow()  # at most MOST_CENTROIDS^2 numbers
    counts[filled.column("cell").to_numpy()] = filled.column("count").to_numpy()
    enough = _enough(coded, dim, books, counts, min(k, n - 1), recall)
    bucket_of = ((np.cumsum(counts) - counts) // bucket_rows).astype(np.int32)
    plan = spark.sparkContext.broadcast((counts, bucket_of, enough, *_bits(counts, bucket_of)))

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, buckets, stop_after, bit, first = plan.value
        held = counted.tolist()
        for b in it:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = matrix(part.column("v"), dim)
                d1, d2 = squared(x[:, :half], known.value[0]), squared(x[:, half:], known.value[1])
                row, to, passed = [], [], []
                for i in range(len(x)):
                    cells = np.array(walk(d1[i], d2[i], held, stop_after)[0])
                    cells = cells[counted[cells] > 0]
                    hit = np.unique(buckets[cells])
                    on = np.zeros(8 * first[-1], dtype=bool)
                    on[bit[cells]] = True
                    on = np.packbits(on).tobytes()
                    row.append(np.full(len(hit), i))
                    to.append(hit)
                    passed += [on[first[b] : first[b + 1]] for b in hit]
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(to)), pa.array(np.ones(len(at), dtype=np.int32))] + [part.column(c).take(at) for c in ("cell", "key", "id", "v")] + [pa.array(passed, type=pa.binary())],
                    names=["bucket", "is_query", "cell", "key", "id", "v", "passed"],
                )

    shape = f"bucket int, is_query int, cell int, key bigint, id {id_type}, v array<float>, passed binary"
    sent = coded.where("asks").mapInArrow(send, shape)

    def file(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bucket = plan.value[1][b.column("cell").to_numpy()]
            zero = np.zeros(b.num_rows, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(zero), b.column("cell"), b.column("key"), b.column("id"), b.column("v"), pa.nulls(b.num_rows, pa.binary())], names=["bucket", "is_query", "cell", "key", "id", "v", "passed"])

    met = coded.mapInArrow(file, shape).unionAll(sent).repartition("bucket").sortWithinPartitions("bucket", "is_query", "cell")

    def rerank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, None
        for b in it:
            where = b.column("bucket").to_numpy()
            kind = b.column("is_query").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])]))
            for lo, hi in zip(edges, np.append(edges[1:], len(where)), strict=True):
                part = b.slice(int(lo), int(hi - lo))
                if where[lo] != bucket:
                    bucket, held = where[lo], []
                if not kind[lo]:
                    held.append(part)
                    continue
                if isinstance(held, list):
                    t = pa.Table.from_batches(held).combine_chunks()
                    ids, place = t.column("id").combine_chunks(), np.empty(t.num_rows, dtype=np.int64)
                    place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(t.num_rows)
                    held = (t.column("key").to_numpy(), ids, matrix(t.column("v"), dim), plan.value[3][t.column("cell").to_numpy()] - 8 * plan.value[4][bucket], place)
                for q in range(0, part.num_rows, 512):
                    yield _rerank(part.slice(q, 512), held, dim, k)

    near = met.mapInArrow(rerank, f"key bigint, vec_id {id_type}, neighbour_key bigint, neighbour_id {id_type}, distance double")
    order = Window.partitionBy("key").orderBy("distance", F.col("neighbour_id").asc_nulls_last(), "neighbour_key")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", "distance")


def _rerank(part: pa.RecordBatch, held: tuple, dim: int, k: int) -> pa.RecordBatch:
    """The k best of a bucket's entries for some queries, among the cells that each query's walk passed."""
    keys, ids, x, at, place = held  # at: the bit of each entry's cell
    v, own = matrix(part.column("v"), dim), part.column("key").to_numpy()
    passed = np.unpackbits(np.frombuffer(b"".join(part.column("passed").to_pylist()), dtype=np.uint8).reshape(len(v), -1), axis=1).astype(bool)
    some = np.flatnonzero(passed.any(0)[at])
    if not len(some):
        some = np.arange(0)
    d = squared(v, x[some])
    d[~passed[:, at[some]]] = np.inf
    d[own[:, None] == keys[some][None, :]] = np.inf
    m = min(k, len(some))
    best = np.argpartition(d, m - 1, axis=1)[:, :m] if m else np.zeros((len(v), 0), dtype=np.int64)
    row = np.repeat(np.arange(len(v)), m)
    if m:  # as good as the last one, but for rounding: such queries choose by exact distance and id
        last = np.take_along_axis(d, best, 1).max(1)
        level = np.where(np.isfinite(last), last + 1e-5 * (1 + (v * v).sum(1)), -1.0)
        for r in np.flatnonzero((d <= level[:, None]).sum(1) > m):
            near = np.flatnonzero(d[r] <= level[r])
            true = ((v[r].astype(np.float64) - x[some[near]]) ** 2).sum(1)
            best[r] = near[np.lexsort((place[some[near]], true))[:m]]
    best = best.ravel()
    fine = np.isfinite(d[row, best])
    row, best = row[fine], some[best[fine]]
    exact = np.sqrt(((v[row].astype(np.float64) - x[best]) ** 2).sum(1))
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [part.column("key").take(take), part.column("id").take(take), pa.array(keys[best]), ids.take(pa.array(best)), pa.array(exact)],
        names=["key", "vec_id", "neighbour_key", "neighbour_id", "distance"],
    )


def _enough(coded: DataFrame, dim: int, books: list[np.ndarray], counts: np.ndarray, k: int, recall: float) -> int:
    """Entries that a walk has to pass for its cells to hold a share ``recall`` of the true neighbours; measured on PROBES queries."""
    half = dim // 2
    sample = coded.orderBy(F.xxhash64("id", "v"), "id").select("key", "v").limit(PROBES).collect()
    probe = np.array([r["v"] for r in sample], dtype=np.float32).reshape(-1, dim)
    own = np.array([r["key"] for r in sample], dtype=np.int64)
    if k < 1:
        return 1
    known = coded.sparkSession.sparkContext.broadcast((probe, own))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, mine = known.value
        for b in it:
            x, keys, cell = matrix(b.column("v"), dim), b.column("key").to_numpy(), b.column("cell").to_numpy()
            for lo in range(0, len(x), 8192):
                d = squared(p, x[lo : lo + 8192])
                d[mine[:, None] == keys[None, lo : lo + 8192]] = np.inf
                m = min(k, d.shape[1])
                best = np.argpartition(d, m - 1, axis=1)[:, :m]
                row = np.repeat(np.arange(len(p)), m)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(d[row, best.ravel()].astype(np.float64)), pa.array(cell[lo : lo + 8192][best.ravel()])], names=["q", "d", "cell"])

    nth = F.row_number().over(Window.partitionBy("q").orderBy("d", "cell"))
    true = coded.select("key", "v", "cell").mapInArrow(scan, "q bigint, d double, cell int").withColumn("nth", nth).where((F.col("nth") <= k) & (F.col("d") < float("inf"))).select("q", "cell").collect()
    wanted: dict[int, list[int]] = {}
    for r in true:
        wanted.setdefault(r["q"], []).append(r["cell"])
    held, needed = counts.tolist(), []
    for q, cells in wanted.items():
        order, _, passed = walk(squared(probe[q : q + 1, :half], books[0])[0], squared(probe[q : q + 1, half:], books[1])[0], held, int(counts.sum()))
        at = dict(zip(order, passed, strict=True))
        needed += [at[c] for c in cells]
    needed.sort()
    return max(k + 1, needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks with every vector whose id is divisible by 100, against all vectors."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 100 == 0)
