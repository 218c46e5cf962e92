"""Longest-processing-time sharding of groups that must stay together.

By default all copies of one text (white space and case apart) are a group, so a copy never meets its twin in another shard; any
column can be the group instead. A group's size is the characters of its rows, plus one a row. Groups are taken by
size, the largest first, and each goes to the least-loaded shard (of equals, the lowest number), kept in a heap.

Scale: the rule needs no more than how many groups there are of each size. Groups of one size are interchangeable, and
what the heap would do with ``c`` of them is to fill the ``c`` lowest of the loads at which shards could take one; all but
the last few of these are found at once by bisection, the rest by heap. So the sequential part is one step a distinct
size (sizes are bounded by the longest group, not by the number of groups), in one task; the groups then find their shard by
their rank among those of their size, a rank made of offsets by hash bucket so that a frequent size is no hot key. Texts are
read once: what goes on is (id, key, characters), checkpointed.

Defined edge cases: null texts (or null keys of a given group column) are one group, apart from empty ones; null ids are kept; repeated rows are in
one group; an empty table gives no rows; groups of equal size are ranked by bucket and key; long texts count in full; extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.textkernel import cut

SHARDS, BUCKETS = 64, 64


def place(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of ``count`` groups of one size each shard takes; ``loads`` is raised by that."""
    taken = np.zeros(len(loads), dtype=np.int64)
    if count > 4 * len(loads):
        low, high = int(loads.min()), int(loads.max()) + size * (count + 1)
        while high - low > 1:  # the highest level below which there are at most count places
            mid = (low + high) // 2
            if np.maximum(0, -(-(mid - loads) // size)).sum() <= count:
                low = mid
            else:
                high = mid
        taken = np.maximum(0, -(-(low - loads) // size))
        loads += taken * size
        count -= int(taken.sum())
    heap = [(int(load), j) for j, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        load, j = heap[0]
        heapq.heapreplace(heap, (load + size, j))
        taken[j] += 1
        loads[j] += size
    return taken


def _schedule(shards: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(shards, dtype=np.int64)
        for b in it:
            first, shard = [], []
            for size, count in zip(b.column("size").to_pylist(), b.column("n").to_pylist(), strict=True):
                taken = place(loads, size, count)
                who = np.flatnonzero(taken)
                first.append((np.cumsum(taken[who]) - taken[who]).tolist())
                shard.append(who.tolist())
            yield pa.RecordBatch.from_arrays([b.column("size"), pa.array(first, type=pa.list_(pa.int64())), pa.array(shard, type=pa.list_(pa.int32()))], names=["size", "first", "shard"])

    return run


def assign_shards(docs: DataFrame, group: Column | None = None, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, group_size) of every row."""
    key = group if group is not None else F.md5(F.lower(F.trim(F.regexp_replace(text_col, r"\s+", " "))))
    named = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), named.alias("g"), (F.coalesce(F.length(text_col), F.lit(0)) + 1).cast("bigint").alias("chars")))
    groups = rows.groupBy("g").agg(F.sum("chars").alias("size")).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int"))
    counts = groups.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("offset"))
    sizes = counts.groupBy("size").agg(F.sum("n").alias("n")).repartition(1).sortWithinPartitions(F.desc("size"))
    plan = sizes.mapInArrow(_schedule(shards), "size bigint, first array<bigint>, shard array<int>")
    nth = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("g")) - 1
    ranked = groups.withColumn("nth", nth).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("nth") + F.col("offset"))
    placed = ranked.join(plan, "size").select("g", "size", F.expr("shard[size(filter(first, f -> f <= rank)) - 1]").alias("shard"))
    return rows.join(placed, "g").select("doc_id", "shard", F.col("size").alias("group_size"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
