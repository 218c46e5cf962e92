"""Qualifying and loading columnar robot datasets, planning downloads, joining record indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import contains_any, first_match, slug

FIELDS = ("observation.state", "action")
SIM_HINTS = ("_sim_", "_sim", "scripted")
REAL_HINTS = tuple("aloha_mobile bridge_orig droid fractal20220817 language_table pusht_image real umi_cup_in_the_wild".split())
FAMILIES = (("aloha", "aloha"), ("pusht", "pusht"), ("xarm", "xarm"), ("umi", "umi"), ("language_table", "language-table"), ("droid", "droid"), ("bridge", "bridge"), ("fractal", "fractal"))


def is_real(repo: Column, real: Sequence[str] = REAL_HINTS, sim: Sequence[str] = SIM_HINTS) -> Column:
    """A hint of simulation outweighs any hint of a real robot."""
    low = F.lower(repo)
    return ~contains_any(low, sim) & contains_any(low, real)


def family(repo: Column, names: Sequence[tuple[str, str]] = FAMILIES) -> Column:
    return first_match(F.lower(repo), names, F.element_at(F.split(slug(repo), "__"), -1))


def pick_field(widths: Sequence[tuple[str, Column]], least: int) -> Column:
    """struct<field, width>: the first field that is wide enough, else the widest (the first of equals), else null and 0."""
    wide = [F.when(w >= least, F.struct(F.lit(n).alias("field"), w.cast("int").alias("width"))) for n, w in widths]
    most = F.greatest(*[F.coalesce(w, F.lit(0)) for _, w in widths]) if len(widths) > 1 else F.coalesce(widths[0][1], F.lit(0))
    widest = [F.when((w == most) & (w > 0), F.struct(F.lit(n).alias("field"), w.cast("int").alias("width"))) for n, w in widths]
    return F.coalesce(*wide, *widest, F.struct(F.lit(None).cast("string").alias("field"), F.lit(0).alias("width")))


def qualify(df: DataFrame, least: int, require_real: bool = True, real: Sequence[str] = REAL_HINTS, sim: Sequence[str] = SIM_HINTS) -> DataFrame:
    """Adds selected_field, joint_count, is_real, reason and qualifies to (repo_id, parquet_count, state_width, action_width)."""
    pick = pick_field([(FIELDS[0], F.col("state_width")), (FIELDS[1], F.col("action_width"))], least)
    out = df.withColumns({"_p": pick, "is_real": is_real(F.col("repo_id"), real, sim)})
    none = F.col("parquet_count") == 0
    reason = (
        F.when(none, "NO_DATA_PARQUET")
        .when(F.col("_p.field").isNull() | (F.col("_p.width") < least), f"INSUFFICIENT_JOINT_DIM_LT_{least}")
        .when(F.lit(require_real) & ~F.col("is_real"), "NOT_REAL_DATASET")
        .otherwise("QUALIFIED")
    )
    out = out.withColumns({"selected_field": F.when(~none, F.col("_p.field")), "joint_count": F.when(none, 0).otherwise(F.col("_p.width")), "reason": reason})
    return out.withColumn("qualifies", F.col("reason") == "QUALIFIED").drop("_p")


def plan_files(files: DataFrame, group: Sequence[str], max_files: int, max_bytes: int) -> DataFrame:
    """The files to fetch of (group.., path, size, is_info): information files always, data files by (size, path) within both bounds.

    Sizes ascend, so once a file is over the bound all later ones are: a running sum decides.
    """
    size = F.coalesce(F.col("size"), F.lit(0))
    w = Window.partitionBy(*group, "is_info").orderBy(size, "path")
    info = F.sum(F.when(F.col("is_info"), size).otherwise(0)).over(Window.partitionBy(*group))
    ranked = files.withColumns({"_n": F.row_number().over(w), "_sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_info": info})
    keep = F.col("is_info") | ((F.col("_n") <= max_files) & (F.col("_sum") + F.col("_info") <= max_bytes))
    return ranked.where(keep).drop("_n", "_sum", "_info")


def attach_index(messages: DataFrame, index: DataFrame, keys: Sequence[str], order: Sequence[str | Column], defaults: dict[str, Column]) -> DataFrame:
    """Left join to a record index whose keys may repeat: the last one by ``order`` counts, ``defaults`` fill misses."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    last = index.withColumn("_n", nth).where("_n = 1").select(*keys, *defaults)
    return messages.join(last, list(keys), "left").withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def longest_series(df: DataFrame, group: Sequence[str], series: str) -> DataFrame:
    """(group.., series, n): the series of most rows in each group, the lowest of equals."""
    per = df.groupBy(*group, series).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), series))
    return per.withColumn("_r", nth).where("_r = 1").drop("_r")


def _deflated(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in it:
        rows = [None if v is None else np.array(v, dtype="<f4").tobytes() for v in col.to_pylist()]
        kinds = [("raw", pa.int64()), ("packed", pa.int64())]
        yield pa.array([None if r is None else {"raw": len(r), "packed": len(zlib.compress(r, 9))} for r in rows], type=pa.struct(kinds))


def compression_ratio(df: DataFrame, group: Sequence[str], vector: Column) -> DataFrame:
    """(group.., ratio): float32 bytes of all vectors over their deflated bytes, vector by vector; 0 where there are none."""
    size = F.arrow_udf(_deflated, "struct<raw:bigint,packed:bigint>")(vector)
    sums = df.select(*group, size.alias("_s")).groupBy(*group).agg(F.sum("_s.raw").alias("_r"), F.sum("_s.packed").alias("_p"))
    return sums.select(*group, F.coalesce(F.col("_r") / F.greatest(F.lit(1), F.col("_p")), F.lit(0.0)).alias("ratio"))


def vector_metrics(df: DataFrame, group: Sequence[str], vector: Column, task: Column) -> DataFrame:
    """(group.., samples, numeric_samples, dim_mean, energy_mean, task_diversity); energy is the Euclidean norm."""
    some = F.size(F.coalesce(vector, F.array())) > 0
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.groupBy(*group).agg(
        F.count("*").alias("samples"), F.count_if(some).alias("numeric_samples"), F.coalesce(F.avg(F.when(some, F.size(vector))), F.lit(0.0)).alias("dim_mean"),
        F.coalesce(F.avg(F.when(some, length)), F.lit(0.0)).alias("energy_mean"), F.countDistinct(F.when(some, task)).alias("task_diversity"),
    )
