"""Truncated Fourier compression as plain aggregates: coefficients, reconstruction and its error."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.operators.frames import joint_count, melt

KEEP = 8


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def coefficients(long: DataFrame, keep: int = KEEP, float32: bool = False, keys: tuple[str, ...] = ("traj_id", "joint")) -> DataFrame:
    """(traj_id, joint, frames, c): the first ``keep`` bins of the unnormalised real transform, an array of (re, im).

    Two conditional-free sums a bin in one aggregate; rows are not multiplied by bins. Bins beyond frames / 2 are cut off.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    turn = F.lit(2 * math.pi) * F.col("frame") / F.col("frames")
    kind = "float" if float32 else "double"
    sums = [F.struct(F.sum(F.col("x") * F.cos(turn * k)).cast(kind).cast("double").alias("re"), (-F.sum(F.col("x") * F.sin(turn * k))).cast(kind).cast("double").alias("im")) for k in range(keep)]
    per = long.withColumn("frames", n).groupBy(*keys).agg(F.first("frames").alias("frames"), F.array(*sums).alias("c"))
    return per.withColumn("c", F.slice("c", F.lit(1), F.least(F.lit(keep), F.floor(F.col("frames") / 2).cast("int") + 1)))


def coefficient_rows(long: DataFrame, keep: int = KEEP) -> DataFrame:
    """(traj_id, joint, k, re, im)."""
    return coefficients(long, keep).select("traj_id", "joint", F.posexplode("c").alias("k", "z")).select("traj_id", "joint", "k", "z.re", "z.im")


def reconstruct(long: DataFrame, keep: int = KEEP, float32: bool = False) -> DataFrame:
    """(traj_id, joint, frame, x, y): every cell beside what the kept bins give back."""
    own = Window.partitionBy("traj_id", "joint")
    kind = "float" if float32 else "double"
    turn = F.lit(2 * math.pi) * F.col("frame") / F.col("frames")
    # the sums as windows: every cell sees its own series' bins without a join back
    both = long.withColumn("frames", F.count("*").over(own))
    both = both.withColumns({f"re{k}": F.sum(F.col("x") * F.cos(turn * k)).over(own).cast(kind).cast("double") for k in range(keep)} | {f"im{k}": (-F.sum(F.col("x") * F.sin(turn * k)).over(own)).cast(kind).cast("double") for k in range(keep)})
    parts = []
    for k in range(keep):
        weight = F.when(F.lit(2 * k) > F.col("frames"), 0.0).when(F.lit(2 * k) == F.col("frames"), 1.0).otherwise(1.0 if k == 0 else 2.0)
        parts.append(weight * (F.col(f"re{k}") * F.cos(turn * k) - (F.col(f"im{k}") * F.sin(turn * k) if k else F.lit(0.0))))
    return both.select("traj_id", "joint", "frame", "x", (_sum(parts) / F.col("frames")).alias("y"))


def fidelity(cells: DataFrame) -> DataFrame:
    """(traj_id, rmse_deg, max_abs_error) of x against y over all cells of a trajectory."""
    gap = F.col("x") - F.col("y")
    return cells.groupBy("traj_id").agg(F.sqrt(F.avg(F.pow(F.degrees(gap), F.lit(2.0)))).alias("rmse_deg"), F.max(F.abs(gap)).alias("max_abs_error"))


def spectral_features(wide: DataFrame, bins: int = 10) -> DataFrame:
    """(traj_id, i, value): re and im of the first bins of x, then of y, over the norm of all of them (at least 1e-12)."""
    c = coefficients(melt(wide), bins).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("joint", "c")))["c"].alias("c"))
    flat = F.flatten(F.transform(F.slice("c", 1, 2), lambda z: F.concat(F.transform(z, lambda p: p["re"]), F.transform(z, lambda p: p["im"]))))
    size = F.greatest(F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return c.select("traj_id", flat.alias("f")).withColumn("size", size).select("traj_id", "size", F.posexplode("f").alias("i", "value")).select("traj_id", "i", (F.col("value") / F.col("size")).alias("value"))


def archive_sizes(wide: DataFrame, keep: int = KEEP, header: int = 18) -> DataFrame:
    """Header-derived figures of a trajectory's packet before entropy coding."""
    j = joint_count(wide)
    per = wide.groupBy("traj_id").agg(F.count("*").alias("frames"))
    bins = (F.floor(F.col("frames") / 2) + 1).cast("bigint")
    kept = F.least(F.lit(keep).cast("bigint"), bins)
    out = per.withColumns({"joints": F.lit(j), "bins": bins, "keep": kept, "payload_values": kept * j * 2, "raw_bytes": F.col("frames") * 4 * j})
    status = F.when(F.col("frames") < 8, "frames < 8").when(F.col("joints") < 1, "joints < 1").when(F.col("keep") < 1, "keep < 1").when(F.col("keep") > F.col("bins"), "keep > bins").otherwise("ok")
    return out.withColumns({"packed_bytes": F.lit(header) + F.col("payload_values") * 4, "status": status})
