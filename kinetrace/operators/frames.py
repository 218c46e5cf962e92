"""Trajectories as frame tables, and the ordered operators on them.

A *wide* table has one row a frame: ``traj_id, frame, x0 .. xn`` (a column a joint); a *long* one a row a cell:
``traj_id, joint, frame, x``. Everything is partitioned by ``traj_id`` once; windows, aggregates and joins by trajectory after
that reuse the exchange and, where they can, the sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import finite, rounded

MIN_FRAMES = 8


def wide_frames(df: DataFrame, traj: str, order: Sequence[str | Column], joints: Sequence[str]) -> DataFrame:
    """Frames numbered from 0 in the order given, which has to be total within a trajectory."""
    xs = [F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(joints)]
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    # renamed before the window, so that its partitioning is known by the name that all later operators use
    named = df.select(F.col(traj).alias("traj_id"), *xs, *keys)
    w = Window.partitionBy("traj_id").orderBy(*[f"_o{i}" for i in range(len(keys))])
    return named.withColumn("frame", (F.row_number().over(w) - 1).cast("bigint")).select("traj_id", "frame", *[f"x{j}" for j in range(len(xs))])


def joint_count(wide: DataFrame, prefix: str = "x") -> int:
    return sum(c.startswith(prefix) and c[len(prefix) :].isdigit() for c in wide.columns)


def melt(wide: DataFrame, names: Sequence[str] = ("x",), keep: Sequence[str] = ("traj_id", "frame")) -> DataFrame:
    """Wide to long: columns ``name0 .. namen`` become rows ``joint, name``."""
    n = joint_count(wide, names[0])
    cells = [F.struct(F.lit(j).alias("joint"), *[F.col(f"{c}{j}").alias(c) for c in names]) for j in range(n)]
    return wide.select(*keep, F.inline(F.array(*cells)))


def embedding_frames(df: DataFrame, traj: str, vector: str, joints: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Wide frames of an array column: frame f has the ``joints`` elements from f * joints on."""
    n = F.size(vector)
    steps = F.transform(F.sequence(F.lit(0), (n / joints).cast("int") - 1), lambda f: F.struct(f.cast("bigint").alias("frame"), *[F.get(F.col(vector), f * joints + j).cast("double").alias(f"x{j}") for j in range(joints)]))
    return df.where(n >= joints).select(F.col(traj).alias("traj_id"), *keep, F.inline(steps))


def validate(long: DataFrame, min_frames: int = MIN_FRAMES) -> DataFrame:
    """(traj_id, frames, joints, status): ok, too_few_frames, ragged, or non_finite, judged in this order."""
    per = long.groupBy("traj_id").agg(
        F.countDistinct("frame").alias("frames"), F.countDistinct("joint").cast("int").alias("joints"), F.count("*").alias("cells"), F.sum((~finite("x")).cast("bigint")).alias("bad")
    )
    status = F.when(F.col("frames") < min_frames, "too_few_frames").when(F.col("cells") != F.col("frames") * F.col("joints"), "ragged").when(F.col("bad") > 0, "non_finite").otherwise("ok")
    return per.select("traj_id", "frames", "joints", status.alias("status"))


def kinetics(wide: DataFrame, digits: int | None = 9) -> DataFrame:
    """Adds velocities ``v0..`` and accelerations ``a0..``: differences to the frame before, 0 at the first.

    Both are rounded to ``digits`` decimals before use, so that boundary cases fall alike in every engine; None keeps raw doubles.
    """
    w, n = Window.partitionBy("traj_id").orderBy("frame"), joint_count(wide)
    tidy = (lambda c: rounded(c, digits)) if digits is not None else (lambda c: c)
    vs = {f"v{j}": F.coalesce(tidy(F.col(f"x{j}") - F.lag(f"x{j}").over(w)), F.lit(0.0)) for j in range(n)}
    moved = wide.withColumns(vs)
    return moved.withColumns({f"a{j}": F.coalesce(tidy(F.col(f"v{j}") - F.lag(f"v{j}").over(w)), F.lit(0.0)) for j in range(n)})


def steps(wide: DataFrame, digits: int | None = 9) -> DataFrame:
    """Adds step vectors ``d0..`` from the frame before; the first frame has none (null)."""
    w, n = Window.partitionBy("traj_id").orderBy("frame"), joint_count(wide)
    tidy = (lambda c: rounded(c, digits)) if digits is not None else (lambda c: c)
    return wide.withColumns({f"d{j}": tidy(F.col(f"x{j}") - F.lag(f"x{j}").over(w)) for j in range(n)})


def planar(wide: DataFrame) -> DataFrame:
    """Two-joint paths: the first two joints, or time (frame / frames) and the only joint."""
    if joint_count(wide) > 1:
        return wide.select(*[c for c in wide.columns if not (c[0] == "x" and c[1:].isdigit() and int(c[1:]) > 1)])
    n = F.count("*").over(Window.partitionBy("traj_id"))
    return wide.withColumnRenamed("x0", "x1").withColumn("x0", F.col("frame") / n)


def resample(wide: DataFrame, frames: int) -> DataFrame:
    """Linear interpolation to ``frames`` evenly spaced points, both ends included; one frame repeats.

    Every stretch between two neighbouring frames makes the points that fall into it: no join.
    """
    w, n = Window.partitionBy("traj_id").orderBy("frame"), joint_count(wide)
    last = F.count("*").over(Window.partitionBy("traj_id")) - 1
    nxt = wide.withColumns({"last": last} | {f"n{j}": F.lead(f"x{j}").over(w) for j in range(n)})
    step = F.nullif("last", F.lit(0)) / F.lit(float(frames - 1))  # null where there is one frame
    # target t lies at t * step; the stretch of frame f holds f <= t * step < f + 1, the last frame the end itself
    low = F.greatest(F.ceil(F.col("frame") / step).cast("int") - 1, F.lit(0))
    high = F.least(F.ceil((F.col("frame") + 1) / step).cast("int") + 1, F.lit(frames - 1))
    targets = F.sequence(F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(frames - 1)))
    out = nxt.withColumn("t", F.explode(targets)).withColumn("at", F.col("t") * F.col("last") / F.lit(float(frames - 1))).where(F.floor("at") == F.col("frame"))
    share = F.col("at") - F.col("frame")
    xs = [F.when(F.col("frame") == F.col("last"), F.col(f"x{j}")).otherwise(F.col(f"x{j}") + share * (F.col(f"n{j}") - F.col(f"x{j}"))).alias(f"x{j}") for j in range(n)]
    return out.select("traj_id", F.col("t").cast("bigint").alias("frame"), *xs)


def pad_or_cut(wide: DataFrame, frames: int) -> DataFrame:
    """Exactly ``frames`` frames: cut, or the last one repeated (to MIN_FRAMES at least)."""
    frames = max(frames, MIN_FRAMES)
    last = F.count("*").over(Window.partitionBy("traj_id")) - 1
    copies = F.when(F.col("frame") == F.col("last"), F.sequence(F.col("frame"), F.greatest(F.col("frame"), F.lit(frames - 1).cast("bigint")))).otherwise(F.array("frame"))
    return wide.withColumn("last", last).where(F.col("frame") < frames).withColumn("frame", F.explode(copies)).drop("last")


def slices(wide: DataFrame, length: int, count: int | None = None) -> DataFrame:
    """Adds ``slice`` and ``offset``: windows of ``length`` frames that don't overlap, the first ``count`` of them."""
    out = wide.withColumns({"slice": F.floor(F.col("frame") / length).cast("int"), "offset": F.col("frame") % length})
    return out if count is None else out.where(F.col("slice") < count)


def end_effector(wide: DataFrame, links: Sequence[float] | None = None, z_gain: float = 0.015) -> DataFrame:
    """(traj_id, frame, ex, ey, ez) of a planar chain with cumulative joint angles; even joints lift z."""
    n = joint_count(wide)
    if links is None:
        links = [0.20 + (0.05 - 0.20) * j / (n - 1) if n > 1 else 0.20 for j in range(n)]
    if len(links) != n:
        raise ValueError(f"{len(links)} link lengths for {n} joints")
    angle = [reduce(lambda a, b: a + b, [F.col(f"x{i}") for i in range(j + 1)]) for j in range(n)]
    total = lambda f: reduce(lambda a, b: a + b, [f(a) * F.lit(float(link)) for a, link in zip(angle, links, strict=True)])
    z = F.lit(z_gain) * reduce(lambda a, b: a + b, [F.sin(f"x{j}") for j in range(0, n, 2)])
    return wide.select("traj_id", "frame", total(F.cos).alias("ex"), total(F.sin).alias("ey"), z.alias("ez"))


def order_violations(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], index: Column) -> DataFrame:
    """(group.., records, violations): where the stored index isn't the record's position from 0."""
    pos = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("_bad", (index != pos).cast("bigint")).groupBy(*group).agg(F.count("*").alias("records"), F.sum("_bad").alias("violations"))
