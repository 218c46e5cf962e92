"""Direction-magnitude tokens and their histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import bin_of, fixed_bins, octant, octant_atan2, rounded
from kinetrace.operators.frames import joint_count, kinetics, melt, steps

QUANTILES, MAGNITUDES, VOCABULARY = (0.33, 0.66), 3, 24


def _with_cuts(df: DataFrame, value: str) -> DataFrame:
    """Adds q1 and q2, the quantiles of ``value`` over the whole trajectory: a window, so the cells are computed once and not joined back."""
    cuts = F.percentile(value, F.array(*[F.lit(q) for q in QUANTILES])).over(Window.partitionBy("traj_id"))
    return df.withColumn("q", cuts).withColumns({"q1": F.get("q", F.lit(0)), "q2": F.get("q", F.lit(1))}).drop("q")


def joint_tokens(wide: DataFrame, exact: bool = False) -> DataFrame:
    """(traj_id, joint, frame, token): octant of (velocity, acceleration) and magnitude bin, cuts pooled over all joints.

    ``exact`` takes the angle of the raw differences instead of the rounded ones.
    """
    cells = melt(kinetics(wide, None if exact else 9), ("v", "a")).withColumn("m", F.sqrt(F.col("v") * F.col("v") + F.col("a") * F.col("a")))
    if not exact:
        cells = cells.withColumn("m", rounded("m", 9))
    turn = (octant_atan2 if exact else octant)(F.col("v"), F.col("a"))
    token = (turn * MAGNITUDES + bin_of(F.col("m"), [F.col("q1"), F.col("q2")])).cast("int")
    return _with_cuts(cells, "m").select("traj_id", "joint", "frame", token.alias("token"))


def tokenised(wide: DataFrame, exact: bool = False) -> DataFrame:
    """Two-joint paths with ``direction`` and ``token`` of the step to each frame, null at frame 0, which has none."""
    moved = steps(wide, None if exact else 9).withColumn("m", F.sqrt(F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1")))
    if not exact:
        moved = moved.withColumn("m", rounded("m", 9))
    moved = moved.withColumn("direction", F.when(F.col("frame") > 0, (octant_atan2 if exact else octant)(F.col("d0"), F.col("d1"))))
    token = (F.col("direction") * MAGNITUDES + bin_of(F.col("m"), [F.col("q1"), F.col("q2")])).cast("int")
    return _with_cuts(moved, "m").withColumn("token", token)


def path_tokens(wide: DataFrame, exact: bool = False) -> DataFrame:
    """(traj_id, frame, direction, token) of the steps of two-joint paths."""
    return tokenised(wide, exact).where("frame > 0").select("traj_id", "frame", "direction", "token")


def dense_histogram(df: DataFrame, keys: list[str], value: str, size: int, name: str = "token") -> DataFrame:
    """(keys.., name, freq) for all ``size`` values of ``value``, absent ones with 0; one aggregate, no fill join."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(value) == k).alias(f"c{k}") for k in range(size)])
    cells = F.array(*[F.struct(F.lit(k).alias(name), (F.col(f"c{k}") / F.col("n")).alias("freq")) for k in range(size)])
    return counts.select(*keys, F.inline(cells))


def token_histogram(tokens: DataFrame) -> DataFrame:
    """(traj_id, joint, token, freq): each joint's tokens normalised on their own, all 24 of them."""
    return dense_histogram(tokens, ["traj_id", "joint"], "token", VOCABULARY)


def action_tokens(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(traj_id, token, freq) over 9 tokens: sign and magnitude bin of the differences inside each vector."""
    cells = df.select(F.col(key).alias("traj_id"), F.posexplode(F.zip_with(F.slice(vector, 2, F.greatest(F.size(vector) - 1, F.lit(0))), F.slice(vector, 1, F.greatest(F.size(vector) - 1, F.lit(0))), lambda b, a: b.cast("double") - a.cast("double"))).alias("p", "d"))
    cells = _with_cuts(cells.withColumn("m", F.abs("d")), "m")
    token = ((F.signum("d") + 1) * 3 + bin_of(F.col("m"), [F.col("q1"), F.col("q2")])).cast("int")
    return dense_histogram(cells.withColumn("token", token), ["traj_id"], "token", 9)


def value_histogram(df: DataFrame, key: str, vector: str, low: float = -2.5, high: float = 2.5, bins: int = 16) -> DataFrame:
    """(traj_id, bin, freq) of the elements of each vector, clipped to the range."""
    cells = df.select(F.col(key).alias("traj_id"), F.explode(vector).alias("x")).withColumn("b", fixed_bins(F.col("x").cast("double"), low, high, bins))
    return dense_histogram(cells, ["traj_id"], "b", bins, "bin")


def grid_histogram(wide: DataFrame, low: float = -2.0, high: float = 2.0, side: int = 8) -> DataFrame:
    """(traj_id, cell, freq) over a side x side grid; points outside fall into the edge cells."""
    width = (high - low) / side
    index = lambda c: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((F.col(c) - low) / width).cast("int")))
    return dense_histogram(wide.withColumn("g", index("x0") * side + index("x1")), ["traj_id"], "g", side * side, "cell")


def export_tokens(wide: DataFrame) -> DataFrame:
    """One row a trajectory: tokens as frames x joints, time stamps 0.., and joint names."""
    n = joint_count(wide)
    per = joint_tokens(wide).groupBy("traj_id", "frame").agg(F.array_sort(F.collect_list(F.struct("joint", "token")))["token"].alias("row"))
    all_frames = per.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("frame", "row"))).alias("r"))
    return all_frames.select("traj_id", F.col("r.row").alias("tokens"), F.col("r.frame").alias("timestamps"), F.array(*[F.lit(f"joint_{j}") for j in range(n)]).alias("joint_names"))
