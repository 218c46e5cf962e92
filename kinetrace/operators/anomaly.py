"""Fleet-level and frame-level anomaly detection, threshold sweeps and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import rounded
from kinetrace.operators.frames import joint_count, kinetics, melt

THRESHOLD, BASELINE, STD_FLOOR, FPR_CEILING, RECALL_FLOOR = 3.22, 3.0, 1e-6, 0.05, 0.90
SPIKE_Z, SPIKE_STD_FLOOR, STUCK_SPEED, STUCK_FRAMES = 3.5, 1e-9, 1e-14, 5


def fit_fleet(histograms: DataFrame) -> DataFrame:
    """(joint, token, mean, std): the fleet's normal histogram; population deviation, floored."""
    return histograms.groupBy("joint", "token").agg(F.avg("freq").alias("mean"), F.greatest(F.stddev_pop("freq"), F.lit(STD_FLOOR)).alias("std"))


def score_fleet(histograms: DataFrame, model: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(traj_id, score, flagged): 3 times the root mean square z of a trajectory's histogram. The model has a row a joint and token."""
    z = (F.col("freq") - F.col("mean")) / F.col("std")
    scored = histograms.join(model, ["joint", "token"]).groupBy("traj_id").agg((F.lit(3.0) * F.sqrt(F.avg(z * z))).alias("score"))
    return scored.withColumn("flagged", F.col("score") > threshold)


def threshold_grid(spark, low: float = 3.0, steps: int = 101, step: float = 0.01) -> DataFrame:
    return spark.range(steps).select(F.round(F.lit(low) + F.col("id") * step, 2).alias("threshold"))


def sweep(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Confusion counts of (score, anomalous) at each threshold.

    Scores are counted once per cell of the grid, then summed from above; they are not multiplied by thresholds.
    """
    fixed = thresholds.agg(F.array_sort(F.collect_set("threshold")).alias("grid"))  # as many as there are thresholds
    place = scores.crossJoin(F.broadcast(fixed)).select("anomalous", F.size(F.filter("grid", lambda t: F.col("score") > t)).alias("above"))
    counted = place.groupBy("above").agg(F.count_if("anomalous").alias("a"), F.count_if(~F.col("anomalous")).alias("n"))
    cell = thresholds.distinct().withColumn("rank", F.row_number().over(Window.orderBy("threshold")))
    per = cell.crossJoin(F.broadcast(counted.agg(F.collect_list(F.struct("above", "a", "n")).alias("c"))))
    hits = lambda name, over: F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.when((x["above"] >= F.col("rank")) if over else F.lit(True), x[name]).otherwise(0))
    out = per.select("threshold", hits("n", True).alias("false_positives"), hits("a", True).alias("true_positives"), hits("n", False).alias("nominal"), hits("a", False).alias("anomalous"))
    return out.select(
        "threshold", "false_positives", "true_positives",
        (F.col("anomalous") - F.col("true_positives")).alias("false_negatives"), (F.col("nominal") - F.col("false_positives")).alias("true_negatives"),
        (F.col("false_positives") / F.greatest(F.lit(1), F.col("nominal"))).alias("fpr"), (F.col("true_positives") / F.greatest(F.lit(1), F.col("anomalous"))).alias("recall"),
    )


def choose(results: DataFrame, ceiling: float = FPR_CEILING, floor: float = RECALL_FLOOR) -> DataFrame:
    """The row of the lowest threshold that keeps both bounds; no row if none does."""
    return results.where((F.col("fpr") <= ceiling) & (F.col("recall") >= floor)).orderBy("threshold").limit(1)


def best_available(results: DataFrame, floor: float = RECALL_FLOOR) -> DataFrame:
    """Lowest false-positive rate among rows that keep recall (then the lowest threshold); else the best recall, then the lowest rate."""
    keeps = F.col("recall") >= floor
    order = [F.when(keeps, 0).otherwise(1), F.when(keeps, F.col("fpr")).otherwise(-F.col("recall")), F.when(keeps, F.col("threshold")).otherwise(F.col("fpr")), "threshold"]
    return results.orderBy(*order).limit(1)


def frame_spikes(wide: DataFrame, z: float = SPIKE_Z) -> DataFrame:
    """(traj_id, frame, z, spike): the largest z of any joint's absolute acceleration within its trajectory."""
    n, whole = joint_count(wide), Window.partitionBy("traj_id")
    k = kinetics(wide)
    size = {f"m{j}": F.abs(f"a{j}") for j in range(n)}
    k = k.withColumns(size)
    zs = [(F.col(f"m{j}") - F.avg(f"m{j}").over(whole)) / F.greatest(F.stddev_pop(f"m{j}").over(whole), F.lit(SPIKE_STD_FLOOR)) for j in range(n)]
    top = F.greatest(*zs) if n > 1 else zs[0]
    return k.select("traj_id", "frame", top.alias("z")).withColumn("spike", rounded("z", 6) > z)


def stuck_runs(wide: DataFrame, frames: int = STUCK_FRAMES) -> DataFrame:
    """(traj_id, joint, first, last, length) of every run of at least ``frames`` frames without movement."""
    cells = melt(kinetics(wide), ("v",)).where(F.abs("v") < STUCK_SPEED)
    island = F.col("frame") - F.row_number().over(Window.partitionBy("traj_id", "joint").orderBy("frame"))
    runs = cells.withColumn("island", island).groupBy("traj_id", "joint", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= frames).drop("island")


def frame_anomalies(wide: DataFrame, z: float = SPIKE_Z, frames: int = STUCK_FRAMES) -> DataFrame:
    """(traj_id, frame, spike, stuck) of every frame that is either."""
    spikes = frame_spikes(wide, z).where("spike").select("traj_id", "frame", F.lit(1).alias("s"), F.lit(0).alias("f"))
    still = stuck_runs(wide, frames).select("traj_id", F.explode(F.sequence("first", "last")).alias("frame")).select("traj_id", "frame", F.lit(0).alias("s"), F.lit(1).alias("f"))
    both = spikes.unionAll(still).groupBy("traj_id", "frame").agg(F.max("s").alias("s"), F.max("f").alias("f"))
    return both.select("traj_id", "frame", (F.col("s") == 1).alias("spike"), (F.col("f") == 1).alias("stuck"))


def precision_recall(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(tp, fp, fn, precision, recall); denominators are at least 1."""
    t, p = F.col(truth), F.col(predicted)
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return c.withColumns({"precision": F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))})
