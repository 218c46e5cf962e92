"""Streaming surface, an extension: there is nothing batch-incompatible about frames that arrive one by one.

``live_kinetics`` carries the last value, velocity and still-run length of each (trajectory, joint) across micro-batches,
so velocities, accelerations and stuck joints come out as the batch operators would give them for frames in order. Token cuts are whole-
trajectory quantiles and can't be had incrementally: ``live_tokens`` takes fixed cuts, fitted beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetrace.functions.columns import bin_of, octant
from kinetrace.operators.anomaly import STUCK_FRAMES, STUCK_SPEED

#: A trajectory that is silent for so long after the watermark is forgotten.
IDLE_MS = 3_600_000
#: Files that a micro-batch takes at most.
FILES_A_BATCH = 64
_OUT = "traj_id bigint, joint int, frame bigint, x double, v double, a double, still int, stuck boolean"
_STATE = "x double, v double, still int, frame bigint"


def read_frames(spark: SparkSession, folder: str, max_files: int = FILES_A_BATCH) -> DataFrame:
    """Stream of long frames with event time: (traj_id, joint, frame, x, ts) from Parquet files as they appear."""
    return spark.readStream.schema("traj_id bigint, joint int, frame bigint, x double, ts timestamp").option("maxFilesPerTrigger", max_files).parquet(folder)


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    frame, x = (np.concatenate(cells) for cells in zip(*[(p["frame"].to_numpy(), p["x"].to_numpy()) for p in parts], strict=True))
    if (frame[1:] < frame[:-1]).any():
        order = np.argsort(frame, kind="stable")
        frame, x = frame[order], x[order]
    last = state.get if state.exists else None
    if last:  # frames that come after later ones were handled are dropped
        fresh = frame > last[3]
        frame, x = frame[fresh], x[fresh]
    if not len(frame):
        return
    start, speed, run = (last[0], last[1], last[2]) if last else (x[0], None, 0)
    v = np.round(np.diff(x, prepend=start), 9) + 0.0
    a = np.round(np.diff(v, prepend=v[0] if speed is None else speed), 9) + 0.0
    at = np.arange(len(x))
    moved = np.maximum.accumulate(np.where(np.abs(v) < STUCK_SPEED, -1, at))  # the last frame with movement, -1 before the first
    still = np.where(moved < 0, at + 1 + run, at - moved).astype(np.int32)
    state.update((float(x[-1]), float(v[-1]), int(still[-1]), int(frame[-1])))
    state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + IDLE_MS)
    yield pd.DataFrame({"traj_id": key[0], "joint": key[1], "frame": frame, "x": x, "v": v, "a": a, "still": still, "stuck": still >= STUCK_FRAMES}, copy=False)


def live_kinetics(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(traj_id, joint, frame, x, v, a, still, stuck): ``still`` counts the frames without movement so far."""
    return frames.withWatermark("ts", late).groupBy("traj_id", "joint").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_tokens(kinetic: DataFrame, cuts: tuple[float, float]) -> DataFrame:
    """Adds the token of each cell under fixed magnitude cuts; stateless."""
    m = F.sqrt(F.col("v") * F.col("v") + F.col("a") * F.col("a"))
    return kinetic.withColumn("token", (octant(F.col("v"), F.col("a")) * 3 + bin_of(m, [F.lit(c) for c in cuts])).cast("int"))


def activity(frames: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(traj_id, start, frames, mean_x) per event-time window; rows later than ``late`` are dropped."""
    per = frames.withWatermark("ts", late).groupBy("traj_id", F.window("ts", window)).agg(F.count("*").alias("frames"), F.avg("x").alias("mean_x"))
    return per.select("traj_id", F.col("window.start").alias("start"), "frames", "mean_x")


def score_stream(histograms: DataFrame, model: DataFrame) -> DataFrame:
    """Stream-static join of finished trajectories' histogram cells with the fitted fleet model: squared z of every cell."""
    return histograms.join(model, ["joint", "token"]).withColumn("z2", F.pow((F.col("freq") - F.col("mean")) / F.col("std"), F.lit(2.0)))
