"""Queries on trajectories: frames, kinetics, tokens, spectra, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions.columns import rounded
from kinetrace.operators import anomaly, frames, spectral, tokens
from kinetrace.plans.registry import EVENTS_SQL, FLEET_SQL, HIST_SQL, KINETICS_SQL, PATHS_SQL, STEPS_SQL, SUPPLIER_JOINTS, SUPPLIER_SQL, TOKENS_SQL, query, table


def events(spark: SparkSession, d: str) -> DataFrame:
    return frames.wide_frames(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["value"])


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return frames.wide_frames(table(spark, d, "lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], SUPPLIER_JOINTS)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return frames.wide_frames(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"])


def paths(spark: SparkSession, d: str) -> DataFrame:
    return frames.embedding_frames(table(spark, d, "embeddings"), "vec_id", "embedding", 2)


CUSTOMERS_SQL = "f AS (SELECT o_custkey AS traj_id, 0 AS joint, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame, o_totalprice AS x FROM orders)"


@query(
    "frames_validate",
    f"""WITH {CUSTOMERS_SQL}
SELECT traj_id, count(*) AS frames, 1 AS joints, CASE WHEN count(*) < 8 THEN 'too_few_frames' WHEN count(*) FILTER (NOT isfinite(x)) > 0 THEN 'non_finite' ELSE 'ok' END AS status FROM f GROUP BY traj_id""",
)
def frames_validate(spark: SparkSession, d: str) -> DataFrame:
    return frames.validate(frames.melt(customers(spark, d)))


@query("frame_velocity_accel", f"WITH {SUPPLIER_SQL}, {KINETICS_SQL} SELECT traj_id, joint, frame, round(v, 6) + 0.0 AS v, round(a, 6) + 0.0 AS a FROM k")
def frame_velocity_accel(spark: SparkSession, d: str) -> DataFrame:
    k = frames.melt(frames.kinetics(suppliers(spark, d)), ("v", "a"))
    return k.select("traj_id", "joint", "frame", rounded("v", 6).alias("v"), rounded("a", 6).alias("a"))


@query("fast_tokens", f"WITH {EVENTS_SQL}, {KINETICS_SQL}, {TOKENS_SQL} SELECT traj_id, joint, frame, token FROM t")
def fast_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.joint_tokens(events(spark, d))


@query("fast_tokens_multi_joint", f"WITH {SUPPLIER_SQL}, {KINETICS_SQL}, {TOKENS_SQL} SELECT traj_id, joint, frame, token FROM t")
def fast_tokens_multi_joint(spark: SparkSession, d: str) -> DataFrame:
    return tokens.joint_tokens(suppliers(spark, d))


@query("fast_token_histogram", f"WITH {SUPPLIER_SQL}, {KINETICS_SQL}, {TOKENS_SQL}, {HIST_SQL} SELECT traj_id, joint, token, round(freq, 6) AS freq FROM h")
def fast_token_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = tokens.token_histogram(tokens.joint_tokens(suppliers(spark, d)))
    return h.select("traj_id", "joint", "token", rounded("freq", 6).alias("freq"))


@query("path_tokens", f"WITH {PATHS_SQL}, {STEPS_SQL} SELECT traj_id, frame, direction, token FROM pt")
def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.path_tokens(paths(spark, d))


@query(
    "direction_histogram",
    f"""WITH {PATHS_SQL}, {STEPS_SQL}
SELECT b.traj_id, w.direction, round((SELECT count(*) FROM pt WHERE pt.traj_id = b.traj_id AND pt.direction = w.direction) / b.n, 6) AS freq
FROM (SELECT traj_id, count(*)::DOUBLE AS n FROM pt GROUP BY traj_id) b CROSS JOIN (SELECT unnest(range(0, 8))::INTEGER AS direction) w""",
)
def direction_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = tokens.dense_histogram(tokens.path_tokens(paths(spark, d)), ["traj_id"], "direction", 8, "direction")
    return h.select("traj_id", "direction", rounded("freq", 6).alias("freq"))


@query(
    "token_export",
    f"""WITH {EVENTS_SQL}, {KINETICS_SQL}, {TOKENS_SQL}
SELECT traj_id, string_agg(token::VARCHAR, ',' ORDER BY frame) AS tokens, count(*) AS n_frames, 'joint_0' AS joint_names FROM t GROUP BY traj_id""",
)
def token_export(spark: SparkSession, d: str) -> DataFrame:
    e = tokens.export_tokens(events(spark, d))
    flat = F.concat_ws(",", F.transform(F.flatten("tokens"), lambda t: t.cast("string")))
    return e.select("traj_id", flat.alias("tokens"), F.size("timestamps").cast("bigint").alias("n_frames"), F.concat_ws(",", "joint_names").alias("joint_names"))


@query(
    "action_tokens",
    """WITH d AS (SELECT vec_id AS traj_id, embedding[i + 1]::DOUBLE - embedding[i]::DOUBLE AS d FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding))) AS i FROM embeddings)),
q AS (SELECT traj_id, quantile_cont(abs(d), 0.33::DOUBLE) AS q1, quantile_cont(abs(d), 0.66::DOUBLE) AS q2, count(*)::DOUBLE AS n FROM d GROUP BY traj_id),
t AS (SELECT traj_id, (sign(d) + 1) * 3 + (abs(d) >= q1)::INTEGER + (abs(d) >= q2)::INTEGER AS token FROM d JOIN q USING (traj_id)),
c AS (SELECT traj_id, token, count(*) AS c FROM t GROUP BY ALL)
SELECT q.traj_id, w.token, round(coalesce(c.c, 0) / q.n, 6) AS freq FROM q CROSS JOIN (SELECT unnest(range(0, 9))::INTEGER AS token) w LEFT JOIN c ON c.traj_id = q.traj_id AND c.token = w.token""",
)
def action_tokens(spark: SparkSession, d: str) -> DataFrame:
    h = tokens.action_tokens(table(spark, d, "embeddings"), "vec_id", "embedding")
    return h.select("traj_id", "token", rounded("freq", 6).alias("freq"))


@query(
    "action_value_histogram",
    """WITH x AS (SELECT vec_id AS traj_id, least(15, floor((least(greatest(x::DOUBLE, -2.5), 2.5) + 2.5) / 0.3125))::INTEGER AS bin FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)),
c AS (SELECT traj_id, bin, count(*) AS c FROM x GROUP BY ALL), n AS (SELECT traj_id, count(*)::DOUBLE AS n FROM x GROUP BY ALL)
SELECT n.traj_id, w.bin, round(coalesce(c.c, 0) / n.n, 6) AS freq FROM n CROSS JOIN (SELECT unnest(range(0, 16))::INTEGER AS bin) w LEFT JOIN c ON c.traj_id = n.traj_id AND c.bin = w.bin""",
)
def action_value_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = tokens.value_histogram(table(spark, d, "embeddings"), "vec_id", "embedding")
    return h.select("traj_id", "bin", rounded("freq", 6).alias("freq"))


@query(
    "naive_grid_hist",
    f"""WITH {PATHS_SQL}, g AS (SELECT traj_id, (greatest(0, least(7, floor((x0 + 2) / 0.5))) * 8 + greatest(0, least(7, floor((x1 + 2) / 0.5))))::INTEGER AS cell FROM p),
c AS (SELECT traj_id, cell, count(*) AS c FROM g GROUP BY ALL), n AS (SELECT traj_id, count(*)::DOUBLE AS n FROM g GROUP BY ALL)
SELECT n.traj_id, w.cell, round(coalesce(c.c, 0) / n.n, 6) AS freq FROM n CROSS JOIN (SELECT unnest(range(0, 64))::INTEGER AS cell) w LEFT JOIN c ON c.traj_id = n.traj_id AND c.cell = w.cell""",
)
def naive_grid_hist(spark: SparkSession, d: str) -> DataFrame:
    h = tokens.grid_histogram(paths(spark, d))
    return h.select("traj_id", "cell", rounded("freq", 6).alias("freq"))


@query(
    "resample_linear",
    f"""WITH {EVENTS_SQL}, n AS (SELECT traj_id, count(*) AS n FROM f GROUP BY traj_id),
g AS (SELECT traj_id, n, t, t * (n - 1) / 63.0::DOUBLE AS pos FROM n CROSS JOIN (SELECT unnest(range(0, 64)) AS t))
SELECT g.traj_id, t AS frame, round(a.x + (pos - floor(pos)) * (coalesce(b.x, a.x) - a.x), 6) + 0.0 AS x
FROM g JOIN f a ON a.traj_id = g.traj_id AND a.frame = floor(pos) LEFT JOIN f b ON b.traj_id = g.traj_id AND b.frame = floor(pos) + 1""",
)
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    r = frames.resample(events(spark, d), 64)
    return r.select("traj_id", "frame", rounded("x0", 6).alias("x"))


@query(
    "pad_truncate",
    f"""WITH {CUSTOMERS_SQL}, n AS (SELECT traj_id, count(*) AS n FROM f GROUP BY traj_id)
SELECT n.traj_id, t AS frame, f.x FROM n CROSS JOIN (SELECT unnest(range(0, 12)) AS t) JOIN f ON f.traj_id = n.traj_id AND f.frame = least(t, n - 1)""",
)
def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    return frames.pad_or_cut(customers(spark, d), 12).select("traj_id", "frame", F.col("x0").alias("x"))


@query(
    "window_slices",
    f"""WITH {SUPPLIER_SQL} SELECT traj_id, (frame // 256)::INTEGER AS slice, count(*) AS frames, round(avg(x), 4) AS mean_quantity FROM f WHERE joint = 0 AND frame // 256 < 12 GROUP BY ALL""",
)
def window_slices(spark: SparkSession, d: str) -> DataFrame:
    s = frames.slices(suppliers(spark, d), 256, 12)
    return s.groupBy("traj_id", "slice").agg(F.count("*").alias("frames"), rounded(F.avg("x0"), 4).alias("mean_quantity"))


_LINKS = [0.20, 0.15, 0.10, 0.05]
_FK_SQL = """w AS (SELECT traj_id, frame, max(CASE WHEN joint = 0 THEN {x} END) AS x0, max(CASE WHEN joint = 1 THEN {x} END) AS x1, max(CASE WHEN joint = 2 THEN {x} END) AS x2, max(CASE WHEN joint = 3 THEN {x} END) AS x3 FROM {src} GROUP BY ALL),
{name} AS (SELECT traj_id, frame,
  cos(x0) * 0.2::DOUBLE + cos(x0 + x1) * 0.15::DOUBLE + cos(x0 + x1 + x2) * 0.1::DOUBLE + cos(x0 + x1 + x2 + x3) * 0.05::DOUBLE AS ex,
  sin(x0) * 0.2::DOUBLE + sin(x0 + x1) * 0.15::DOUBLE + sin(x0 + x1 + x2) * 0.1::DOUBLE + sin(x0 + x1 + x2 + x3) * 0.05::DOUBLE AS ey,
  0.015::DOUBLE * (sin(x0) + sin(x2)) AS ez FROM w)"""


@query("fk_end_effector", f"WITH {SUPPLIER_SQL}, {_FK_SQL.format(x='x', src='f', name='e')} SELECT traj_id, frame, round(ex, 6) + 0.0 AS ex, round(ey, 6) + 0.0 AS ey, round(ez, 6) + 0.0 AS ez FROM e")
def fk_end_effector(spark: SparkSession, d: str) -> DataFrame:
    e = frames.end_effector(suppliers(spark, d), _LINKS)
    return e.select("traj_id", "frame", *[rounded(c, 6).alias(c) for c in ("ex", "ey", "ez")])


_PATH_LONG_SQL = """f AS (SELECT traj_id, 0 AS joint, frame, x0 AS x FROM p UNION ALL SELECT traj_id, 1, frame, x1 FROM p)"""


def dft_sql(keep: int) -> str:
    return f"""nn AS (SELECT *, count(*) OVER (PARTITION BY traj_id, joint) AS n FROM f),
c AS (SELECT traj_id, joint, n, k::INTEGER AS k, sum(x * cos(2 * pi() * k * frame / n)) AS re, -sum(x * sin(2 * pi() * k * frame / n)) AS im
  FROM nn CROSS JOIN (SELECT unnest(range(0, {keep})) AS k) WHERE k <= n // 2 GROUP BY ALL)"""


REC_SQL = """r AS (SELECT f.traj_id, f.joint, f.frame, any_value(f.x) AS x,
  sum((CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END) * (re * cos(2 * pi() * k * frame / n) - CASE WHEN k = 0 THEN 0 ELSE im * sin(2 * pi() * k * frame / n) END)) / any_value(n) AS y
  FROM f JOIN c USING (traj_id, joint) GROUP BY f.traj_id, f.joint, f.frame)"""


@query("spectral_coefficients", f"WITH {EVENTS_SQL}, {dft_sql(8)} SELECT traj_id, joint, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM c")
def spectral_coefficients(spark: SparkSession, d: str) -> DataFrame:
    c = spectral.coefficient_rows(frames.melt(events(spark, d)))
    return c.select("traj_id", "joint", "k", rounded("re", 5).alias("re"), rounded("im", 5).alias("im"))


@query(
    "spectral_reconstruction_rmse",
    f"""WITH {EVENTS_SQL}, {dft_sql(8)}, {REC_SQL} SELECT traj_id, round(sqrt(avg(degrees(x - y) ** 2)), 4) AS rmse_deg, round(max(abs(x - y)), 5) AS max_abs_error FROM r GROUP BY traj_id""",
)
def spectral_reconstruction_rmse(spark: SparkSession, d: str) -> DataFrame:
    q = spectral.fidelity(spectral.reconstruct(frames.melt(events(spark, d))))
    return q.select("traj_id", rounded("rmse_deg", 4).alias("rmse_deg"), rounded("max_abs_error", 5).alias("max_abs_error"))


@query(
    "fk_rmse_mm",
    f"""WITH {PATHS_SQL}, {_PATH_LONG_SQL}, {dft_sql(8)}, {REC_SQL},
w AS (SELECT traj_id, frame, max(CASE WHEN joint = 0 THEN x END) AS x0, max(CASE WHEN joint = 1 THEN x END) AS x1, max(CASE WHEN joint = 0 THEN y END) AS y0, max(CASE WHEN joint = 1 THEN y END) AS y1 FROM r GROUP BY ALL),
e AS (SELECT traj_id, (cos(x0) - cos(y0)) * 0.2 + (cos(x0 + x1) - cos(y0 + y1)) * 0.05 AS dx, (sin(x0) - sin(y0)) * 0.2 + (sin(x0 + x1) - sin(y0 + y1)) * 0.05 AS dy, 0.015 * (sin(x0) - sin(y0)) AS dz FROM w)
SELECT traj_id, round(1000 * sqrt(avg((dx * dx + dy * dy + dz * dz) / 3)), 4) AS ee_rmse_mm FROM e GROUP BY traj_id""",
)
def fk_rmse_mm(spark: SparkSession, d: str) -> DataFrame:
    """End-effector error of reconstructed two-joint paths."""
    r = spectral.reconstruct(frames.melt(paths(spark, d)))
    cell = lambda c, j: F.max(F.when(F.col("joint") == j, F.col(c)))
    both = r.groupBy("traj_id", "frame").agg(*[cell(c, j).alias(f"{c}{j}") for c in ("x", "y") for j in (0, 1)])
    tip = lambda c: frames.end_effector(both.select("traj_id", "frame", F.col(f"{c}0").alias("x0"), F.col(f"{c}1").alias("x1")))
    back = tip("y").select("traj_id", "frame", *[F.col(c).alias("r" + c) for c in ("ex", "ey", "ez")])
    gap = sum((F.pow(F.col(c) - F.col("r" + c), F.lit(2.0)) for c in ("ex", "ey", "ez")), F.lit(0.0)) / 3
    return tip("x").join(back, ["traj_id", "frame"]).groupBy("traj_id").agg(rounded(1000 * F.sqrt(F.avg(gap)), 4).alias("ee_rmse_mm"))


@query(
    "spectral_features",
    f"""WITH {PATHS_SQL}, {_PATH_LONG_SQL}, {dft_sql(10)},
u AS (SELECT traj_id, joint * 20 + k AS i, re AS v FROM c UNION ALL SELECT traj_id, joint * 20 + 10 + k, im FROM c)
SELECT traj_id, i::INTEGER AS i, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY traj_id)), 1e-12), 6) + 0.0 AS value FROM u""",
)
def spectral_features(spark: SparkSession, d: str) -> DataFrame:
    return spectral.spectral_features(paths(spark, d)).select("traj_id", "i", rounded("value", 6).alias("value"))


@query(
    "header_derived_fields",
    f"""WITH {SUPPLIER_SQL}, c AS (SELECT traj_id, count(*) AS frames, 4 AS joints FROM f WHERE joint = 0 GROUP BY traj_id)
SELECT traj_id, frames, joints, frames // 2 + 1 AS bins, least(8, frames // 2 + 1) AS keep, least(8, frames // 2 + 1) * 8 AS payload_values, frames * 16 AS raw_bytes, 18 + least(8, frames // 2 + 1) * 32 AS packed_bytes,
  CASE WHEN frames < 8 THEN 'frames < 8' ELSE 'ok' END AS status FROM c""",
)
def header_derived_fields(spark: SparkSession, d: str) -> DataFrame:
    return spectral.archive_sizes(suppliers(spark, d))


@query(
    "header_checks",
    f"""WITH {CUSTOMERS_SQL}, c AS (SELECT traj_id, count(*) AS frames FROM f GROUP BY traj_id)
SELECT traj_id, frames, frames // 2 + 1 AS bins, least(8, frames // 2 + 1) AS keep, CASE WHEN frames < 8 THEN 'frames < 8' ELSE 'ok' END AS status FROM c""",
)
def header_checks(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer are mostly too few for a packet: the checks say which."""
    return spectral.archive_sizes(customers(spark, d)).select("traj_id", "frames", "bins", "keep", "status")


@query(
    "archive_ratio",
    f"""WITH {CUSTOMERS_SQL}, n AS (SELECT traj_id, count(*) AS frames FROM f GROUP BY traj_id)
SELECT count(*) AS files, sum(frames * 4)::BIGINT AS raw_bytes, sum(18 + least(8, frames // 2 + 1) * 8)::BIGINT AS packed_bytes, round(sum(frames * 4) / greatest(1, sum(18 + least(8, frames // 2 + 1) * 8)), 6) AS ratio FROM n WHERE frames >= 8""",
)
def archive_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of the sums over all trajectories that are long enough, not the mean of ratios."""
    s = spectral.archive_sizes(customers(spark, d)).where("status = 'ok'")
    total = s.agg(F.count("*").alias("files"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("packed_bytes").alias("packed_bytes"))
    return total.withColumn("ratio", rounded(F.col("raw_bytes") / F.greatest(F.lit(1), F.col("packed_bytes")), 6))


_SCORES_SQL = f"WITH {SUPPLIER_SQL}, {KINETICS_SQL}, {TOKENS_SQL}, {HIST_SQL}, {FLEET_SQL}"


def fleet_scores(spark: SparkSession, d: str) -> DataFrame:
    # fit and scores read one exchange: without it (and with the filter, which a join adds to one side only) all tokens would be made twice
    h = tokens.token_histogram(tokens.joint_tokens(suppliers(spark, d).where("traj_id is not null"))).repartition("traj_id", "joint")
    return anomaly.score_fleet(h, anomaly.fit_fleet(h)).withColumn("score", rounded("score", 6))


@query("fleet_model", f"{_SCORES_SQL} SELECT joint, token, round(mean, 6) AS mean, round(std, 6) AS std FROM fm")
def fleet_model(spark: SparkSession, d: str) -> DataFrame:
    m = anomaly.fit_fleet(tokens.token_histogram(tokens.joint_tokens(suppliers(spark, d))))
    return m.select("joint", "token", rounded("mean", 6).alias("mean"), rounded("std", 6).alias("std"))


@query("fleet_anomaly_score", f"{_SCORES_SQL} SELECT traj_id, score, score > 3.22 AS flagged FROM sc")
def fleet_anomaly_score(spark: SparkSession, d: str) -> DataFrame:
    return fleet_scores(spark, d).withColumn("flagged", F.col("score") > anomaly.THRESHOLD)


@query(
    "fleet_minus_query",
    f"""WITH {EVENTS_SQL}, {KINETICS_SQL}, {TOKENS_SQL}, {HIST_SQL}, one AS (SELECT min(traj_id) AS q FROM h),
fm AS (SELECT joint, token, avg(freq) AS mean, greatest(stddev_pop(freq), 1e-6) AS std FROM h, one WHERE traj_id <> q GROUP BY ALL)
SELECT h.traj_id, round(3 * sqrt(avg(((freq - mean) / std) ** 2)), 5) AS score, round(3 * sqrt(avg(((freq - mean) / std) ** 2)), 5) > 3.0 AS flagged FROM h JOIN one ON h.traj_id = q JOIN fm USING (joint, token) GROUP BY h.traj_id""",
)
def fleet_minus_query(spark: SparkSession, d: str) -> DataFrame:
    """One trajectory against the model of all the others."""
    h = tokens.token_histogram(tokens.joint_tokens(events(spark, d)))
    asked = h.agg(F.min("traj_id").alias("q"))
    rest = h.join(asked, h["traj_id"] == asked["q"], "left_anti")
    scored = anomaly.score_fleet(h.join(asked, h["traj_id"] == asked["q"], "left_semi"), anomaly.fit_fleet(rest))
    return scored.select("traj_id", rounded("score", 5).alias("score")).withColumn("flagged", F.col("score") > anomaly.BASELINE)


_SWEEP_SQL = f"""{_SCORES_SQL}, l AS (SELECT score, s_acctbal < 0 AS bad FROM sc JOIN supplier ON s_suppkey = traj_id), th AS (SELECT round(3.0 + i * 0.01, 2)::DOUBLE AS threshold FROM (SELECT unnest(range(0, 101)) AS i)),
sw AS (SELECT threshold, count(*) FILTER (NOT bad AND score > threshold) AS false_positives, count(*) FILTER (bad AND score > threshold) AS true_positives,
  count(*) FILTER (bad AND score <= threshold) AS false_negatives, count(*) FILTER (NOT bad AND score <= threshold) AS true_negatives,
  round(count(*) FILTER (NOT bad AND score > threshold) / greatest(1, count(*) FILTER (NOT bad)), 6) AS fpr, round(count(*) FILTER (bad AND score > threshold) / greatest(1, count(*) FILTER (bad)), 6) AS recall
  FROM l CROSS JOIN th GROUP BY threshold)"""


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "supplier").select(F.col("s_suppkey").alias("traj_id"), (F.col("s_acctbal") < 0).alias("anomalous"))
    s = anomaly.sweep(fleet_scores(spark, d).join(bad, "traj_id").select("score", "anomalous"), anomaly.threshold_grid(spark))
    return s.withColumns({"fpr": rounded("fpr", 6), "recall": rounded("recall", 6)})


@query("anomaly_threshold_sweep", f"{_SWEEP_SQL} SELECT * FROM sw")
def anomaly_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d)


@query("anomaly_threshold_choice", f"{_SWEEP_SQL} SELECT * FROM sw WHERE fpr <= 0.55 AND recall >= 0.2 ORDER BY threshold LIMIT 1")
def anomaly_threshold_choice(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.choose(_sweep(spark, d), 0.55, 0.2)


@query(
    "anomaly_best_available",
    f"""{_SWEEP_SQL} SELECT * FROM sw ORDER BY CASE WHEN recall >= 0.9 THEN 0 ELSE 1 END, CASE WHEN recall >= 0.9 THEN fpr ELSE -recall END, CASE WHEN recall >= 0.9 THEN threshold ELSE fpr END, threshold LIMIT 1""",
)
def anomaly_best_available(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.best_available(_sweep(spark, d))


_SPIKES_SQL = f"""WITH {SUPPLIER_SQL}, {KINETICS_SQL},
z AS (SELECT traj_id, frame, joint, (abs(a) - avg(abs(a)) OVER j) / greatest(stddev_pop(abs(a)) OVER j, 1e-9) AS z FROM k WINDOW j AS (PARTITION BY traj_id, joint)),
sp AS (SELECT traj_id, frame, round(max(z), 6) + 0.0 AS z FROM z GROUP BY ALL)"""
_STUCK_SQL = """i AS (SELECT traj_id, joint, frame, frame - row_number() OVER (PARTITION BY traj_id, joint ORDER BY frame) AS island FROM k WHERE abs(v) < 1e-14),
st AS (SELECT traj_id, joint, min(frame) AS first, max(frame) AS last, count(*) AS length FROM i GROUP BY traj_id, joint, island HAVING count(*) >= 5)"""
_FRAMES_SQL = f"""{_SPIKES_SQL}, {_STUCK_SQL},
u AS (SELECT traj_id, frame, true AS spike, false AS stuck FROM sp WHERE z > 3.5 UNION ALL SELECT traj_id, unnest(range(first, last + 1)) AS frame, false, true FROM st),
fa AS (SELECT traj_id, frame, bool_or(spike) AS spike, bool_or(stuck) AS stuck FROM u GROUP BY ALL)"""


@query("frame_spikes", f"{_SPIKES_SQL} SELECT traj_id, frame, round(z, 4) + 0.0 AS z, z > 3.5 AS spike FROM sp")
def frame_spikes(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.frame_spikes(suppliers(spark, d)).withColumn("z", rounded(rounded("z", 6), 4))


@query("stuck_runs", f"WITH {SUPPLIER_SQL}, {KINETICS_SQL}, {_STUCK_SQL} SELECT * FROM st")
def stuck_runs(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.stuck_runs(suppliers(spark, d))


@query("frame_anomalies", f"{_FRAMES_SQL} SELECT * FROM fa")
def frame_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.frame_anomalies(suppliers(spark, d))


@query(
    "precision_recall_frames",
    f"""{_FRAMES_SQL}, tr AS (SELECT l_suppkey AS traj_id, frame, l_returnflag = 'R' AS truth FROM n),
b AS (SELECT truth, fa.traj_id IS NOT NULL AS p FROM tr LEFT JOIN fa USING (traj_id, frame)),
c AS (SELECT count(*) FILTER (truth AND p) AS tp, count(*) FILTER (NOT truth AND p) AS fp, count(*) FILTER (truth AND NOT p) AS fn FROM b)
SELECT tp, fp, fn, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall FROM c""",
)
def precision_recall_frames(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("bad", (F.col("l_returnflag") == "R").cast("double"))
    truth = frames.wide_frames(li, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], ["bad"]).select("traj_id", "frame", (F.col("x0") == 1).alias("truth"))
    found = anomaly.frame_anomalies(suppliers(spark, d)).select("traj_id", "frame", F.lit(True).alias("p"))
    both = truth.join(found, ["traj_id", "frame"], "left").select("truth", F.coalesce("p", F.lit(False)).alias("predicted"))
    return anomaly.precision_recall(both).withColumns({c: rounded(c, 6) for c in ("precision", "recall")})
