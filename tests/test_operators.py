"""Operators against small NumPy statements of the same definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrace import fixtures
from kinetrace.functions.columns import bin_of, fixed_bins, octant, octant_atan2, rounded
from kinetrace.operators import anomaly, datasets, evaluation, frames, reports, search, spectral, tokens
from kinetrace.sources import wire


@pytest.fixture(scope="module")
def arm():
    return [fixtures.joint_trajectory(128, 3, s) for s in range(4)]


@pytest.fixture(scope="module")
def wide(spark, arm):
    return fixtures.wide_table(spark, arm).cache()


def np_tokens(x):
    v = np.diff(x, axis=0, prepend=x[:1])
    a = np.diff(v, axis=0, prepend=v[:1])
    turn = np.floor((np.arctan2(a, v) + np.pi) / (2 * np.pi) * 8).astype(int) % 8
    m = np.sqrt(v * v + a * a)
    cuts = np.quantile(m, [0.33, 0.66])
    return turn * 3 + (m >= cuts[0]) + (m >= cuts[1])


def test_rounding_is_half_away_from_zero_without_negative_zero(spark):
    xs = [0.0015625, -0.0015625, -1e-18, 2.5, 1e17, -7.25]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(rounded("x", 6)).collect()]
    assert got == [0.001563, -0.001563, 0.0, 2.5, 1e17, -7.25] and str(got[2]) == "0.0"


def test_octants_agree_with_the_angle(spark):
    rng = np.random.default_rng(0)
    pts = [(float(a), float(b)) for a, b in rng.normal(size=(500, 2))] + [(x, y) for x in (-1.0, 0.0, 1.0) for y in (-1.0, 0.0, 1.0)]
    rows = spark.createDataFrame(pts, "x double, y double").select(octant(F.col("x"), F.col("y")).alias("a"), octant_atan2(F.col("x"), F.col("y")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_bins(spark):
    df = spark.createDataFrame([(-9.0,), (-2.5,), (0.0,), (2.4999,), (2.5,), (9.0,)], "x double")
    assert [r[0] for r in df.select(fixed_bins(F.col("x"), -2.5, 2.5, 16)).collect()] == [0, 0, 8, 15, 15, 15]
    assert [r[0] for r in df.select(bin_of(F.col("x"), [F.lit(0.0), F.lit(2.5)])).collect()] == [0, 0, 1, 1, 2, 2]


def test_joint_tokens(spark, wide, arm):
    got = {(r["traj_id"], r["joint"], r["frame"]): r["token"] for r in tokens.joint_tokens(wide, exact=True).collect()}
    for t, x in enumerate(arm):
        want = np_tokens(x)
        assert np.mean([got[t, j, f] == want[f, j] for f in range(128) for j in range(3)]) > 0.995
    assert set(got.values()) <= set(range(24))


def test_histograms_are_dense_and_sum_to_one(spark, wide):
    h = tokens.token_histogram(tokens.joint_tokens(wide)).groupBy("traj_id", "joint").agg(F.count("*").alias("n"), F.sum("freq").alias("s")).collect()
    assert len(h) == 12 and all(r["n"] == 24 and abs(r["s"] - 1) < 1e-9 for r in h)


def test_spectrum_equals_the_fft(spark, wide, arm):
    got = {(r["traj_id"], r["joint"], r["k"]): complex(r["re"], r["im"]) for r in spectral.coefficient_rows(frames.melt(wide)).collect()}
    for t, x in enumerate(arm):
        f = np.fft.rfft(x, axis=0)
        assert all(abs(got[t, j, k] - f[k, j]) < 1e-9 for j in range(3) for k in range(8))


@pytest.mark.parametrize("n, keep", [(8, 8), (9, 8), (16, 4), (10, 99)])
def test_reconstruction_equals_the_inverse_fft(spark, n, keep):
    x = np.random.default_rng(n).normal(size=(n, 2))
    rows = spectral.reconstruct(frames.melt(fixtures.wide_table(spark, [x])), min(keep, 12)).collect()
    s = np.fft.rfft(x, axis=0)
    s[keep:] = 0
    want = np.fft.irfft(s, n=n, axis=0)
    assert all(abs(r["y"] - want[r["frame"], r["joint"]]) < 1e-9 for r in rows) and len(rows) == 2 * n


def test_harmonics_survive_compression_and_steps_do_not(spark, wide):
    good = spectral.fidelity(spectral.reconstruct(frames.melt(wide))).collect()
    assert all(r["rmse_deg"] < 0.05 for r in good)
    step = np.repeat([[0.0], [1.0]], 64, axis=0)
    assert spectral.fidelity(spectral.reconstruct(frames.melt(fixtures.wide_table(spark, [step])))).first()["max_abs_error"] > 0.1


def test_resample_pad_and_slices(spark):
    x = np.array([[0.0], [1.0], [4.0]])
    w = fixtures.wide_table(spark, [x, np.array([[7.0]])])
    got = {(r["traj_id"], r["frame"]): r["x0"] for r in frames.resample(w, 5).collect()}
    assert [got[0, f] for f in range(5)] == [0.0, 0.5, 1.0, 2.5, 4.0] and [got[1, f] for f in range(5)] == [7.0] * 5
    long = np.random.default_rng(3).normal(size=(101, 1))
    down = [r["x0"] for r in frames.resample(fixtures.wide_table(spark, [long]), 17).orderBy("frame").collect()]
    assert np.allclose(down, np.interp(np.linspace(0, 1, 17), np.linspace(0, 1, 101), long[:, 0]))
    padded = [r["x0"] for r in frames.pad_or_cut(w.where("traj_id = 0"), 10).orderBy("frame").collect()]
    assert padded == [0.0, 1.0] + [4.0] * 8
    assert frames.pad_or_cut(w.where("traj_id = 0"), 2).count() == frames.MIN_FRAMES
    assert frames.slices(fixtures.wide_table(spark, [long]), 25, 2).count() == 50


def test_kinematics(spark, wide, arm):
    links = np.linspace(0.20, 0.05, 3)
    rows = {(r["traj_id"], r["frame"]): (r["ex"], r["ey"], r["ez"]) for r in frames.end_effector(wide).collect()}
    c = np.cumsum(arm[1], axis=1)
    want = np.column_stack([(np.cos(c) * links).sum(1), (np.sin(c) * links).sum(1), 0.015 * np.sin(arm[1][:, ::2]).sum(1)])
    assert all(np.allclose(rows[1, f], want[f]) for f in range(128))
    with pytest.raises(ValueError):
        frames.end_effector(wide, [1.0])


def test_validation_order(spark):
    rows = [(1, 0, f, 1.0) for f in range(3)] + [(2, 0, f, float("nan")) for f in range(8)] + [(3, j, f, 1.0) for f in range(8) for j in range(2) if (f, j) != (7, 1)] + [(4, 0, f, 1.0) for f in range(8)] + [(5, 0, f, None) for f in range(8)]
    got = {r["traj_id"]: r["status"] for r in frames.validate(spark.createDataFrame(rows, "traj_id bigint, joint int, frame bigint, x double")).collect()}
    assert got == {1: "too_few_frames", 2: "non_finite", 3: "ragged", 4: "ok", 5: "non_finite"}


def test_stuck_runs_start_at_frame_zero(spark):
    x = np.array([1.0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3])[:, None]
    assert [(r["first"], r["last"], r["length"]) for r in anomaly.stuck_runs(fixtures.wide_table(spark, [x])).collect()] == [(0, 4, 5), (9, 13, 5)]


def test_frame_detector_finds_injected_faults(spark):
    x, truth = fixtures.with_faults(fixtures.joint_trajectory(1024, 4, 3), 11)
    found = {r["frame"] for r in anomaly.frame_anomalies(fixtures.wide_table(spark, [x])).collect()}
    assert sum(f in found for f in np.flatnonzero(truth)) / truth.sum() >= 0.9


def test_fleet_flags_what_differs(spark):
    calm = [fixtures.joint_trajectory(512, 3, s) for s in range(20)]
    odd = fixtures.with_jumps(calm[0], 1, 18, 1.4)
    odd[128:384, 0] += 1.6
    odd[:, 1] *= -1
    h = tokens.token_histogram(tokens.joint_tokens(fixtures.wide_table(spark, [*calm, odd])))
    model = anomaly.fit_fleet(h.where("traj_id < 20"))
    score = {r["traj_id"]: r["score"] for r in anomaly.score_fleet(h, model).collect()}
    assert score[20] > max(v for k, v in score.items() if k < 20)


def test_sweep_and_choices(spark):
    rows = [(s / 100, False) for s in range(250, 350)] + [(s / 100, True) for s in range(315, 415, 10)]
    s = anomaly.sweep(spark.createDataFrame(rows, "score double, anomalous boolean"), anomaly.threshold_grid(spark)).cache()
    for r in s.collect():
        fp, tp = sum(a > r["threshold"] for a, b in rows if not b), sum(a > r["threshold"] for a, b in rows if b)
        assert (r["false_positives"], r["true_positives"], r["false_negatives"], r["true_negatives"]) == (fp, tp, 10 - tp, 100 - fp)
    assert anomaly.choose(s, 0.35, 0.9).first()["threshold"] == min(r["threshold"] for r in s.collect() if r["fpr"] <= 0.35 and r["recall"] >= 0.9)
    assert anomaly.choose(s, 0.0, 1.0).count() == 0
    assert anomaly.best_available(s, 0.9).first()["fpr"] == min(r["fpr"] for r in s.collect() if r["recall"] >= 0.9)
    worse = spark.createDataFrame([(3.0, 0.2, 0.5), (3.1, 0.1, 0.5), (3.2, 0.0, 0.4)], "threshold double, fpr double, recall double")
    assert anomaly.best_available(worse).first()["threshold"] == 3.1


def test_template_search_ranks_its_own_kind_first(spark):
    lib, _ = fixtures.primitives(20260243, 60, 24)
    stored = [wire.decode(wire.encode(p, 8)) for _, p in lib]  # as an archive would give them back
    index = search.features(fixtures.wide_table(spark, stored)).cache()
    found = search.template_search(index, search.features(search.prototype_frames(spark, search.LABELS[:5]))).collect()
    for t, label in enumerate(search.LABELS[:5]):
        hits = [lib[r["traj_id"]][0] for r in found if r["template"] == t]
        assert len(hits) == 10
        if label in ("reach", "push"):
            assert hits.count(label) >= 9
    with pytest.raises(ValueError):
        search.template_search(index, index, 0)
    with pytest.raises(ValueError):
        search.template_number("wave")
    short = search.features(fixtures.wide_table(spark, [p[:50] for _, p in lib[:2]]))
    with pytest.raises(Exception, match="resample"):
        search.template_search(short, search.features(search.prototype_frames(spark, search.LABELS[:5]))).collect()


def test_prefix_overlap(spark):
    df = spark.createDataFrame([("xxabcx", "abcd"), ("", "ab"), ("ab", ""), ("abab", "ab"), ("zzz", "ab")], "t string, q string")
    assert [r[0] for r in df.select(search.prefix_overlap(F.col("t"), F.col("q"))).collect()] == [0.75, 0.0, 0.0, 1.0, 0.0]


def test_neighbours_and_precision(spark):
    lib, ask = fixtures.primitives(20260243, 20, 5)

    def sig(p):
        c = p - p.mean(0)
        return (c / max(np.sqrt((c * c).sum(1).mean()), 1e-12)).ravel()

    df = lambda items, first: spark.createDataFrame([(first + i, sig(p).tolist(), search.LABELS.index(n)) for i, (n, p) in enumerate(items)], "id bigint, v array<double>, label int")
    near = search.nearest(df(lib, 0), df(ask, 1000), 10, "id", "v", "label")
    assert evaluation.precision_at_k(near, 10).first()["precision"] >= 0.9
    x, q = np.stack([sig(p) for _, p in lib]), np.stack([sig(p) for _, p in ask])
    d = ((q[:, None] - x[None]) ** 2).mean(-1)
    got = {(r["query"] - 1000, r["rank"]): r["traj_id"] for r in near.collect()}
    assert all(got[i, 1] == int(d[i].argmin()) for i in range(len(q)))


def test_split_and_classification(spark):
    rows = [(i, l, [float(l == k) + 0.1 * (i % 3) for k in range(3)]) for l in range(3) for i in range(l * 10, l * 10 + 7)]
    v = evaluation.split(spark.createDataFrame(rows, "id bigint, label int, vec array<double>"), "label", "id")
    assert v.where("is_train").count() == 3 * 4
    got = evaluation.classify(v.where("not is_train"), evaluation.centroids(v.where("is_train"), "label", "vec"), "id", "label", "vec")
    assert evaluation.accuracy(got, []).first()["accuracy"] == 1.0
    assert evaluation.split(v.select("id", "label", "vec").where("id < 2"), "label", "id", least=3).count() == 0


def test_dataset_rules(spark):
    rows = [("lab/real-arm", 3, 7, 14), ("lab/real_sim_arm", 3, 7, 14), ("lab/real-arm", 0, 7, 7), ("lab/real-arm", 2, 3, 5), ("lab/thing", 2, 8, None), ("lab/real", 1, None, None)]
    df = spark.createDataFrame(rows, "repo_id string, parquet_count bigint, state_width int, action_width int")
    got = [(r["reason"], r["selected_field"], r["joint_count"]) for r in datasets.qualify(df, 6).collect()]
    assert got == [("QUALIFIED", "observation.state", 7), ("NOT_REAL_DATASET", "observation.state", 7), ("NO_DATA_PARQUET", None, 0), ("INSUFFICIENT_JOINT_DIM_LT_6", "action", 5), ("NOT_REAL_DATASET", "observation.state", 8), ("INSUFFICIENT_JOINT_DIM_LT_6", None, 0)]


def test_file_plan(spark):
    files = [("meta/info.json", 10, True), ("data/a", 50, False), ("data/b", 40, False), ("data/c", 60, False), ("data/d", None, False)]
    df = spark.createDataFrame([("r", *f) for f in files], "repo string, path string, size bigint, is_info boolean")
    assert sorted(r["path"] for r in datasets.plan_files(df, ["repo"], 2, 250).collect()) == ["data/b", "data/d", "meta/info.json"]
    assert sorted(r["path"] for r in datasets.plan_files(df, ["repo"], 9, 110).collect()) == ["data/a", "data/b", "data/d", "meta/info.json"]


def test_spread_percentiles_and_regressions(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (2.0,), (float("nan"),)], "x double")
    r = reports.spread(df, [], ["x"]).first()
    assert (r["min"], r["median"], r["max"]) == (1.0, 2.0, 3.0)
    p = reports.percentiles(spark.createDataFrame([("a", float(i)) for i in range(1, 12)], "k string, x double"), ["k"], "x").first()
    assert (p["p50"], p["p95"], p["p50_rank"], p["p95_rank"]) == (6.0, 10.5, 6.0, 11.0)
    runs = spark.createDataFrame([("a", 10.0, 5.0), ("b", float("nan"), 1.0)], "id string, ratio double, ms double")
    bad = reports.regressions(runs, "id", {"ratio": F.lit(20.0), "ms": F.lit(4.0)}, {"ratio": False, "ms": True}).collect()
    assert sorted((r["id"], r["metric"], r["delta"]) for r in bad) == [("a", "ms", 1.0), ("a", "ratio", -10.0)]


def test_replay_hash_ignores_row_order(spark):
    df = spark.range(100).withColumn("g", F.lit(1))
    one = reports.replay_hash(df, ["g"], ["id"], F.col("id").cast("string"), F.floor(F.col("id") / 7)).first()["sha256"]
    two = reports.replay_hash(df.orderBy(F.desc("id")).repartition(3), ["g"], ["id"], F.col("id").cast("string"), F.floor(F.col("id") / 7)).first()["sha256"]
    assert one == two


def test_ranks_without_holding_a_group(spark):
    """Exact order statistics of skewed groups, many equal values, nulls and single rows among them."""
    import random
    from statistics import median

    rng = random.Random(3)
    values = {"a": [round(rng.gauss(0, 5), 1) for _ in range(3000)], "b": [1.0] * 500 + [2.0], "c": [7.0], "d": [rng.random() for _ in range(40)]}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("e", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in reports.percentiles(df, ["g"], "v").collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        s = sorted(vs)
        assert got[g]["n"] == len(s)
        for q, name in ((0.5, "p50"), (0.95, "p95")):
            assert abs(got[g][name] - np.quantile(s, q)) < 1e-9 and got[g][f"{name}_rank"] == s[int(np.rint((len(s) - 1) * q))]
    ranks = [(r["g"], r["median"]) for r in reports.rank_by_median(df, "g", "v").orderBy("rank").collect()]
    assert ranks == sorted(((g, median(vs)) for g, vs in values.items()), key=lambda x: (-x[1], x[0]))
    assert reports.percentiles(df, [], "v").first()["n"] == sum(map(len, values.values()))


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from kinetrace import session

    made = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(made)


def test_one_exchange_serves_windows_quantiles_and_histograms(spark, sf):
    """Windows, the quantile aggregate, the join back and the histogram all reuse the partitioning by trajectory."""
    from kinetrace.plans.motion import suppliers

    plan = tokens.token_histogram(tokens.joint_tokens(suppliers(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in plan


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=8, max_size=40), st.integers(1, 30))
def test_packets_round_trip_in_shape(values, keep):
    x = np.array(values)[:, None]
    assert wire.decode(wire.encode(x, keep)).shape == x.shape


def test_cosine_guards(spark):
    from kinetrace.functions.columns import cosine, cosine_clipped

    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1e-9, 0.0], [1e-9, 0.0])], "a array<double>, b array<double>")
    got = df.select(cosine(F.col("a"), F.col("b")).alias("c"), cosine_clipped(F.col("a"), F.col("b")).alias("d")).collect()
    assert abs(got[0]["c"] - 0.5**0.5) < 1e-12 and got[1]["c"] == 0.0 and got[1]["d"] == 0.0
    assert got[2]["c"] == 0.0 and abs(got[2]["d"] - 1e-6) < 1e-12  # the two guards differ for tiny vectors


def test_names(spark):
    from kinetrace.functions.columns import slug

    df = spark.createDataFrame([("Lab/Aloha-Mobile",), ("lab/umi_cup",), ("lab/My-Arm",)], "r string")
    assert [tuple(r) for r in df.select(slug(F.col("r")), datasets.family(F.col("r"))).collect()] == [("lab__aloha_mobile", "aloha"), ("lab__umi_cup", "umi"), ("lab__my_arm", "my_arm")]


def test_neighbours_meet_block_by_block(spark, monkeypatch):
    """Ties, copies, other blocks and bad vectors as by brute force; blocks aren't joined with blocks, so only k rows a query leave a worker (F5)."""
    monkeypatch.setattr(search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(search, "QUERY_ROWS", 8)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 3, (90, 3)).astype(float), np.repeat([[1.0, 1.0, 1.0]], 20, 0), rng.normal(size=(30, 3))])
    x[5, 1], x[100, 0] = np.nan, np.inf
    rows = [(int(i), v.tolist(), int(i) % 4) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int").repartition(3)
    near = search.nearest(df, df, 5, "id", "v", "label")
    want = set()
    for i, v, _ in rows:
        d = sorted((round(float(((np.array(v) - np.array(w)) ** 2).mean()), 12), j) for j, w, _ in rows if j != i and np.isfinite(v).all() and np.isfinite(w).all())
        want |= {(i, n + 1, j, j % 4) for n, (_, j) in enumerate(d[:5])}
    got = near.collect()
    assert {(r["query"], r["rank"], r["traj_id"], r["label"]) for r in got} == want and all(r["query_label"] == r["query"] % 4 for r in got)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_fit_and_scores_share_the_histograms(spark, sf):
    """The fleet's tokens are made once for its model and its scores (F9)."""
    from kinetrace.plans import motion

    found = motion.fleet_anomaly_score(spark, sf)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("Scan parquet") == 1


def test_live_kinetics_without_a_loop_over_frames(monkeypatch):
    """Runs go on across batches, in whatever parts and order frames come; ordered frames are neither copied into one table nor sorted (F7)."""
    import pandas as pd

    from kinetrace.streaming import monitor

    class State:
        hasTimedOut, exists, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, at):
            assert at == monitor.IDLE_MS

        def getCurrentWatermarkMs(self):
            return 0

    x = np.array([1.0, 1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 3, 3])
    table = pd.DataFrame({"frame": np.arange(len(x)), "x": x})
    v = np.diff(x, prepend=x[0])
    still, run = [], 0
    for s in v == 0:
        run = run + 1 if s else 0
        still.append(run)
    monkeypatch.setattr(pd, "concat", None)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    for cut in (0, 1, 2, 5, 11):
        state, got = State(), []
        for part in (table[:cut], table[cut:][::-1]):
            if len(part):
                for out in monitor._advance((7, 0), iter([part[:2], part[2:]]), state):
                    got += out.values.tolist()
        assert [r[2] for r in got] == list(range(len(x))) and [r[4] for r in got] == v.tolist() and [r[5] for r in got] == np.diff(v, prepend=0.0).tolist()
        assert [r[6] for r in got] == still and [r[7] for r in got] == [s >= 5 for s in still]
        assert list(monitor._advance((7, 0), iter([table]), state)) == []
