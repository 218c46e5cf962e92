"""Packets, bags, files, data sources, streams and the command line."""

import io
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrace import fixtures
from kinetrace.operators import frames
from kinetrace.schemas import EPISODE
from kinetrace.sources import bags, datasource, files, mcap, packets, wire
from kinetrace.sources.datasource import Files


@pytest.fixture(scope="module")
def arm():
    return fixtures.joint_trajectory(2048, 6, 123)


def test_codec_ratio_and_error(arm):
    blob = wire.encode(arm)
    assert wire.ratio(arm, blob) >= 15
    assert np.sqrt(np.mean(np.degrees(arm - wire.decode(blob)) ** 2)) <= 0.05
    assert wire.describe(blob) == {"wire_version": 1, "frames": 2048, "joints": 6, "keep_coeffs": 8, "payload_crc32": zlib.crc32(blob[18:]), "header_bytes": 18, "payload_bytes": len(blob) - 18}


@pytest.mark.parametrize("bad", [np.zeros(9), np.zeros((7, 2)), np.zeros((8, 0)), np.full((8, 1), np.nan), np.full((8, 1), np.inf)])
def test_bad_trajectories(bad):
    with pytest.raises(wire.PacketError):
        wire.encode(bad)


def test_packet_errors(arm):
    blob = wire.encode(arm)
    for _, _, said, change in wire.CORRUPTIONS:
        assert wire.failure(change(blob)) == said
    head = lambda f, j, k: struct.pack("<5sBIHHI", wire.MAGIC, 1, f, j, k, zlib.crc32(b""))
    assert [wire.failure(head(*a)) for a in ((7, 1, 1), (8, 0, 1), (8, 1, 0), (8, 1, 6))] == ["packet frames must be >= 8", "packet joints must be >= 1", "packet keep_coeffs must be >= 1", "packet keep_coeffs exceeds available frequency bins"]
    assert wire.failure(head(8, 1, 1)).startswith("decompression failed")
    body = zlib.compress(b"123")
    assert wire.failure(struct.pack("<5sBIHHI", wire.MAGIC, 1, 8, 1, 1, zlib.crc32(body)) + body) == "payload size mismatch"
    assert wire.failure(blob) == "NO_ERROR"


def test_packets_in_tables(spark, tmp_path, arm):
    wide = fixtures.wide_table(spark, [arm[:64], arm[64:128]]).unionByName(fixtures.wide_table(spark, [arm[:5]], 9))
    p = packets.pack_frames(wide).cache()
    assert {r["traj_id"]: r["error"] for r in p.collect()}[9] == "trajectory has fewer than 8 frames"
    assert bytes(p.where("traj_id = 0").first()["content"]) == wire.encode(arm[:64])
    packets.write_packets(p, str(tmp_path / "lib"))
    (tmp_path / "lib" / "junk.packet").write_bytes(b"junk")
    read = packets.read_packets(spark, str(tmp_path / "lib"))
    v = {os.path.basename(r["path"]): r for r in packets.verify(read).collect()}
    assert v["0.packet"]["ok"] and v["0.packet"]["frames"] == 64 and not v["junk.packet"]["ok"] and v["junk.packet"]["error"] == "blob too small for packet header"
    cells = packets.unpack_frames(read, "path")
    assert cells.where("error is not null").count() == 1 and cells.where("error is null").count() == 2 * 64 * 6
    assert packets.corruption_matrix(p, "traj_id").where("status = 'FAIL'").count() == 0
    datasource.register(spark)
    heads = spark.read.format("motion_packets").option("payload", "false").load(str(tmp_path / "lib"))
    assert heads.where("content is null").count() == 3 and heads.where("frames = 64").count() == 2 and heads.where("error is not null").count() == 1


@pytest.mark.parametrize("kind", list(bags.WRITE))
def test_bags(kind, arm):
    records = fixtures.bag_records(arm, 7, 6, 64)
    blob = bags.WRITE[kind](records)
    assert bags.kind_of(blob) == kind and bags.read_bag(blob) == records and bags.round_trip(records, kind)["bytes_equal"]
    with pytest.raises(bags.BagError):
        bags.read_bag(bags.corrupt(blob))
    with pytest.raises(bags.BagError, match="order|sequence"):
        bags.read_bag(bags.WRITE[kind](bags.swapped(records) if kind != "mcap" else [r | {"timestamp_ns": 9 - i} for i, r in enumerate(records)]))
    assert bags.read_bag(bags.WRITE[kind]([])) == []


def test_bag_errors():
    for blob, said in ((b"", "unsupported bag magic"), (bags.JSON_MAGIC + b"12", "bag blob too small"), (bags.JSON_MAGIC + struct.pack("<II", 5, 0), "bag payload length mismatch"), (bags.JSON_MAGIC + struct.pack("<II", 2, 1) + b"{}", "bag CRC mismatch")):
        with pytest.raises(bags.BagError, match=said):
            bags.read_bag(blob)
    for e, said in (({}, "unexpected bag schema"), ({"schema": bags.JSON_SCHEMA, "schema_version": 9}, "unexpected bag schema version")):
        with pytest.raises(bags.BagError, match=said):
            bags.read_bag(bags._framed(bags.JSON_MAGIC, e))
    with pytest.raises(bags.BagError, match="unsupported record encoding"):
        bags.record(0, b"", encoding="other")
    c = mcap.Content(profile="p")
    with pytest.raises(bags.BagError, match="missing record index"):
        bags.read_bag(mcap.write(c))
    c.metadata[bags.MCAP_INDEX] = {"records_json": "{"}
    with pytest.raises(bags.BagError, match="malformed record index"):
        bags.read_bag(mcap.write(c))


def test_mcap_chunks_are_read():
    c = mcap.Content(profile="x", library="y")
    c.schemas[1], c.channels[1] = ("s", "e", b"d"), (1, "t", "m", {"a": "b"})
    c.messages.append((1, 0, 5, 5, b"payload"))
    plain = mcap.write(c)
    ops = list(mcap._records(plain[8:-8]))
    inner = b"".join(mcap._record(op, body) for op, body, _ in ops if op in (mcap.SCHEMA, mcap.CHANNEL, mcap.MESSAGE))
    for kind, pack in (("", lambda b: b), ("lz4", lambda b: pa.compress(b, "lz4", asbytes=True)), ("zstd", lambda b: __import__("zstandard").compress(b))):
        data = pack(inner)
        chunk = mcap._record(mcap.CHUNK, struct.pack("<QQQI", 5, 5, len(inner), zlib.crc32(inner)) + mcap._text(kind) + struct.pack("<Q", len(data)) + data)
        head = mcap._record(*[(op, body) for op, body, _ in ops if op == mcap.HEADER][0])
        got = mcap.read(mcap.MAGIC + head + chunk + mcap.MAGIC)
        assert got.messages == c.messages and got.channels == c.channels and got.schemas == c.schemas
    with pytest.raises(mcap.McapError):
        mcap.read(plain[:-3])


def test_bag_tables(spark, tmp_path, arm):
    for kind in bags.WRITE:
        (tmp_path / f"{kind}.bag").write_bytes(bags.WRITE[kind](fixtures.bag_records(arm, 7, 4, 64)))
    (tmp_path / "bad.bag").write_bytes(b"nothing")
    read = spark.read.format("binaryFile").load(str(tmp_path))
    rows = bags.read_bags(read)
    assert rows.where("error is null").count() == 12 and rows.where("error is not null").count() == 1
    assert {r["k"] for r in read.select(bags.kind_column().alias("k")).collect()} == {"json", "bridge", "mcap", None}
    datasource.register(spark)
    assert spark.read.format("motion_bags").load(str(tmp_path)).where("error is null").count() == 12


def test_csv(spark, tmp_path):
    assert files.parse_csv("joint_0,joint_1\n1,2\n\n3,4\n").tolist() == [[1, 2], [3, 4]] and files.parse_csv("1,2\n").tolist() == [[1, 2]]
    for bad in ("", "a,b\n", "1,2\nx,4\n", "\n\n"):
        with pytest.raises(ValueError):
            files.parse_csv(bad)
    x = np.arange(20.0).reshape(10, 2)
    files.write_csv(fixtures.wide_table(spark, [x, x + 1]), str(tmp_path / "out"))
    rows = files.read_csv(spark, str(tmp_path / "out")).where("error is null").collect()
    assert len(rows) == 40 and {r["x"] for r in rows if "traj_id=0" in r["path"]} == set(x.ravel())
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "bad.csv").write_text("a,b\n")
    assert files.read_csv(spark, str(tmp_path / "more")).where("error is not null").count() == 1


def test_episodes(spark, tmp_path):
    e = fixtures.episode()
    plain = {"joint_positions": e["joint_positions"].tolist(), "timestamps": e["timestamps"].tolist(), "episode_metadata": {"robot": "arm"}}
    (tmp_path / "a.json").write_text(json.dumps(plain))
    (tmp_path / "b.json").write_text(json.dumps({"observation": {"joint_positions": plain["joint_positions"]}}))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "d.json").write_text(json.dumps(plain | {"timestamps": [1.0]}))
    buf = io.BytesIO()
    np.savez(buf, joint_positions=e["joint_positions"], timestamps=e["timestamps"], episode_metadata_json=json.dumps({"hz": 50}))
    (tmp_path / "f.npz").write_bytes(buf.getvalue())
    rows = {os.path.basename(r["path"]): r for r in files.read_episodes(spark, str(tmp_path)).collect()}
    assert [rows[n]["structure"] for n in ("a.json", "b.json", "f.npz")] == ["top_level", "observation", "top_level"]
    assert rows["c.json"]["error"] and rows["d.json"]["error"] and rows["f.npz"]["episode_metadata"] == {"hz": "50"}
    c = files.compress_episodes(files.read_episodes(spark, str(tmp_path)))
    total = files.overall_ratio(c).first()
    assert total["files"] == 3 and total["ratio"] > 20
    back = wire.decode(bytes(c.where("error is null").first()["content"]))
    assert np.allclose(back, e["joint_positions"], atol=1e-5)


def test_robot_datasets(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "info.json").write_text(json.dumps({"fps": 10}))
    df = spark.createDataFrame([([float(i), 1.0], i // 5) for i in range(10)], "`observation.state` array<float>, episode_index bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "data" / "part"))
    rows = files.dataset_rows(spark, str(tmp_path), "observation.state")
    assert [r["values"][0] for r in files.episode_frames(rows).where("traj_id = 1").orderBy("frame").collect()] == [5.0, 6.0, 7.0, 8.0, 9.0]
    assert files.dataset_info(spark, str(tmp_path)) == {"fps": 10} and files.dataset_info(spark, str(tmp_path / "data")) == {}
    plan = rows.select("values")._jdf.queryExecution().executedPlan().toString()
    assert "episode_index" not in plan.split("ReadSchema")[-1]


def test_stream_equals_batch(spark, sf):
    from kinetrace.plans import library, motion

    live = {(r["traj_id"], r["frame"]): (r["v"], r["a"]) for r in library.stream_kinetics(spark, sf).collect()}
    batch = {(r["traj_id"], r["frame"]): (r["v"], r["a"]) for r in frames.melt(frames.kinetics(motion.events(spark, sf)), ("v", "a")).collect()}
    assert live.keys() == batch.keys() and all(np.allclose(live[k], batch[k], atol=1e-9) for k in live)


def test_command_line(spark, tmp_path, capsys, arm):
    from kinetrace import cli

    def run(*args):
        code = cli.main([str(a) for a in args], spark)
        return code, capsys.readouterr()

    bag = tmp_path / "one.bag"
    bag.write_bytes(bags.write_json(fixtures.bag_records(arm, 3, 1, 256)))
    assert run("encode", bag, tmp_path / "p0.packet")[0] == 0 and run("decode", tmp_path / "p0.packet", tmp_path / "back.csv")[0] == 0
    assert run("encode", tmp_path / "back.csv", tmp_path / "p1.packet")[0] == 0
    assert run("decode", tmp_path / "p0.packet", tmp_path / "back.bag")[0] == 0 and len(bags.read_bag((tmp_path / "back.bag").read_bytes())) == 1
    code, said = run("info", tmp_path / "p0.packet")
    assert code == 0 and json.loads(said.out)["frames"] == 256
    assert run("verify", tmp_path / "p0.packet")[0] == 0
    (tmp_path / "broken.packet").write_bytes(bags.corrupt(bag.read_bytes())[:40])
    assert run("verify", tmp_path / "broken.packet")[0] == 1
    many = tmp_path / "many.bag"
    many.write_bytes(bags.write_json(fixtures.bag_records(arm, 3, 2, 256)))
    assert run("encode", many, tmp_path / "x.packet")[0] == 1
    lib = tmp_path / "lib"
    lib.mkdir()
    for label, path in fixtures.primitives(1, 3, 0)[0]:
        n = len(list(lib.iterdir()))
        (lib / f"{label}_{n:03d}.packet").write_bytes(wire.encode(path, 20))
    code, said = run("search", lib, "reach")
    assert code == 0 and len(json.loads(said.out)["results"]) == 10
    assert run("search", lib, "wave")[0] == 1 and run("search", tmp_path / "meta", "reach")[0] == 1
    code, said = run("anomaly", lib, lib / "reach_000.packet")
    assert code == 0 and "z_score=" in said.out
    code, said = run("export-tokens", tmp_path / "p0.packet", "--format", "vla")
    assert code == 0 and len(json.loads(said.out)["timestamps"]) == 256
    assert run("audit-bundle", tmp_path / "p0.packet", tmp_path / "audit")[0] == 0 and (tmp_path / "audit" / "corruption_matrix.json").exists()
    eps = tmp_path / "eps"
    eps.mkdir()
    (eps / "a.json").write_text(json.dumps({"joint_positions": arm[:64].tolist(), "timestamps": list(range(64))}))
    code, said = run("episode-compress", eps, tmp_path / "packed")
    assert code == 0 and json.loads(said.out)["files"] == 1
    assert F is not None


def test_episodes_dump_and_parse():
    e = fixtures.episode(frames=10)
    back = files.parse_episode("x.json", files.dump_episode(e).encode())
    assert back["structure"] == "top_level" and np.array_equal(back["joint_positions"], e["joint_positions"]) and back["episode_metadata"]["robot"] == "arm"
    nested = files.parse_episode("x.json", files.dump_episode({"observation": {"joint_positions": e["joint_positions"]}}).encode())
    assert nested["structure"] == "observation" and nested["timestamps"].tolist() == list(range(10))
    with pytest.raises(ValueError):
        files.parse_episode("x.txt", b"")


def test_episodes_reach_python_in_frames(spark):
    """A worker gets runs of frames, whatever the episodes' length, and gives the same rows however they are cut into batches (F1, F2, F3)."""
    x = np.round(np.random.default_rng(3).normal(size=(60, 2)), 3)
    rows = [(f"e{i}.json", "top_level", x[: 10 + 5 * i].tolist(), list(range(10 + 5 * i)), {"robot": "arm"}, None) for i in range(6)]
    rows += [("short", "top_level", [[1.0, 2.0]], [0], {}, None), ("none", None, None, None, None, "unreadable"), ("empty", "top_level", [], [], {}, None), ("ragged", "top_level", [[1.0], [1.0, 2.0]] * 9, list(range(18)), {}, None)]
    e = spark.createDataFrame([(p, s, q, None if t is None else [float(v) for v in t], m, r) for p, s, q, t, m, r in rows], EPISODE).coalesce(1)
    batches = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {r["path"]: r for r in files.compress_episodes(e).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for i in range(6):
            r = got[f"e{i}.json"]
            assert bytes(r["content"]) == wire.encode(np.float32(x[: 10 + 5 * i]), 4) and json.loads(r["sidecar"])["timestamps"] == list(range(10 + 5 * i)) and json.loads(r["sidecar"])["episode_metadata"] == {"robot": "arm"}
        assert "fewer than 8" in got["short"]["error"] and got["none"]["error"] == "unreadable" and "not two-dimensional" in got["empty"]["error"] and got["ragged"]["error"] and len(got) == 10
        batches.append(got)
    assert batches[0] == batches[1]
    plan = files.compress_episodes(e)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and plan.index("MapInArrow") < plan.index("posexplode")


def test_episode_files_one_at_a_time(spark, tmp_path):
    """Written by the worker that makes the text, read file by file: no batch holds many files (F1)."""
    x = np.arange(40.0).reshape(20, 2)
    e = spark.createDataFrame([(f"e{i}.json", ("observation", "top_level")[i % 2], (x + i).tolist(), list(range(20)), {"robot": "arm"}, None) for i in range(5)], EPISODE.replace("ARRAY<DOUBLE>", "ARRAY<INT>")).withColumn("timestamps", F.col("timestamps").cast("array<double>"))
    files.write_episodes(e, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == [f"e{i}.json" for i in range(5)]
    back = {os.path.basename(r["path"]): r for r in files.read_episodes(spark, str(tmp_path / "out")).collect()}
    assert all(back[f"e{i}.json"]["joint_positions"] == (x + i).tolist() and back[f"e{i}.json"]["structure"] == ("observation", "top_level")[i % 2] for i in range(5))
    partition = Files([str(tmp_path / "out" / f"e{i}.json") for i in range(5)])
    assert [b.num_rows for b in files._EpisodeReader({"path": str(tmp_path / "out")}).read(partition)] == [1] * 5
    with pytest.raises(Exception, match="no file or folder"):
        files.read_episodes(spark, str(tmp_path / "absent")).collect()


def test_csv_files_are_written_by_the_workers(spark, tmp_path):
    """No commit on the driver moves every file: there is nothing but the trajectories' folders (F4)."""
    t = spark.createDataFrame([(k, i, v, 2.5) for k in ("a/b", "c", None) for i, v in enumerate((1e10, float("nan"), 0.1))] + [("n", 0, None, 1.0)], "traj_id string, frame bigint, x0 double, x1 double")
    out = tmp_path / "out"
    files.write_csv(t, str(out))
    assert sorted(os.listdir(out)) == ["traj_id=__HIVE_DEFAULT_PARTITION__", "traj_id=a%2Fb", "traj_id=c", "traj_id=n"]
    assert [os.listdir(out / d) for d in os.listdir(out)] == [["part-00000.csv"]] * 4
    assert (out / "traj_id=c" / "part-00000.csv").read_text() == "joint_0,joint_1\n1.0E10,2.5\nNaN,2.5\n0.1,2.5\n"
    rows = files.read_csv(spark, str(out)).collect()
    assert len(rows) == 19 and [r["error"] for r in rows if "traj_id=n" in r["path"]] == ["line 2 has a cell that is no number"]
    assert [r["x"] for r in sorted(rows, key=lambda r: r["frame"]) if "a%2Fb" in r["path"] and r["joint"] == 0 and r["frame"] != 1] == [1e10, 0.1]
    with pytest.raises(FileExistsError):
        files.write_csv(t, str(out))


def test_mcap_samples_are_messages():
    """A matrix is written as the same bytes as its rows as messages, and no loop over them (F6)."""
    for x in (np.arange(24, dtype=np.float32).reshape(6, 4), np.zeros((1, 1), np.float32), np.zeros((0, 3), np.float32), np.asfortranarray(np.arange(6, dtype=np.float32).reshape(3, 2))):
        head = lambda: mcap.Content(schemas={1: ("s", "", b"")}, channels={1: (1, "/t", "float32", {})})
        c = head()
        c.messages += [(1, i, i, i, row.tobytes()) for i, row in enumerate(x)]
        for kind in ("", "lz4", "zstd"):
            blob = mcap.write(head(), kind, (1, x))
            assert blob == mcap.write(c, kind) and mcap.read(blob).messages == c.messages
    with pytest.raises(mcap.McapError):
        mcap.write(c, "", (1, x)) if c.messages else None
    short = mcap.MAGIC + mcap._record(mcap.MESSAGE, b"1234") + mcap.MAGIC
    with pytest.raises(mcap.McapError, match="record ends early"):
        mcap.read(short)
