"""Packets in DataFrames: packing frames, decoding, header scans, writing and reading files."""

from __future__ import annotations

import gzip
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.operators.frames import joint_count
from kinetrace.schemas import HEADER
from kinetrace.sources import mcap, wire
from kinetrace.sources.datasource import filesystem


def read_packets(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of every file below a folder. Files without the packet magic are kept: decoding says what is wrong."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")


def by_trajectory(wide: DataFrame, names: list[str], schema: str, each: Callable[[np.ndarray], list[dict]]) -> DataFrame:
    """Applies ``each`` to the [frames, joints] matrix of every trajectory; its rows come back with traj_id in front.

    A row number gives the order: its window asks for frames that are together and sorted, which costs nothing if they are already,
    and Arrow batches then hold whole runs of frames. One matrix is in memory at a time beside its batch.
    """
    ordered = wide.select("traj_id", "frame", *names).withColumn("_n", F.row_number().over(Window.partitionBy("traj_id").orderBy("frame")))
    kind, fields = dict(wide.dtypes)["traj_id"], [f.split()[0] for f in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, held, types = None, [], None
        rows: dict[str, list] = {c: [] for c in ("traj_id", *fields)}

        def finish() -> None:
            for r in each(np.concatenate(held)) if held else ():
                rows["traj_id"].append(who)
                for c in fields:
                    rows[c].append(r.get(c))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(rows["traj_id"], type=types)] + [pa.array(rows[c], type=_ARROW[t.split()[1]]) for c, t in zip(fields, schema.split(", "), strict=True)], names=list(rows))
            for v in rows.values():
                v.clear()
            return out

        for b in it:
            types = b.column(0).type
            first = np.flatnonzero(b.column("_n").to_numpy() == 1).tolist()
            x = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(float)
            for lo, hi in zip([0, *first], [*first, b.num_rows], strict=True):
                if hi > lo:
                    held.append(x[lo:hi])
                if hi < b.num_rows:  # another trajectory begins
                    finish()
                    who, held = b.column(0)[hi].as_py(), []
            if len(rows["traj_id"]) > 500:
                yield flush()
        finish()
        if rows["traj_id"]:
            yield flush()

    return ordered.mapInArrow(run, f"traj_id {kind}, {schema}")


_ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def pack_frames(wide: DataFrame, keep: int = wire.KEEP, level: int = wire.LEVEL) -> DataFrame:
    """(traj_id, content, raw_bytes, error): one packet a trajectory; what can't be packed has an error instead."""
    names = [f"x{j}" for j in range(joint_count(wide))]

    def each(x: np.ndarray) -> list[dict]:
        try:
            return [{"content": wire.encode(x, keep, level), "raw_bytes": 4 * x.size}]
        except wire.PacketError as e:
            return [{"raw_bytes": 4 * x.size, "error": str(e)}]

    return by_trajectory(wide, names, "content binary, raw_bytes bigint, error string", each)


def packet_header(content: str = "content") -> Column:
    """Header struct of a packet column, with an error where it is malformed; no payload is inflated or checked."""

    def run(col: pa.Array) -> pa.Array:
        out = []
        for b in col.to_pylist():
            try:
                h = wire.header(b or b"")
                out.append({"wire_version": h.version, "frames": h.frames, "joints": h.joints, "keep": h.keep, "crc": h.crc, "payload_bytes": len(b) - wire.HEADER_BYTES, "error": None})
            except wire.PacketError as e:
                out.append({"error": str(e)})
        kinds = [("wire_version", pa.int32()), ("frames", pa.int64()), ("joints", pa.int32()), ("keep", pa.int32()), ("crc", pa.int64()), ("payload_bytes", pa.int64()), ("error", pa.string())]
        return pa.array(out, type=pa.struct(kinds))

    return F.arrow_udf(run, HEADER)(F.col(content))


def crc_ok(content: str = "content") -> Column:
    """Whether the stored CRC is the payload's, inside the JVM."""
    stored = F.conv(F.concat(*[F.hex(F.substring(content, i, 1)) for i in (18, 17, 16, 15)]), 16, 10).cast("bigint")
    return F.coalesce(F.crc32(F.expr(f"substring({content}, {wire.HEADER_BYTES + 1})")) == stored, F.lit(False))


def unpack_frames(packets: DataFrame, key: str) -> DataFrame:
    """(key, joint, frame, x, error): the cells of every packet; a packet that can't be decoded is one row with its error."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, blob in enumerate(b.column(1).to_pylist()):
                try:
                    x, error = wire.decode(blob or b""), None
                except wire.PacketError as e:
                    x, error = np.full((1, 1), np.nan), str(e)
                n, j = x.shape
                bad = np.full(n * j, error is not None)
                at = pa.array(np.full(n * j, i))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), pa.array(np.tile(np.arange(j, dtype=np.int32), n), mask=bad), pa.array(np.repeat(np.arange(n), j), mask=bad), pa.array(x.ravel(), mask=bad), pa.array([error] * (n * j), type=pa.string())],
                    names=[key, "joint", "frame", "x", "error"],
                )

    return packets.select(key, "content").mapInArrow(run, f"{key} {dict(packets.dtypes)[key]}, joint int, frame bigint, x double, error string")


def verify(packets: DataFrame, key: str = "path") -> DataFrame:
    """(key, header fields, crc_ok, sha256, ok): integrity of packets without inflating them."""
    out = packets.select(key, "content", packet_header().alias("h")).select(key, "h.*", crc_ok().alias("crc_ok"), F.sha2("content", 256).alias("sha256"))
    return out.withColumn("ok", F.col("error").isNull() & F.col("crc_ok"))


def put_file(target: fs.FileSystem, folder: str, name: str, blob: bytes) -> None:
    """Writes a file under a temporary name in its folder, then renames it: a second attempt of a task replaces the first one's."""
    draft = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with target.open_output_stream(draft) as f:
        f.write(blob)
    target.move(draft, f"{folder}/{name}")


def write_packets(packets: DataFrame, folder: str, name: str = "traj_id", suffix: str = ".packet") -> None:
    """One file a row, named by a column, on any filesystem that the folder's address names. Written under a temporary name, then renamed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = filesystem(folder)
        target.create_dir(root, recursive=True)
        for b in it:
            for who, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                put_file(target, root, f"{who}{suffix}", blob.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], type=pa.int64())], names=["n"])

    packets.where("content is not null").select(F.col(name).cast("string"), F.col("content").cast("binary")).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def corruption_matrix(packets: DataFrame, key: str) -> DataFrame:
    """(key, case_id, expected_failure, actual_failure, status) of the known corruptions of every packet."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(i, name, expected, wire.failure(change(blob))) for i, blob in enumerate(b.column(1).to_pylist()) for name, _, expected, change in wire.CORRUPTIONS]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], type=pa.int64()))] + [pa.array([r[c] for r in rows], type=pa.string()) for c in (1, 2, 3)], names=[key, "case_id", "expected_failure", "actual_failure"])

    out = packets.where("content is not null").select(key, "content").mapInArrow(run, f"{key} {dict(packets.dtypes)[key]}, case_id string, expected_failure string, actual_failure string")
    return out.withColumn("status", F.when(F.col("expected_failure") == F.col("actual_failure"), "PASS").otherwise("FAIL"))


def _codecs() -> dict[str, tuple]:
    import pyarrow
    import zstandard

    def npy(x: np.ndarray) -> bytes:
        import io

        out = io.BytesIO()
        np.save(out, x)
        return out.getvalue()

    def boxed(kind: str) -> tuple:
        def pack(x: np.ndarray) -> bytes:
            channel = (1, "/samples", "float32", {})
            return mcap.write(mcap.Content(schemas={1: ("samples", "", b"")}, channels={1: channel}), kind, (1, x))

        return pack, lambda b, s: np.frombuffer(b"".join(m[4] for m in mcap.read(b).messages), dtype=np.float32).reshape(s)

    return {
        "mcap_lz4": boxed("lz4"),
        "mcap_zstd": boxed("zstd"),
        "spectral_k8": (lambda x: wire.encode(x, 8), lambda b, _: wire.decode(b).astype(np.float32)),
        "raw_npy": (npy, lambda b, s: np.frombuffer(b[-4 * int(np.prod(s)) :], dtype=np.float32).reshape(s)),
        "gzip_9": (lambda x: gzip.compress(x.tobytes(), 9, mtime=0), lambda b, s: np.frombuffer(gzip.decompress(b), dtype=np.float32).reshape(s)),
        "zlib_9": (lambda x: zlib.compress(x.tobytes(), 9), lambda b, s: np.frombuffer(zlib.decompress(b), dtype=np.float32).reshape(s)),
        "zstd_3": (lambda x: zstandard.compress(x.tobytes(), 3), lambda b, s: np.frombuffer(zstandard.decompress(b), dtype=np.float32).reshape(s)),
        "zstd_19": (lambda x: zstandard.compress(x.tobytes(), 19), lambda b, s: np.frombuffer(zstandard.decompress(b), dtype=np.float32).reshape(s)),
        "lz4": (lambda x: pyarrow.compress(x.tobytes(), "lz4", asbytes=True), lambda b, s: np.frombuffer(pyarrow.decompress(b, 4 * int(np.prod(s)), "lz4", asbytes=True), dtype=np.float32).reshape(s)),
    }


def benchmark_codecs(wide: DataFrame, runs: int = 5) -> DataFrame:
    """A row a trajectory and tool: sizes, ratio, encode and decode times, exactness and largest error on float32 samples."""
    names = [f"x{j}" for j in range(joint_count(wide))]

    def timed(f, *args: object) -> tuple[object, list[float]]:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            out = f(*args)
            took.append(1000 * (time.perf_counter() - began))
        return out, took

    def each(values: np.ndarray) -> list[dict]:
        x, rows = values.astype(np.float32), []
        for tool, (enc, dec) in _codecs().items() if len(x) >= wire.MIN_FRAMES else ():
            blob, e = timed(enc, x)
            back, d = timed(dec, blob, x.shape)
            figures = (tool, x.nbytes, len(blob), x.nbytes / max(1, len(blob)), *np.percentile(e, [50, 95]), *np.percentile(d, [50, 95]), bool((back == x).all()), False, float(np.abs(back.astype(float) - x).max()))
            rows.append(dict(zip([c.split()[0] for c in schema.split(", ")], figures, strict=True)))
        return rows

    schema = "tool_id string, raw_size_bytes bigint, compressed_size_bytes bigint, compression_ratio double, encode_time_ms_p50 double, encode_time_ms_p95 double, decode_time_ms_p50 double, decode_time_ms_p95 double, bit_exact_replay boolean, searchable_without_decode boolean, max_abs_error double"
    return by_trajectory(wide, names, schema, each)
