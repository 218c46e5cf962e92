"""CSV trajectories, episode files and columnar robot datasets."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from kinetrace.schemas import EPISODE
from kinetrace.sources import packets, wire
from kinetrace.sources.datasource import Files, _Reader, filesystem

#: Bytes of results that a worker holds before it sends them on.
FLUSH_BYTES = 1 << 22


def parse_csv(text: str) -> np.ndarray:
    """Cells of one CSV; the first row may be a header; blank rows are skipped; a bad cell after that is an error."""
    rows: list[list[float]] = []
    for i, line in enumerate(text.splitlines()):
        cells = [c.strip() for c in line.split(",")]
        if not any(cells):
            continue
        try:
            rows.append([float(c) for c in cells])
        except ValueError:
            if rows or any(_is_number(c) for c in cells):
                raise ValueError(f"line {i + 1} has a cell that is no number") from None
    if not rows:
        raise ValueError("CSV has no rows")
    return np.array(rows)


def _is_number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True


class _CsvReader(_Reader):
    names = (".csv",)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, raw in self.contents(partition):
            try:
                x, error = parse_csv(raw.decode("utf-8")), None
            except ValueError as e:
                x, error = np.full((1, 1), np.nan), str(e)
            n, j = x.shape
            said = pa.nulls(n * j, pa.string()) if error is None else pa.repeat(pa.scalar(error), n * j)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), n * j), pa.array(np.tile(np.arange(j, dtype=np.int32), n)), pa.array(np.repeat(np.arange(n), j)), pa.array(x.ravel()), said], names=["path", "joint", "frame", "x", "error"])


class CsvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "motion_csv"

    def schema(self) -> str:
        return "path string, joint int, frame bigint, x double, error string"

    def reader(self, schema) -> _CsvReader:
        return _CsvReader(dict(self.options))


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """(path, joint, frame, x, error): one trajectory a file, in the order of its lines."""
    spark.dataSource.register(CsvSource)
    return spark.read.format("motion_csv").load(folder)


def _escaped(value: str | None) -> str:
    """A value as the folder names of partitioned tables have it."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or c < " " else c for c in value)


def write_csv(wide: DataFrame, folder: str) -> None:
    """One folder a trajectory (traj_id=..), joints as columns joint_0.., frames in order; the folder has to be new.

    Each worker writes the files of its trajectories itself: no commit moves every file once more on the driver.
    """
    names = [c for c in wide.columns if c[0] == "x" and c[1:].isdigit()]
    head = ",".join(f"joint_{c[1:]}" for c in names)
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("" if len(names) > 1 else '""')) for c in names])
    ordered = wide.select(F.col("traj_id"), "frame", line.alias("line")).withColumn("_n", F.row_number().over(Window.partitionBy("traj_id").orderBy("frame")))
    target, root = filesystem(folder)
    if target.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{root} exists")
    target.create_dir(root, recursive=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = filesystem(folder)
        who, held, done = None, [], 0

        def finish() -> int:
            if not held:
                return 0
            at = f"{root}/traj_id={_escaped(who)}"
            target.create_dir(at, recursive=True)
            packets.put_file(target, at, "part-00000.csv", "\n".join([head, *held, ""]).encode())
            return 1

        for b in it:
            first = np.flatnonzero(b.column("_n").to_numpy() == 1).tolist()
            lines = b.column("line").to_pylist()
            for lo, hi in zip([0, *first], [*first, b.num_rows], strict=True):
                held += lines[lo:hi]
                if hi < b.num_rows:  # another trajectory begins
                    done += finish()
                    who, held = b.column("traj_id")[hi].as_py(), []
        yield pa.RecordBatch.from_arrays([pa.array([done + finish()], type=pa.int64())], names=["n"])

    ordered.select(F.col("traj_id").cast("string").alias("traj_id"), "line", "_n").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def parse_episode(name: str, raw: bytes) -> dict:
    """Fields of one episode: JSON (positions at the top or under ``observation``) or NPZ, which is never unpickled."""
    if name.lower().endswith(".npz"):
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            meta = json.loads(str(z["episode_metadata_json"])) if "episode_metadata_json" in z else {}
            e = {"joint_positions": z["joint_positions"], "timestamps": z["timestamps"], "episode_metadata": meta}
    elif name.lower().endswith(".json"):
        e = json.loads(raw)
    else:
        raise ValueError("unsupported episode file")
    return normalise_episode(e)


def normalise_episode(e: dict) -> dict:
    inner = e.get("observation")
    if "joint_positions" in e:
        structure, found = "top_level", e["joint_positions"]
    elif isinstance(inner, dict) and "joint_positions" in inner:
        structure, found = "observation", inner["joint_positions"]
    else:
        raise ValueError("episode has no joint_positions")
    x = np.asarray(found, dtype=np.float32)
    if x.ndim != 2:
        raise ValueError("joint_positions is not frames by joints")
    stamps = np.asarray(e["timestamps"] if "timestamps" in e else np.arange(len(x)), dtype=np.float64)
    if stamps.shape != (len(x),):
        raise ValueError("timestamps don't match joint_positions")
    return {"structure": structure, "joint_positions": x, "timestamps": stamps, "episode_metadata": dict(e.get("episode_metadata", e.get("metadata", {})))}


class _EpisodeReader(_Reader):
    names = (".json", ".npz")

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, raw in self.contents(partition):
            cells = {"path": path}
            try:
                e = parse_episode(path, raw)
                x, meta = e["joint_positions"], [(k, v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for k, v in e["episode_metadata"].items()]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], type=pa.int32()), pa.array(x.ravel()))
                cells |= {"structure": e["structure"], "joint_positions": pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), flat), "timestamps": e["timestamps"].tolist(), "episode_metadata": meta}
            except (ValueError, KeyError, TypeError) as err:
                cells = {"path": path, "error": str(err)}
            yield pa.RecordBatch.from_arrays([v if isinstance(v := cells.get(f.name), pa.Array) else pa.array([v], type=f.type) for f in _EPISODE], schema=_EPISODE)


_EPISODE = pa.schema([("path", pa.string()), ("structure", pa.string()), ("joint_positions", pa.list_(pa.list_(pa.float32()))), ("timestamps", pa.list_(pa.float64())), ("episode_metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


class EpisodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "motion_episodes"

    def schema(self) -> str:
        return EPISODE

    def reader(self, schema) -> _EpisodeReader:
        return _EpisodeReader(dict(self.options))


def read_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """A row an episode file (.json, .npz), with an error where it can't be read. One file is in a worker's memory at a time."""
    spark.dataSource.register(EpisodeSource)
    return spark.read.format("motion_episodes").load(folder)


def _matrix(runs: list[pa.Array]) -> np.ndarray:
    """float32 [frames, joints] of runs of frames; what isn't rectangular is NumPy's to refuse."""
    q = pa.concat_arrays(runs) if runs else pa.array([], pa.list_(pa.float32()))
    width = pc.list_value_length(q)
    if len(q) and not q.null_count and pc.min_max(width)["min"] == pc.min_max(width)["max"]:
        return q.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(q), width[0].as_py())
    return np.array(q.to_pylist(), dtype=np.float32)


def each_episode(episodes: DataFrame, schema: pa.Schema, each: Callable[[dict, Callable[[], np.ndarray]], dict]) -> DataFrame:
    """Applies ``each`` to every episode's other fields and a function that gives its matrix; its rows come back.

    Episodes reach Python frame by frame: a batch is so many frames, not so many episodes, and one episode is in memory at a time
    beside its batch. Results are sent on from FLUSH_BYTES on.
    """
    first = F.coalesce("_n", F.lit(0)) == 0
    heads = ("path", "structure", "timestamps", "episode_metadata", "error")
    parts = episodes.select(*heads, F.posexplode_outer("joint_positions").alias("_n", "_q"))
    parts = parts.select(first.alias("_first"), F.col("_n").isNotNull().alias("_some"), *[F.when(first, F.col(c)).alias(c) for c in heads], "_q")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, rows, size = None, [], [], 0

        def finish() -> int:
            if head is None:
                return 0
            row = each(head, lambda: _matrix(held))
            rows.append(row)
            return 64 + sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))

        for b in it:
            starts = np.flatnonzero(b.column("_first").to_numpy(zero_copy_only=False)).tolist()
            for lo, hi in zip([0, *starts], [*starts, b.num_rows], strict=True):
                if hi > lo and head["_some"]:
                    held.append(b.column("_q").slice(lo, hi - lo))
                if hi < b.num_rows:  # another episode begins
                    size += finish()
                    if size > FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                    head, held = b.slice(hi, 1).select(["_some", *heads]).to_pylist()[0], []
        finish()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return parts.mapInArrow(run, ", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in schema))


_SQL_TYPES = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "bigint", pa.float64(): "double"}


def compress_episodes(episodes: DataFrame, keep: int = 4) -> DataFrame:
    """(path, content, raw_bytes, packet_bytes, ratio, sidecar, error) of every episode; the sidecar is JSON without a clock."""

    def each(e: dict, matrix: Callable[[], np.ndarray]) -> dict:
        try:
            if e["error"]:
                raise ValueError(e["error"])
            x = matrix()
            blob = wire.encode(x, keep)
            side = {"structure": e["structure"], "timestamps": e["timestamps"], "episode_metadata": dict(e["episode_metadata"] or []), "packet_info": wire.describe(blob), "compression_ratio": wire.ratio(x, blob)}
            return {"path": e["path"], "content": blob, "raw_bytes": x.nbytes, "packet_bytes": len(blob), "ratio": wire.ratio(x, blob), "sidecar": json.dumps(side, sort_keys=True)}
        except ValueError as err:
            return {"path": e["path"], "error": str(err)}

    kinds = [("path", pa.string()), ("content", pa.binary()), ("raw_bytes", pa.int64()), ("packet_bytes", pa.int64()), ("ratio", pa.float64()), ("sidecar", pa.string()), ("error", pa.string())]
    return each_episode(episodes, pa.schema(kinds), each)


def write_episodes(episodes: DataFrame, folder: str) -> None:
    """One JSON file an episode, named by ``path``, in the structure that its row names. No file's text leaves the worker that makes it."""

    def each(e: dict, matrix: Callable[[], np.ndarray]) -> dict:
        body = {"joint_positions": matrix()}
        body = {"observation": body} if e["structure"] == "observation" else body
        text = dump_episode(body | {"timestamps": e["timestamps"], "episode_metadata": dict(e["episode_metadata"] or [])})
        packets.put_file(*filesystem(folder), e["path"], text.encode())
        return {"n": 1}

    target, root = filesystem(folder)
    target.create_dir(root, recursive=True)
    each_episode(episodes, pa.schema([("n", pa.int64())]), each).agg(F.sum("n")).collect()


def dump_episode(e: dict) -> str:
    """An episode as pretty JSON with sorted keys, in the structure it came in."""
    e = normalise_episode(e)
    inner = {"joint_positions": e["joint_positions"].tolist()}
    body = {"observation": inner} if e["structure"] == "observation" else inner
    return json.dumps(body | {"timestamps": e["timestamps"].tolist(), "episode_metadata": e["episode_metadata"]}, sort_keys=True, indent=2) + "\n"


def overall_ratio(compressed: DataFrame) -> DataFrame:
    """(files, raw_bytes, packet_bytes, ratio): the ratio of the sums."""
    per = compressed.where("error is null").agg(F.count("*").alias("files"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum("packet_bytes"), F.lit(0)).alias("packet_bytes"))
    return per.withColumn("ratio", F.col("raw_bytes") / F.greatest(F.lit(1), F.col("packet_bytes")))


def dataset_info(spark: SparkSession, root: str) -> dict:
    """``meta/info.json`` of a dataset, or {}; a small file, read through Spark so that any filesystem works."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "info.json").option("recursiveFileLookup", True).load(root).where("path like '%/meta/info.json'").select("content").head(1)
    return json.loads(bytes(rows[0][0])) if rows else {}


def dataset_rows(spark: SparkSession, root: str, field: str) -> DataFrame:
    """(file, row, episode_index, values): the field of every non-empty row of data/**/*.parquet, with its place in the dataset.

    Two columns are read; sorting by (file, row) gives the dataset's own order.
    """
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(os.path.join(root, "data"))
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("episode_index").cast("bigint").alias("episode_index"), F.col(f"`{field}`").cast("array<float>").alias("values"))


def episode_frames(rows: DataFrame) -> DataFrame:
    """(traj_id, frame, values): the rows of each episode numbered in the dataset's order."""
    w = Window.partitionBy("episode_index").orderBy("file", "row")
    return rows.select(F.col("episode_index").alias("traj_id"), (F.row_number().over(w) - 1).cast("bigint").alias("frame"), "values")


def sample(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows in a total order."""
    return df.orderBy(*order).limit(n)
