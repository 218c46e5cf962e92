"""Similarity search: signatures, template scores, nearest neighbours and pairwise cosines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import cosine, rounded
from kinetrace.operators.tokens import VOCABULARY, tokenised
from kinetrace.session import shared_dir
from kinetrace.sources.datasource import filesystem

LABELS = tuple("reach grasp retract place push circular_wipe".split())
TEMPLATES = {name.upper(): name for name in LABELS[:5]}
WEIGHTS = (0.5, 0.35, 0.15)
PROTOTYPE_FRAMES = 96
#: Queries that are handled together, and rows of the library that they meet at once.
QUERY_ROWS, BLOCK_ROWS = 1024, 4096


def primitive_curve(label: str, frames: int, noise: float, rng: np.random.Generator) -> np.ndarray:
    """A planar motion of the named kind: its curve, scaled and shifted at random, with noise. Draws scale, shift, noise in turn."""
    s = np.linspace(0.0, 1.0, frames, endpoint=False)
    pi_s = np.pi * s
    curves = {
        "reach": lambda: (1.2 * s, 0.3 * np.sin(0.6 * pi_s) + 0.25 * s),
        "grasp": lambda: (0.7 + 0.04 * np.sin(8 * pi_s), 0.5 + 0.04 * np.cos(8 * pi_s)),
        "retract": lambda: (1.2 - 1.1 * s, 0.45 - 0.2 * s),
        "place": lambda: (0.6 + 0.05 * np.sin(2 * pi_s), 0.9 - 0.9 * s),
        "push": lambda: (1.5 * s, 0.22 + 0.03 * np.sin(4 * pi_s)),
        "circular_wipe": lambda: (0.8 + 0.35 * np.cos(2 * pi_s), 0.4 + 0.35 * np.sin(2 * pi_s)),
    }
    if label not in curves:
        raise ValueError(f"unknown primitive {label}")
    path = np.column_stack(curves[label]())
    factor, move = rng.uniform(0.75, 1.25), rng.uniform(-0.5, 0.5, 2)
    return path * factor + move + rng.normal(0.0, noise, path.shape)


@lru_cache(8)
def _prototype(label: str, frames: int = PROTOTYPE_FRAMES) -> np.ndarray:
    return primitive_curve(label, frames, 0.0, np.random.default_rng(0))


def prototype_frames(spark: SparkSession, labels: tuple[str, ...] = LABELS, frames: int = PROTOTYPE_FRAMES) -> DataFrame:
    """Wide frames of the noise-free prototypes, traj_id being the label's place; rounded to 12 decimals, made once by NumPy."""
    rows = [(i, f, *map(float, np.round(p, 12))) for i, label in enumerate(labels) for f, p in enumerate(_prototype(label, frames))]
    return spark.createDataFrame(rows, "traj_id bigint, frame bigint, x0 double, x1 double")


def signature(wide: DataFrame) -> DataFrame:
    """(traj_id, frame, s0, s1): paths centred and scaled to unit mean square radius (floor 1e-12)."""
    w = Window.partitionBy("traj_id")
    moved = wide.withColumns({"c0": F.col("x0") - F.avg("x0").over(w), "c1": F.col("x1") - F.avg("x1").over(w)})
    size = F.greatest(F.sqrt(F.avg(F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1")).over(w)), F.lit(1e-12))
    return moved.withColumn("size", size).select("traj_id", "frame", (F.col("c0") / F.col("size")).alias("s0"), (F.col("c1") / F.col("size")).alias("s1"))


def features(wide: DataFrame) -> DataFrame:
    """(traj_id, tokens, hist, sig): one row a path, the search index. Tokens are a string, a letter each."""
    marked = tokenised(wide)
    w = Window.partitionBy("traj_id")
    moved = marked.withColumns({"c0": F.col("x0") - F.avg("x0").over(w), "c1": F.col("x1") - F.avg("x1").over(w)})
    moved = moved.withColumn("size", F.greatest(F.sqrt(F.avg(F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1")).over(w)), F.lit(1e-12)))
    row = F.struct("frame", F.char(F.col("token") + 65).alias("letter"), (F.col("c0") / F.col("size")).alias("s0"), (F.col("c1") / F.col("size")).alias("s1"))
    per = moved.groupBy("traj_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.array(*[F.count_if(F.col("token") == k) / F.count("token") for k in range(VOCABULARY)]).alias("hist"))
    return per.select("traj_id", F.concat_ws("", "r.letter").alias("tokens"), "hist", F.flatten(F.transform("r", lambda f: F.array(f["s0"], f["s1"]))).alias("sig"))


def prefix_overlap(text: Column, query: Column) -> Column:
    """Share of the query that its longest prefix found anywhere in the text makes up.

    If a prefix occurs, so do the shorter ones: the length is the number of prefixes that occur.
    """
    n = F.length(query)
    found = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.contains(text, F.substring(query, F.lit(1), k))))
    return F.when(n == 0, F.lit(0.0)).otherwise(found / n)


def template_search(index: DataFrame, templates: DataFrame, k: int = 10) -> DataFrame:
    """(template, rank, traj_id, score): blended score of every path against each template, best ``k``; ties to the lower id.

    ``templates`` has a row a template (five, whatever the library's size): it is the broadcast side.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    t = templates.select(F.col("traj_id").alias("template"), F.col("tokens").alias("qt"), F.col("hist").alias("qh"), F.col("sig").alias("qs"))
    wrong = F.size("sig") != F.size("qs")
    score = F.lit(WEIGHTS[0]) * cosine(F.col("hist"), F.col("qh")) + F.lit(WEIGHTS[1]) * cosine(F.col("sig"), F.col("qs")) + F.lit(WEIGHTS[2]) * prefix_overlap(F.col("tokens"), F.col("qt"))
    scored = index.crossJoin(F.broadcast(t)).select("template", "traj_id", F.when(wrong, F.raise_error(F.lit("path and template differ in length: resample first")).cast("double")).otherwise(rounded(score, 6)).alias("score"))
    nth = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("score"), "traj_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k)


def template_number(name: str) -> int:
    """Place of a template among the labels; names are case-blind."""
    if name.upper() not in TEMPLATES:
        raise ValueError(f"unsupported template {name.upper()}")
    return LABELS.index(TEMPLATES[name.upper()])


def cosine_topk(library: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, traj_id, score) of (traj_id, vec) against a few (query, qvec)."""
    scored = library.crossJoin(queries).select("query", "traj_id", rounded(cosine(F.col("vec"), F.col("qvec")), 6).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "traj_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k).select("query", "rank", "traj_id", "score")


def _blocks(df: DataFrame, key: str, vector: str, label: str, rows: int) -> DataFrame:
    """Packs vectors into blocks: (ids, labels, flat values)."""
    cols = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("label").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("v").flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())],
                    names=["ids", "labels", "data"],
                )

    return cols.where("v is not null and id is not null").mapInArrow(pack, "ids array<bigint>, labels array<bigint>, data binary")


class _Nearest:
    """The ``k`` best of some queries so far, over blocks of the library that come one after another."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.a, self.k, self.exclude = ids, data, k, exclude_self
        self.size = (data * data).sum(1)
        self.left = np.column_stack([data, np.ones(len(data))])
        self.row, self.id, self.label, self.mse = (np.empty(0, t) for t in (np.int64, np.int64, object, np.float64))
        self.worst = np.full(len(data), np.inf)

    def add(self, ids: np.ndarray, labels: np.ndarray, data: np.ndarray) -> None:
        half = (data * data).sum(1) / 2
        ok = np.isfinite(half)
        ids, labels, data, half = ids[ok], labels[ok], data[ok], half[ok]
        if not len(ids):
            return
        near = self.left @ np.column_stack([data, -half]).T  # the larger, the nearer: (size - dim * mse) / 2
        if self.exclude:
            order = np.argsort(ids, kind="stable")
            lo, hi = (np.searchsorted(ids[order], self.ids, side) for side in ("left", "right"))
            for n in range(int((hi - lo).max())):
                same = np.flatnonzero(hi - lo > n)
                near[same, order[lo[same] + n]] = -np.inf
        dim = data.shape[1]
        least = (self.size - dim * self.worst) / 2
        few = np.flatnonzero(np.isinf(self.worst) & np.isfinite(self.size))
        if len(few) and near.shape[1] > self.k:
            least[few] = np.partition(near[few], -self.k, axis=1)[:, -self.k]
        # the product only picks candidates, with room for its rounding and for ties of the 12th decimal
        room = dim * 1e-12 + 1e-13 * (self.size + 2 * half.max())
        at = np.flatnonzero((near >= (least - room)[:, None]) & (near > -np.inf))
        row, col = np.divmod(at, near.shape[1])
        del near, at
        if not len(row):
            return
        mse = np.concatenate([((self.a[row[i : i + 65536]] - data[col[i : i + 65536]]) ** 2).sum(1) / dim for i in range(0, len(row), 65536)])
        mse = np.where(mse * 1e12 < 4.5e15, np.floor(mse * 1e12 + 0.5) / 1e12, mse)
        fine = np.isfinite(mse)
        self.row, self.id, self.label, self.mse = (np.concatenate([old, new[fine]]) for old, new in ((self.row, row), (self.id, ids[col]), (self.label, labels[col]), (self.mse, mse)))
        order = np.lexsort((self.id, self.mse, self.row))
        nth = np.arange(len(order)) - np.searchsorted(self.row[order], self.row[order])
        order = order[nth < self.k]
        self.row, self.id, self.label, self.mse = (v[order] for v in (self.row, self.id, self.label, self.mse))
        ends = np.flatnonzero(nth[nth < self.k] == self.k - 1)
        self.worst[self.row[ends]] = self.mse[ends]


def nearest(library: DataFrame, queries: DataFrame, k: int, key: str, vector: str, label: str, exclude_self: bool = True) -> DataFrame:
    """(query, query_label, traj_id, label, mse, rank): exact nearest neighbours by mean square difference; ties to the lower id.

    All pairs are looked at, so time is queries times library. The library's blocks are written to the shared folder once; each
    block of queries reads them one after another and keeps its ``k`` best, which are all that leaves the worker.
    """
    at = shared_dir(library.sparkSession, "vectors")
    _blocks(library, key, vector, label, BLOCK_ROWS).write.parquet(at)
    blocks = _blocks(queries, key, vector, label, QUERY_ROWS)
    tasks = 4 * library.sparkSession.sparkContext.defaultParallelism

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        def arrays(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = row.column("ids")[0].values.to_numpy()
            return ids, np.array(row.column("labels")[0].as_py(), dtype=object), np.frombuffer(row.column("data")[0].as_buffer()).reshape(len(ids), -1)

        source, root = filesystem(at)
        paths = [i.path for i in source.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".parquet")]
        for b in it:
            for i in range(b.num_rows):
                ids, labels, data = arrays(b.slice(i, 1))
                found = _Nearest(ids, data, k, exclude_self)
                for path in paths:
                    with source.open_input_file(path) as f:
                        for one in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(1):
                            found.add(*arrays(one))
                yield pa.RecordBatch.from_arrays([pa.array(ids[found.row]), pa.array(labels[found.row], pa.int64()), pa.array(found.id), pa.array(found.label, pa.int64()), pa.array(found.mse)], names=["query", "query_label", "traj_id", "label", "mse"])

    out = blocks.repartition(tasks).mapInArrow(best, "query bigint, query_label bigint, traj_id bigint, label bigint, mse double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("mse", "traj_id"))
    return out.withColumn("rank", nth).where(F.col("rank") <= k)


def pairwise_cosine(df: DataFrame, key: str = "label", vector: str = "vec") -> DataFrame:
    """(a, b, cosine) of every unordered pair of rows."""
    left, right = df.select(F.col(key).alias("a"), F.col(vector).alias("va")), df.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))
