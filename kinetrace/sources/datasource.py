"""Spark data sources: ``spark.read.format("motion_packets" | "motion_bags").load(folder)``.

Partitions are runs of files; packets can be read without their payload (option ``payload`` = ``false``) for header-only scans.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinetrace.schemas import BAG_ROWS
from kinetrace.sources import bags, wire

FILES_A_PARTITION = 64


def filesystem(address: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a folder: a local path or an address (file, hdfs, s3, gs ...)."""
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else os.path.abspath(address))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    #: Endings of the names that are read, in small letters; none: all.
    names: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Files]:
        source, root = filesystem(self.options["path"])
        at = source.get_file_info(root)
        if self.names and at.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no file or folder {root}")
        info = [at] if at.is_file else source.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = sorted(i.path for i in info if i.is_file and not i.base_name.startswith((".", "_")) and i.path.lower().endswith(self.names or ""))
        return [Files(found[i : i + FILES_A_PARTITION]) for i in range(0, len(found), FILES_A_PARTITION)] or [Files([])]

    def contents(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        """Path and bytes of each file, one at a time."""
        source, _ = filesystem(self.options["path"])
        for path in partition.paths:
            with source.open_input_file(path) as f:
                yield path, f.read()


class _PacketReader(_Reader):
    def read(self, partition: Files) -> Iterator[tuple]:
        whole = self.options.get("payload", "true").lower() != "false"
        source, _ = filesystem(self.options["path"])
        for path in partition.paths:
            with source.open_input_file(path) as f:
                blob, size = f.read() if whole else f.read(wire.HEADER_BYTES), f.size()
            try:
                h = wire.header(blob)
                yield path, blob if whole else None, h.version, h.frames, h.joints, h.keep, h.crc, size - wire.HEADER_BYTES, None
            except wire.PacketError as e:
                yield path, blob if whole else None, None, None, None, None, None, None, str(e)


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "motion_packets"

    def schema(self) -> str:
        return "path string, content binary, wire_version int, frames bigint, joints int, keep int, crc bigint, payload_bytes bigint, error string"

    def reader(self, schema) -> _PacketReader:
        return _PacketReader(dict(self.options))


class _BagReader(_Reader):
    def read(self, partition: Files) -> Iterator[tuple]:
        names = [c.split()[0] for c in BAG_ROWS.split(", ")]
        strict = self.options.get("strict", "true").lower() != "false"
        source, _ = filesystem(self.options["path"])
        for path in partition.paths:
            with source.open_input_file(path) as f:
                blob = f.read()
            try:
                for r in bags.read_bag(blob, strict):
                    yield tuple((r | {"path": path}).get(n) for n in names)
            except (bags.BagError, ValueError, KeyError, TypeError) as e:
                yield tuple({"path": path, "error": str(e)}.get(n) for n in names)


class BagSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "motion_bags"

    def schema(self):
        return BAG_ROWS

    def reader(self, schema) -> _BagReader:
        return _BagReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (PacketSource, BagSource):
        spark.dataSource.register(source)
