"""Table functions for SQL users: ``SELECT t.* FROM packets, LATERAL packet_frames(content) t``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from kinetrace.sources import bags, wire


class PacketFrames:
    """The cells of a packet; one row with the error if it can't be decoded, none for null."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            x = wire.decode(bytes(content))
        except wire.PacketError as e:
            yield None, None, None, str(e)
            return
        for f, row in enumerate(x.tolist()):
            for j, v in enumerate(row):
                yield j, f, v, None


class BagRecords:
    """The records of a bag of any kind; one row with the error if it breaks its format, none for null."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            for r in bags.read_bag(bytes(content)):
                yield r["index"], r["topic"], r["timestamp_ns"], r["robot"], r["quality"], r["encoding"], r["blob"], None
        except (bags.BagError, ValueError, KeyError, TypeError) as e:
            yield None, None, None, None, None, None, None, str(e)


def register(spark: SparkSession) -> None:
    """Makes ``packet_frames`` and ``bag_records`` known to the session's SQL."""
    spark.udtf.register("packet_frames", udtf(PacketFrames, returnType="joint int, frame bigint, x double, error string"))
    spark.udtf.register("bag_records", udtf(BagRecords, returnType="index bigint, topic string, timestamp_ns bigint, robot string, quality double, encoding string, blob binary, error string"))
