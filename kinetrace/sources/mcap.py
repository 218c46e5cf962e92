"""A small reader and writer of the public MCAP container format (without chunks or in one, and chunks of any number on reading; lz4 and zstd)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, METADATA, DATA_END = 1, 2, 3, 4, 5, 6, 12, 15


class McapError(ValueError):
    """A file that isn't readable as MCAP."""


@dataclass
class Content:
    profile: str = ""
    library: str = ""
    schemas: dict[int, tuple[str, str, bytes]] = field(default_factory=dict)  # id -> name, encoding, data
    channels: dict[int, tuple[int, str, str, dict[str, str]]] = field(default_factory=dict)  # id -> schema, topic, message encoding, metadata
    messages: list[tuple[int, int, int, int, bytes]] = field(default_factory=list)  # channel, sequence, log time, publish time, data
    metadata: dict[str, dict[str, str]] = field(default_factory=dict)


def _text(s: str) -> bytes:
    raw = s.encode("utf-8")
    return struct.pack("<I", len(raw)) + raw


def _map(m: dict[str, str]) -> bytes:
    raw = b"".join(_text(k) + _text(v) for k, v in m.items())
    return struct.pack("<I", len(raw)) + raw


def _record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


_HEAD, _MESSAGE = struct.Struct("<BQ"), struct.Struct("<HIQQ")


def sample_run(channel: int, rows: np.ndarray) -> bytes:
    """Message records of a matrix, a row each, its number for sequence and times: the bytes of such messages without a loop over them."""
    size = rows.shape[1] * rows.itemsize
    out = np.zeros(len(rows), np.dtype([("op", "u1"), ("n", "<u8"), ("channel", "<u2"), ("sequence", "<u4"), ("logged", "<u8"), ("published", "<u8"), ("data", "u1", (size,))]))
    out["op"], out["n"], out["channel"], out["sequence"] = MESSAGE, _MESSAGE.size + size, channel, np.arange(len(rows))
    out["logged"] = out["published"] = np.arange(len(rows))
    out["data"] = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), size)
    return out.tobytes()


def write(c: Content, compression: str = "", samples: tuple[int, np.ndarray] | None = None) -> bytes:
    """A file of one run of messages: bare, or in a chunk compressed with lz4 or zstd. ``samples`` (channel, matrix) stand for messages, a row each."""
    out = [MAGIC, _record(HEADER, _text(c.profile) + _text(c.library))]
    for i, (name, encoding, data) in c.schemas.items():
        out.append(_record(SCHEMA, struct.pack("<H", i) + _text(name) + _text(encoding) + struct.pack("<I", len(data)) + data))
    for i, (schema, topic, encoding, meta) in c.channels.items():
        out.append(_record(CHANNEL, struct.pack("<HH", i, schema) + _text(topic) + _text(encoding) + _map(meta)))
    if samples is not None and c.messages:
        raise McapError("either messages or samples")
    run = sample_run(*samples) if samples is not None else b"".join(_record(MESSAGE, _MESSAGE.pack(channel, sequence, logged, published) + data) for channel, sequence, logged, published, data in c.messages)
    if compression:
        import pyarrow

        packed, times = pyarrow.compress(run, compression, asbytes=True), [m[2] for m in c.messages] or [0, max(0, len(samples[1]) - 1) if samples is not None else 0]
        run = _record(CHUNK, struct.pack("<QQQI", min(times), max(times), len(run), zlib.crc32(run)) + _text(compression) + struct.pack("<Q", len(packed)) + packed)
    out.append(run)
    for name, meta in c.metadata.items():
        out.append(_record(METADATA, _text(name) + _map(meta)))
    out.append(_record(DATA_END, struct.pack("<I", zlib.crc32(b"".join(out)))))
    out += [_record(FOOTER, struct.pack("<QQI", 0, 0, 0)), MAGIC]
    return b"".join(out)


class _Body:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise McapError("record ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def numbers(self, fmt: str) -> tuple:
        return struct.unpack("<" + fmt, self.take(struct.calcsize("<" + fmt)))

    def text(self) -> str:
        return self.take(self.numbers("I")[0]).decode("utf-8", "replace")

    def map(self) -> dict[str, str]:
        inner, out = _Body(self.take(self.numbers("I")[0])), {}
        while inner.at < len(inner.raw):
            k = inner.text()
            out[k] = inner.text()
        return out


def _records(raw: bytes) -> Iterator[tuple[int, bytes, int]]:
    at = 0
    while at < len(raw):
        if at + 9 > len(raw):
            raise McapError("record header ends early")
        op, n = _HEAD.unpack_from(raw, at)
        if at + 9 + n > len(raw):
            raise McapError("record ends early")
        yield op, raw[at + 9 : at + 9 + n], at
        at += 9 + n


def _inflate(kind: str, data: bytes, size: int) -> bytes:
    if kind == "":
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if kind == "lz4":
        import pyarrow

        return pyarrow.decompress(data, size, "lz4", asbytes=True)
    raise McapError(f"unsupported chunk compression {kind}")


def read(blob: bytes, check: bool = True) -> Content:
    if len(blob) < 2 * len(MAGIC) or not blob.startswith(MAGIC):
        raise McapError("invalid magic")
    if not blob.endswith(MAGIC):
        raise McapError("file ends early")
    c = Content()

    def walk(raw: bytes, base: int) -> None:
        for op, body, at in _records(raw):
            if op == MESSAGE:
                if len(body) < _MESSAGE.size:
                    raise McapError("record ends early")
                c.messages.append((*_MESSAGE.unpack_from(body), body[_MESSAGE.size :]))
                continue
            b = _Body(body)
            if op == HEADER:
                c.profile, c.library = b.text(), b.text()
            elif op == SCHEMA:
                (i,) = b.numbers("H")
                c.schemas[i] = (b.text(), b.text(), b.take(b.numbers("I")[0]))
            elif op == CHANNEL:
                i, schema = b.numbers("HH")
                c.channels[i] = (schema, b.text(), b.text(), b.map())
            elif op == CHUNK:
                _, _, size, crc = b.numbers("QQQI")
                kind = b.text()
                inner = _inflate(kind, b.take(b.numbers("Q")[0]), size)
                if check and crc and zlib.crc32(inner) != crc:
                    raise McapError("chunk CRC mismatch")
                walk(inner, -1)
            elif op == METADATA:
                name = b.text()
                c.metadata[name] = b.map()
            elif op == DATA_END and base >= 0:
                (crc,) = b.numbers("I")
                if check and crc and zlib.crc32(blob[: base + at]) != crc:
                    raise McapError("data CRC mismatch")

    walk(blob[len(MAGIC) : -len(MAGIC)], len(MAGIC))
    c.messages.sort(key=lambda m: m[2])  # by log time; Python's sort keeps file order of equals
    return c
