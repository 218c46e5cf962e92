"""The packet: a truncated spectrum of one trajectory in bytes.

Layout, little endian: magic (5 bytes), version u8, frames u32, joints u16, kept bins u16, CRC-32 of the rest u32; then the
zlib-compressed float32 array [kept, joints, (re, im)]. The transform is NumPy's, so that packets are equal to the byte.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from struct import Struct

import numpy as np

MAGIC = bytes.fromhex("5a50424f54")
VERSION, KEEP, LEVEL, MIN_FRAMES = 1, 8, 9, 8
_HEADER = Struct("<5sBIHHI")
HEADER_BYTES = _HEADER.size


class PacketError(ValueError):
    """A packet that can't be read, or a trajectory that can't be packed."""


@dataclass(frozen=True)
class Header:
    version: int
    frames: int
    joints: int
    keep: int
    crc: int

    @property
    def bins(self) -> int:
        return self.frames // 2 + 1

    @property
    def values(self) -> int:
        return 2 * self.keep * self.joints


def check_trajectory(values: object) -> np.ndarray:
    x = np.asarray(values, dtype=np.float64)
    for wrong, said in ((x.ndim != 2, "trajectory is not two-dimensional"), (x.ndim == 2 and len(x) < MIN_FRAMES, f"trajectory has fewer than {MIN_FRAMES} frames"), (x.ndim == 2 and x.shape[-1] < 1, "trajectory has no joints")):
        if wrong:
            raise PacketError(said)
    if not np.isfinite(x).all():
        raise PacketError("trajectory has values that are not finite")
    return x


def _check_header(h: Header) -> Header:
    for name, value, least in (("frames", h.frames, MIN_FRAMES), ("joints", h.joints, 1), ("keep_coeffs", h.keep, 1)):
        if value < least:
            raise PacketError(f"packet {name} must be >= {least}")
    if h.keep > h.bins:
        raise PacketError("packet keep_coeffs exceeds available frequency bins")
    return h


def encode(values: object, keep: int = KEEP, level: int = LEVEL) -> bytes:
    x = check_trajectory(values)
    frames, joints = x.shape
    keep = min(max(1, keep), frames // 2 + 1)
    if joints > 0xFFFF or keep > 0xFFFF:
        raise PacketError("joints and kept bins are limited to 65535")
    spectrum = np.fft.rfft(x, axis=0)[:keep]
    body = zlib.compress(spectrum.astype("<c8").tobytes(), level)  # complex64 is (re, im) in float32
    return _HEADER.pack(MAGIC, VERSION, frames, joints, keep, zlib.crc32(body)) + body


def header(blob: bytes, versions: tuple[int, ...] | None = (VERSION,)) -> Header:
    """Header fields only; the payload isn't touched."""
    if len(blob) < HEADER_BYTES:
        raise PacketError("blob too small for packet header")
    magic, *fields = _HEADER.unpack_from(blob)
    h = Header(*fields)
    if magic != MAGIC:
        raise PacketError("invalid packet magic")
    if versions and h.version not in versions:
        raise PacketError(f"unsupported codec version {h.version}")
    return _check_header(h)


def payload(blob: bytes, check: bool = True) -> tuple[Header, bytes]:
    h = header(blob)
    body = bytes(blob[HEADER_BYTES:])
    if check and zlib.crc32(body) != h.crc:
        raise PacketError("payload CRC mismatch")
    return h, body


def decode(blob: bytes) -> np.ndarray:
    """[frames, joints] of a packet; bins that weren't kept are zero."""
    h, body = payload(blob)
    try:
        raw = zlib.decompress(body)
    except zlib.error as e:
        raise PacketError(f"decompression failed: {e}") from e
    if len(raw) != 4 * h.values:
        raise PacketError("payload size mismatch")
    part = np.frombuffer(raw, dtype="<c8").reshape(h.keep, h.joints).astype(np.complex128)
    return np.fft.irfft(part.T, n=h.frames, axis=1).T  # joint by joint, so no transform is strided


def describe(blob: bytes) -> dict[str, int]:
    """Header fields and payload size after a CRC check, without inflating."""
    h, body = payload(blob)
    return {"wire_version": h.version, "frames": h.frames, "joints": h.joints, "keep_coeffs": h.keep, "payload_crc32": h.crc, "header_bytes": HEADER_BYTES, "payload_bytes": len(body)}


def ratio(values: np.ndarray, blob: bytes) -> float:
    """Bytes of the trajectory as float32 over the packet's."""
    raw = 4 * np.asarray(values).size
    if raw == 0:
        raise PacketError("trajectory is empty")
    return raw / max(1, len(blob))


#: Corruptions that a reader has to notice: name, what it does, what has to be said, how.
CORRUPTIONS = (
    ("invalid_magic", "another magic", "invalid packet magic", lambda b: b"\x00" * 5 + b[5:]),
    ("crc_mismatch", "a bit pattern of the last byte is flipped", "payload CRC mismatch", lambda b: b[:-1] + bytes([b[-1] ^ 0x7F])),
    ("truncated_header", "one byte short of a header", "blob too small for packet header", lambda b: b[: HEADER_BYTES - 1]),
    ("unsupported_version", "version 99", "unsupported codec version 99", lambda b: b[:5] + bytes([99]) + b[6:]),
)


def failure(blob: bytes) -> str:
    """What decoding a blob says, or NO_ERROR."""
    try:
        decode(blob)
    except PacketError as e:
        return str(e)
    return "NO_ERROR"
