"""Synthetic recordings with known answers, for tests and for queries without recordings."""

from __future__ import annotations

import struct

from .trailer import EXPOSURE, GPS, MAGIC, METADATA


def recording(records: dict[int, bytes], version: int = 3, headers: bool = False, prefix: bytes = b"") -> bytes:
    """A file with the records (by kind) and their index."""
    body, index = b"", b""
    for kind, data in records.items():
        encoding = int(kind == METADATA)
        index += struct.pack("<BBII", kind, encoding, len(data), len(body))
        body += data + (struct.pack("<BBI", encoding, kind, len(data)) if headers or version < 3 else b"")
    body += index + struct.pack("<BBI", 0, 0, len(index)) + bytes(32)
    return prefix + body + struct.pack("<II", len(body) + 40, version) + MAGIC


def varint(value: int) -> bytes:
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def number_field(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def bytes_field(number: int, value: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(value)) + value


def position(second: int, ms: int = 0, fix: str = "A", lat: float = 12.5, ns: str = "N", lon: float = 45.25, ew: str = "E", speed: float = 3.5, course: float = 270.5, alt: float = 123.75) -> bytes:
    return struct.pack("<QHBdBdBddd", second, ms, ord(fix), lat, ord(ns), lon, ord(ew), speed, course, alt)


def example(seed: int) -> bytes:
    """A recording with metadata, exposures and positions; some positions are void or far away."""
    start = 1_700_000_000 + 1000 * seed
    positions = [position(start), position(start + 1, fix="V"), position(start + 2), position(start + 3, lat=91.0), position(start + 4, lon=180.0), position(start + 50 + seed, ns="S", ew="W")]
    exposures = [struct.pack("<Qd", 900_000 + 100_000 * k, 0.001 * (k + 1)) for k in range(4 + seed)]
    metadata = bytes_field(2, b"camera") + number_field(20, 30) + number_field(24, 10_000_000 + seed)
    return recording({METADATA: metadata, EXPOSURE: b"".join(exposures), GPS: b"".join(positions)})
