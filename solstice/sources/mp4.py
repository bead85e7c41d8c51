"""MP4 files with the index in front and the marks of a sphere: byte ranges to copy behind a new front.

Only box headers and the index (moov) of a file are read, whatever its size; media data are named as ranges of the original.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from dataclasses import dataclass, field

from .trailer import FormatError, Ranges, need

#: Boxes that hold boxes, with the bytes before the first of them.
HOLDERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"stsd": 8}
#: Sample entries of video: their boxes lie behind a fixed part.
PICTURES, FIXED_PART = {b"avc1", b"avc3", b"hvc1", b"hev1", b"apch", b"apcn", b"apcs", b"apco", b"ap4h", b"ap4x"}, 78


@dataclass
class Box:
    kind: bytes
    head: bytes = b""
    inner: list[Box] | None = None
    body: bytes = b""

    def bytes(self) -> bytes:
        content = self.body if self.inner is None else self.head + b"".join(x.bytes() for x in self.inner)
        size = 8 + len(content)
        need(size < 1 << 32, "an index box of 4 GB")
        return struct.pack(">I4s", size, self.kind) + content

    def all(self, kind: bytes) -> list[Box]:
        found = [self] if self.kind == kind else []
        for x in self.inner or []:
            found += x.all(kind)
        return found


def outline(data: bytes | Ranges) -> list[tuple[bytes, int, int]]:
    """(kind, start, end) of the outermost boxes."""
    out, at = [], 0
    while at < len(data):
        head = data[at : at + 16]
        need(len(head) >= 8, "a box header is cut off")
        size, kind = struct.unpack(">I4s", head[:8])
        if size == 1:
            need(len(head) == 16, "a box header is cut off")
            size = struct.unpack(">Q", head[8:])[0]
        elif size == 0:  # to the end of the file
            size = len(data) - at
        need(8 <= size <= len(data) - at, f"box {kind!r} is out of bounds")
        out.append((kind, at, at + size))
        at += size
    return out


def tree(data: bytes) -> list[Box]:
    """The boxes in the body of an index box."""
    out = []
    for kind, start, end in outline(data):
        body = data[start + (16 if data[start : start + 4] == b"\0\0\0\1" else 8) : end]
        skip = FIXED_PART if kind in PICTURES else HOLDERS.get(kind)
        if skip is None:
            out.append(Box(kind, body=body))
        else:
            need(len(body) >= skip, f"box {kind!r} is too short")
            out.append(Box(kind, body[:skip], tree(body[skip:])))
    return out


def numbers(box: Box) -> list[int]:
    """The chunk offsets of an stco or co64 box."""
    form, width = (">I", 4) if box.kind == b"stco" else (">Q", 8)
    need(len(box.body) >= 8 and struct.unpack(">I", box.body[4:8])[0] * width == len(box.body) - 8, "a table of chunk offsets has another length")
    return [x for (x,) in struct.iter_unpack(form, box.body[8:])]


def sphere_marks() -> list[Box]:
    """One picture for both eyes, as a whole equirectangular sphere."""
    full = bytes(4)
    projection = Box(b"proj", b"", [Box(b"prhd", body=full + bytes(12)), Box(b"equi", body=full + bytes(16))])
    return [Box(b"st3d", body=full + b"\0"), Box(b"sv3d", b"", [Box(b"svhd", body=full + b"\0"), projection])]


@dataclass
class Plan:
    """A file to write: `front`, then the ranges of the original."""

    front: bytes
    ranges: list[tuple[int, int]] = field(default_factory=list)

    def bytes(self, data: bytes | Ranges) -> bytes:
        return self.front + b"".join(data[a:b] for a, b in self.ranges)


def fast_start(data: bytes | Ranges, sphere: bool = False, rounds: int = 16) -> Plan:
    """The file with its type and its index first, and with the marks of a sphere on its one video track if asked for.

    Chunk offsets follow the data to their new places; a table of 32-bit offsets that doesn't reach becomes one of 64 bits, which moves the data again, so
    places are computed anew until they stay. Files with other than one index, fragments, or chunks outside all boxes are refused.
    """
    boxes = outline(data)
    index = [x for x in boxes if x[0] == b"moov"]
    need(len(index) == 1 and not any(x[0] == b"moof" for x in boxes), "not a file with one index and without fragments")
    _, start, end = index[0]
    movie = tree(data[start:end])[0]
    if sphere:
        entries = [x for s in movie.all(b"stsd") for x in s.inner if x.kind in PICTURES]
        need(len(entries) == 1, "not one video track")
        entries[0].inner = [x for x in entries[0].inner if x.kind not in (b"st3d", b"sv3d")] + sphere_marks()
    first = [x for x in boxes if x[0] == b"ftyp"]
    rest = [x for x in boxes if x[0] not in (b"ftyp", b"moov")]
    tables = [(x, numbers(x)) for kind in (b"stco", b"co64") for x in movie.all(kind)]
    starts = [x[1] for x in rest]
    for _, old in tables:
        for at in old:
            k = bisect_right(starts, at) - 1
            need(k >= 0 and at < rest[k][2], "a chunk lies outside all boxes")
    lead, before = b"".join(data[a:b] for _, a, b in first), None
    for _ in range(rounds):
        front = lead + movie.bytes()
        if len(front) == before:
            return Plan(front, [(a, b) for _, a, b in rest])
        before, place, moved = len(front), len(front), []
        for _, a, b in rest:
            moved.append(place - a)
            place += b - a
        for box, old in tables:
            new = [at + moved[bisect_right(starts, at) - 1] for at in old]
            if max(new, default=0) >= 1 << 32:
                box.kind = b"co64"
            box.body = box.body[:8] + b"".join(struct.pack(">I" if box.kind == b"stco" else ">Q", x) for x in new)
    raise FormatError("chunk offsets do not settle")
