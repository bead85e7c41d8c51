"""Fast start and sphere marks: media bytes stay where their offsets say."""

import io
import struct

import pytest

from solstice.sources import mp4
from solstice.sources.trailer import FormatError, Ranges


def box(kind, *content):
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def table(offsets, wide=False):
    return box(b"co64" if wide else b"stco", bytes(4), struct.pack(">I", len(offsets)), *[struct.pack(">Q" if wide else ">I", x) for x in offsets])


def movie(*tracks, entry=b"avc1"):
    return box(b"moov", box(b"mvhd", bytes(20)), *[box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(8), box(entry if k == 0 else b"mp4a", bytes(78), box(b"pasp", bytes(8)))), t)))) for k, t in enumerate(tracks)])


def sample(wide=False, first=b"ftyp"):
    """Two chunks of video, one of sound, with a free box between; the index at the end."""
    top = box(b"ftyp", b"isom") if first else b""
    a, free, b = box(b"mdat", b"video-one|sound|"), box(b"free", bytes(11)), box(b"mdat", b"video-two|")
    at = len(top) + 8
    second = len(top) + len(a) + len(free) + 8
    return top + a + free + b + movie(table([at, second], wide), table([at + 10])), [(0, [b"video-one|", b"video-two|"]), (1, [b"sound|"])]


def chunks(data, track):
    (_, start, end), = [x for x in mp4.outline(data) if x[0] == b"moov"]
    one = mp4.tree(data[start:end])[0].all(b"trak")[track]
    return [x for kind in (b"stco", b"co64") for t in one.all(kind) for x in mp4.numbers(t)]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("sphere", [False, True])
@pytest.mark.parametrize("first", [b"ftyp", b""])
def test_chunks_follow_their_data(wide, sphere, first):
    data, want = sample(wide, first)
    out = mp4.fast_start(data, sphere).bytes(data)
    assert [x[0] for x in mp4.outline(out)] == [b"ftyp"] * bool(first) + [b"moov", b"mdat", b"free", b"mdat"]
    for track, pieces in want:
        assert [out[at : at + len(p)] for at, p in zip(chunks(out, track), pieces, strict=True)] == pieces
    assert (b"sv3d" in out) == sphere and out.count(b"equi") == sphere
    again = mp4.fast_start(out, sphere).bytes(out)
    assert again == out  # nothing left to do, marks are not doubled


def test_offsets_beyond_32_bits_get_wider():
    """A file of over 4 GB whose index moves to the front: only headers and the index are read."""

    class Sparse(io.RawIOBase):
        def __init__(self, parts, size):
            self.parts, self.size, self.at, self.got = parts, size, 0, 0

        def seek(self, at, whence=0):
            self.at = at

        def read(self, n=-1):
            n = min(n, self.size - self.at)
            assert n < 1 << 20
            out = bytearray(n)
            for start, data in self.parts:
                for k in range(max(self.at, start), min(self.at + n, start + len(data))):
                    out[k - self.at] = data[k - start]
            self.at += n
            self.got += n
            return bytes(out)

    big = (1 << 32) - 100
    index = movie(table([16, 16 + big - 50]))
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + big)
    file = Sparse([(0, head), (16 + big, index)], 16 + big + len(index))
    plan = mp4.fast_start(Ranges(file, file.size))
    assert b"co64" in plan.front and b"stco" not in plan.front and plan.ranges == [(0, 16 + big)]
    moved = mp4.tree(plan.front)[0].all(b"co64")[0]
    assert mp4.numbers(moved) == [len(plan.front) + 16, len(plan.front) + 16 + big - 50]
    assert file.got < 10_000


def test_other_files_are_refused():
    data, _ = sample()
    top = box(b"ftyp", b"isom")
    for bad in (data[:-1], top, data + movie(table([])), data + box(b"moof", b""), top + box(b"mdat", b"abc") + movie(table([0])), top + box(b"mdat", b"abc") + movie(box(b"stco", bytes(4), struct.pack(">I", 3), bytes(4)))):
        with pytest.raises(FormatError):
            mp4.fast_start(bad)
    with pytest.raises(FormatError):
        mp4.fast_start(box(b"mdat", b"abc") + movie(table([8]), entry=b"none"), sphere=True)
