"""The binary format, positions, GPX and published tables."""

import io
import struct

import pytest

from solstice.operators import gps
from solstice.sources import boxes, publish, synthetic, trailer


def files(spark, *contents):
    return spark.createDataFrame([(f"f{k}", bytearray(c)) for k, c in enumerate(contents)], "source string, content binary")


LAYOUTS = [(version, headers, prefix) for version in (1, 2, 3) for headers in (True, False) for prefix in (b"", b"video") if headers or version == 3]


@pytest.mark.parametrize("version, headers, prefix", LAYOUTS)
def test_inventory_of_every_layout(spark, version, headers, prefix):
    records = {7: synthetic.position(5), 1: b"abc", 4: b"", 200: bytes(300)}
    data = synthetic.recording(records, version, headers, prefix=prefix)
    at, want = len(prefix), []
    for kind, content in records.items():
        want.append((kind, at, len(content), headers, version))
        at += len(content) + 6 * headers
    out = trailer.inventory(files(spark, data)).collect()
    assert sorted((r.kind, r.offset, r.size, r.has_header, r.version) for r in out) == sorted(want)
    for kind, offset, size, _, _ in want:
        assert data[offset : offset + size] == records[kind]


def damaged():
    """Each number of a good file's index and footer set to values that break a rule."""
    records = {1: b"abc", 7: b"x" * 53, 9: b"yz"}
    for version, headers in ((1, True), (3, False)):
        good = synthetic.recording(records, version, headers)
        footer, index = len(good) - 72, len(good) - 72 - 6 - 10 * len(records)
        body = index

        def put(at, form, *values):
            return good[:at] + struct.pack(form, *values) + good[at + struct.calcsize(form) :]

        for k in range(32):
            yield f"magic {k}", put(len(good) - 32 + k, "B", good[len(good) - 32 + k] ^ 1)
        for value in (0, 4, 1 << 31):
            yield f"version {value}", put(len(good) - 36, "<I", value)
        for value in (0, 77, len(good) + 1):
            yield f"length {value}", put(len(good) - 40, "<I", value)
        for value in (0, 5, 40_970, (1 << 32) - 6):
            yield f"index size {value}", put(footer - 4, "<I", value)
        for k, value in ((0, 1), (1, 9)):
            yield f"index type {k}", put(footer - 6 + k, "B", value)
        for k in range(len(records)):
            yield f"record {k} beyond the index", put(index + 10 * k + 6, "<I", body)
            yield f"record {k} too large", put(index + 10 * k + 2, "<I", body + 1)
            yield f"record {k} like another", put(index + 10 * k, "B", [7, 9, 1][k])
            if k:
                yield f"record {k} over the first", put(index + 10 * k + 6, "<I", 0)
        for cut in range(1, len(good), 37):
            yield f"{cut} bytes less at the end", good[:-cut]


@pytest.mark.parametrize("what, data", list(damaged()))
def test_damaged_files_are_refused(what, data):
    with pytest.raises(trailer.FormatError):
        trailer.inventory_of(data)


@pytest.mark.parametrize("data", [b"\x08", b"\x08" + b"\xff" * 10 + b"\x01", b"\x0a\x05ab", b"\x0b", b"\x00\x01", b"\x08" + b"\xff" * 9 + b"\x7f"])
def test_broken_messages_are_refused(data):
    with pytest.raises(trailer.FormatError):
        trailer.wire_fields(data)


def test_positions_break_at_void_invalid_and_gaps(spark):
    start = 1_700_000_000
    data = [synthetic.position(start, 123), synthetic.position(start + 1, fix="V"), synthetic.position(start + 2), synthetic.position(start + 3, lat=91), synthetic.position(start + 4, lon=180), synthetic.position(start + 50, ns="S", ew="O", alt=float("nan"), speed=-1, course=360)]
    samples = trailer.stream(files(spark, synthetic.recording({7: b"".join(data)})), "gps")
    points = gps.positions(samples)
    out = points.orderBy("sample").collect()
    assert [r.segment for r in out] == [1, 2, 3, 4]
    assert out[0].utc == "2023-11-14T22:13:20.123Z" and out[2].lon == -180.0 and (out[3].lat, out[3].lon) == (-12.5, -45.25)
    assert (out[3].elevation_m, out[3].speed_mps, out[3].course_degrees) == (None, None, None)
    summary = gps.position_summary(samples, points).first()
    assert (summary.samples, summary.points, summary.segments, summary.void, summary.invalid, summary.omitted) == (6, 4, 4, 1, 1, 3)
    assert gps.position_violations(samples).count() == 0
    document = gps.gpx(points).first().document
    assert document.count("<trkseg>") == 4 and 'lat="12.500000000" lon="45.250000000"' in document and document.count("<ele>") == 3


def test_position_contract_finds_each_fault(spark):
    data = [synthetic.position(10), synthetic.position(9), synthetic.position(11, ms=1000), synthetic.position(13, ns="Q"), synthetic.position(400_000_000_000)]
    samples = trailer.stream(files(spark, synthetic.recording({7: b"".join(data)})), "gps")
    assert sorted((r.sample, r.rule) for r in gps.position_violations(samples).collect()) == [(1, "increasing time"), (2, "milliseconds"), (3, "status or hemisphere"), (4, "calendar")]


def test_streams_without_records_and_no_files(spark):
    assert trailer.stream(files(spark, synthetic.recording({1: b""})), "gps").count() == 0
    assert trailer.inventory(files(spark).where("false")).count() == 0


def test_files_are_read_from_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.bin").write_bytes(synthetic.example(k))
    ranges, whole = trailer.recordings(spark, str(tmp_path)), trailer.whole_recordings(spark, str(tmp_path))
    assert "content" not in ranges.columns
    for found in (ranges, whole):
        assert trailer.stream(found, "exposure").groupBy("source").count().count() == 3
        assert trailer.metadata_fields(found).where("number = 24").count() == 3
    assert trailer.inventory(ranges).exceptAll(trailer.inventory(whole)).count() == 0


def test_ranges_read_only_what_is_asked():
    class File(io.BytesIO):
        got = 0

        def read(self, n=-1):
            data = super().read(n)
            self.got += len(data)
            return data

    data = synthetic.recording({1: b"abc", 7: synthetic.position(5)}, prefix=bytes(1_000_000))
    file = File(data)
    assert trailer.inventory_of(trailer.Ranges(file, len(data))) == trailer.inventory_of(data)
    assert file.got < 1000


def test_boxes(spark):
    inner = struct.pack(">I4s", 12, b"tkhd") + b"abcd"
    data = struct.pack(">I4s", 8 + 8 + len(inner), b"moov") + struct.pack(">I4s", 8 + len(inner), b"trak") + inner
    assert [(r.path, r.offset, r["size"]) for r in boxes.boxes(files(spark, data)).orderBy("offset").collect()] == [("/moov", 0, 28), ("/moov/trak", 8, 20), ("/moov/trak/tkhd", 16, 12)]
    with pytest.raises(ValueError):
        list(boxes.boxes_of(struct.pack(">I4s", 100, b"moov")))


def test_publish_never_overwrites_and_verifies(spark, tmp_path):
    df = spark.range(10)
    publish.publish(df, str(tmp_path / "out"), {"b": 1, "a": [2]})
    assert publish.verify(spark, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        publish.publish(df, str(tmp_path / "out"), {})
    assert publish.fingerprint({"b": 1, "a": [2]}) == publish.fingerprint({"a": [2], "b": 1})
    with pytest.raises(ValueError):
        publish.strict_json('{"a": NaN}')


def entry(name, slots, wire):
    payload = synthetic.bytes_field(1, name)
    for x in slots:
        payload += bytes([2 << 3 | 1]) + struct.pack("<d", x) if wire == 1 else synthetic.number_field(2, int(x))
    return payload


def test_accessory_entries():
    good = synthetic.bytes_field(1, entry(b"lens_1", range(6), 1)) + synthetic.bytes_field(2, entry(b"a", [0.5], 1)) + synthetic.bytes_field(3, entry(b"b", [7], 0))
    assert trailer.accessory_entries(good) == [(1, "lens_1", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (2, "a", [0.5]), (3, "b", [7.0])]
    first = synthetic.bytes_field(1, entry(b"x", range(6), 1))
    for bad in (
        b"", synthetic.bytes_field(2, entry(b"a", [0.5], 1)), first + first, first * 2, synthetic.bytes_field(4, entry(b"a", [1], 0)), synthetic.bytes_field(1, entry(b"x", range(5), 1)), synthetic.bytes_field(1, entry(b"x-y", range(6), 1)),
        synthetic.bytes_field(1, entry(b"___", range(6), 1)), synthetic.bytes_field(1, entry(b"x", [float("nan")] * 6, 1)), first + synthetic.bytes_field(3, entry(b"b", [7], 1)), synthetic.bytes_field(1, synthetic.number_field(1, 3)),
    ):
        with pytest.raises(trailer.FormatError):
            trailer.accessory_entries(bad)


def test_adapters_keep_records_without_video(spark):
    data = synthetic.recording({1: b"abc", 7: synthetic.position(5), 4: bytes(16)}, prefix=bytes(5000))
    out = trailer.adapter(data)
    assert len(out) < 300 and {(k, out[at : at + n]) for k, _, at, n, _, v in trailer.inventory_of(out) if v == 2} == {(1, b"abc"), (4, bytes(16))}


def views(n, header=12, category=0, w=1.0, fov=1.5):
    return struct.pack("<I", header) + bytes(header - 4) + b"".join(struct.pack("<Q3f8f", 1000 * k, 0, fov, 0.5, w, 0, 0, 0, 0, 1.0, 0, 0) + bytes(64) + struct.pack("<I", category) for k in range(n))


def test_views(spark):
    out = trailer.stream(files(spark, synthetic.recording({32: views(3)})), "view").orderBy("sample").collect()
    assert [(r.us, r.fov_x, r.camera_w, r.pilot_x) for r in out] == [(1000 * k, 1.5, 1.0, 1.0) for k in range(3)]
    for bad in (b"", views(1), views(3)[:-1], views(3, category=2), views(3, w=1.1), views(3, fov=float("inf")), views(3, header=4)[4:]):
        with pytest.raises(trailer.FormatError):
            trailer.view(bad)


def test_locks_are_exclusive_and_leave_what_is_not_theirs(tmp_path):
    path = tmp_path / "lock"
    with publish.locked(str(path)):
        with pytest.raises(FileExistsError), publish.locked(str(path)):
            pass
        assert path.exists()
    assert not path.exists()
    with publish.locked(str(path)):
        path.unlink()
        path.write_text("another's")
    assert path.read_text() == "another's"
