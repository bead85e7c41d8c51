"""The recording data source: splits, columns, filters, faults and guards, against decoding whole files."""

import hashlib
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from solstice.sources import recording_source as rs
from solstice.sources import synthetic, trailer


def motion(rng, n, step=1000, start=5_000_000, **faults):
    rows = []
    at = start
    for k in range(n):
        counts = [rng.randrange(8, 65528) for _ in range(6)]
        if k == faults.get("saturated"):
            counts[4] = 65535
        rows.append(struct.pack("<Q6H", at, *counts))
        at += faults.get("gap", step) if k == faults.get("gap_at") else step
    return b"".join(rows)


ABOUT = synthetic.number_field(24, 5_000_500) + synthetic.bytes_field(65, synthetic.number_field(1, 16) + synthetic.number_field(2, 2000))


def views(n, start=7):
    row = lambda k: struct.pack("<Q3f8f64sI", 100 * k, 0.0, 90.0, 60.0, 1, 0, 0, 0, 0, 1, 0, 0, bytes(64), 0)
    return start.to_bytes(4, "little") + bytes(start - 4) + b"".join(map(row, range(n)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(2)
    top = tmp_path_factory.mktemp("recordings")
    for k, n in enumerate((300, 5000, 150)):
        records = {
            trailer.METADATA: ABOUT, trailer.RAW_MOTION: motion(rng, n), trailer.EXPOSURE: b"".join(struct.pack("<Qd", 10 + 33 * i, 0.01) for i in range(n // 10)),
            trailer.ATTITUDE: b"".join(struct.pack("<Q7f", 20 * i, 0, 0, 0.6, 0.8, 1, 2, 3) for i in range(n // 5)), trailer.GPS: b"".join(synthetic.position(1_700_000_000 + i) for i in range(n // 50)),
        }
        if k != 2:
            records[trailer.VIEW] = views(n // 20)
        (top / f"{k}.bin").write_bytes(synthetic.recording(records, prefix=bytes(1000 * k)))
    return top


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("stream", sorted(trailer.STREAMS))
@pytest.mark.parametrize("split", [1 << 30, 7001])
def test_stream_equals_decoding_whole_files(spark, folder, stream, split):
    got = rs.scan(spark, stream, path=str(folder), split_bytes=split)
    want = trailer.stream(trailer.recordings(spark, str(folder)), stream).withColumn("source", F.regexp_replace("source", "^file:/+", "file:///"))
    assert got.columns == want.columns and rows(got) == rows(want)
    assert got.rdd.getNumPartitions() == (1 if split > 1 << 20 else sum(-(-p.stat().st_size // split) for p in folder.iterdir()))


def test_a_large_record_is_many_tasks_that_read_their_rows_only(spark, folder):
    path = f"file://{folder}/1.bin"
    size = (folder / "1.bin").stat().st_size
    reader = rs.RecordingReader({"path": path, "stream": "raw_motion", "split_bytes": "10000"}, rs.T.StructType.fromDDL("sample long"))
    parts = reader.partitions()
    assert len(parts) == -(-size // 10_000)
    got = [list(reader.read(p)) for p in parts]
    counts = [sum(b.num_rows for b in x) for x in got]
    assert sum(counts) == 5000 and max(counts) - min(counts) <= 1 and all(b.schema.names == ["sample"] for x in got for b in x)


def test_filters_choose_sources_kinds_and_ranges(spark, folder):
    schema = rs.T.StructType.fromDDL("source string, us long")
    reader = rs.RecordingReader({"path": str(folder), "stream": "raw_motion", "ordered": "true"}, schema)
    source = f"file://{folder}/1.bin"
    kept = list(reader.pushFilters([rs.EqualTo(("source",), source), rs.GreaterThan(("us",), 5_100_000), rs.LessThanOrEqual(("us",), 5_110_000), rs.EqualTo(("sample",), 3)]))
    assert len(kept) == 4  # Spark applies them again
    [part] = reader.partitions()
    assert [x[0] for x in part.pieces] == [source]
    [batch] = reader.read(part)
    assert batch.column(1).to_pylist() == list(range(5_100_000, 5_110_001, 1000))
    reader = rs.RecordingReader({"path": str(folder)}, rs.T.StructType.fromDDL("kind int, size long"))
    list(reader.pushFilters([rs.In(("kind",), (trailer.GPS, 99))]))
    assert {k for p in reader.partitions() for b in reader.read(p) for k in b.column(0).to_pylist()} == {trailer.GPS}


def test_filters_and_columns_from_sql(spark, folder):
    got = rs.scan(spark, "exposure", "us long, source string", path=str(folder), ordered="true", split_bytes=5000).where("us >= 100 and us < 400 and source like '%/1.bin'")
    assert sorted(r.us for r in got.collect()) == [x for x in range(10, 10 + 33 * 500, 33) if 100 <= x < 400]
    with pytest.raises(PySparkException):
        rs.scan(spark, "exposure", "seconds string", path=str(folder)).count()


def test_records_hash_their_bytes_and_metadata_lists_fields(spark, folder):
    want = set()
    for p in folder.iterdir():
        data = p.read_bytes()
        want |= {(p.name, kind, hashlib.sha256(data[at : at + size]).hexdigest()) for kind, _, at, size, _, _ in trailer.inventory_of(data)}
    got = rs.scan(spark, "records", path=str(folder))
    assert {(r.source.rsplit("/", 1)[-1], r.kind, r.sha256) for r in got.collect()} == want
    fields = rs.scan(spark, "metadata", path=str(folder))
    assert rows(fields.drop("source")) == rows(trailer.metadata_fields(trailer.recordings(spark, str(folder))).drop("source"))


def test_motion_in_units_across_splits(spark, folder):
    counts = {(r.source, r.sample): r for r in rs.scan(spark, "raw_motion", path=str(folder)).collect()}
    for split in (1 << 30, 6000):
        got = rs.scan(spark, "motion", path=str(folder), split_bytes=split).collect()
        assert len(got) == len(counts)
        for r in got:
            c = counts[r.source, r.sample]
            assert r.t == (c.us - 5_000_500) / 1e6 and abs(r.ax - (c.ax - 32768) * 16 / 32768) < 1e-12
            assert abs(r.wy - (c.gy - 32768) * 2000 / 32768 * 3.141592653589793 / 180) < 1e-9


BROKEN = {
    "good": ({}, ABOUT, 300, None), "gap": ({"gap_at": 200, "gap": 10_002}, ABOUT, 300, "gap in the motion clock"), "back": ({"gap_at": 250, "gap": 0}, ABOUT, 300, "raw_motion clock does not increase"),
    "edge": ({"saturated": 131}, ABOUT, 300, "motion is saturated"), "few": ({}, ABOUT, 99, "fewer than 100 samples of motion"), "slow": ({"step": 6000}, ABOUT, 300, "unsupported motion rate"),
    "fast": ({"step": 400}, ABOUT, 300, "unsupported motion rate"), "range": ({}, synthetic.number_field(24, 5) + synthetic.bytes_field(65, synthetic.number_field(1, 16) + synthetic.number_field(2, 2001)), 300, "unknown motion range"),
    "twice": ({}, ABOUT + synthetic.number_field(24, 5), 300, "no first frame or no motion ranges"),
}


@pytest.fixture(scope="module")
def broken(tmp_path_factory):
    rng = random.Random(4)
    top = tmp_path_factory.mktemp("broken")
    for name, (faults, about, n, _) in BROKEN.items():
        (top / f"{name}.bin").write_bytes(synthetic.recording({trailer.METADATA: about, trailer.RAW_MOTION: motion(rng, n, **faults)}))
    (top / "short.bin").write_bytes(b"short")
    (top / "odd.bin").write_bytes(synthetic.recording({trailer.EXPOSURE: bytes(17)}))
    return top


def test_faults_name_each_recording_and_its_first_reason(spark, broken):
    got = {r.source.rsplit("/", 1)[-1]: r.reason for r in rs.scan(spark, "faults", path=str(broken)).collect()}
    want = {f"{name}.bin": x[3] for name, x in BROKEN.items() if x[3]} | {"short.bin": "too short for a trailer", "odd.bin": "exposure must be whole rows of 16 bytes"}
    assert got == want


def test_broken_recordings_fail_or_are_left_out(spark, broken):
    with pytest.raises(PySparkException, match="FormatError"):
        rs.scan(spark, "motion", path=str(broken)).count()
    for split in (1 << 30, 900):
        got = rs.scan(spark, "motion", path=str(broken), on_error="skip", split_bytes=split)
        assert {r.source.rsplit("/", 1)[-1] for r in got.collect()} == {"good.bin"} and got.count() == 300


def test_manifest_suffix_and_empty_folder(spark, folder, tmp_path):
    rows_ = [(f"file://{folder}/{k}.bin", (folder / f"{k}.bin").stat().st_size) for k in (0, 2)]
    spark.createDataFrame(rows_, "source string, length long").coalesce(1).write.parquet(f"file://{tmp_path}/manifest")
    got = rs.scan(spark, "gps", manifest=f"file://{tmp_path}/manifest")
    assert got.count() == 300 // 50 + 150 // 50 and {r.source for r in got.collect()} == {x[0] for x in rows_}
    assert rs.scan(spark, "gps", path=str(folder), suffix="1.bin").count() == 100
    (tmp_path / "none").mkdir()
    assert rs.scan(spark, "gps", path=str(tmp_path / "none")).count() == 0
