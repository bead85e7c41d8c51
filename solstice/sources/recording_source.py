"""Recordings as a data source: `spark.read.format("solstice.recording")`.

    register(spark)
    spark.read.format("solstice.recording").option("path", folder).option("stream", "raw_motion").load()

Partitions are ranges of rows: a large recording is cut by its length into as many parts as it needs, small ones share one, and parts share tasks where
there are very many. Each task reads the file's trailer and index, then the bytes of its rows only, in chunks; nothing of a file is read while the read is planned.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import trailer
from .trailer import FormatError, Ranges, need

#: Rows that are decoded at once, bytes of a chunk that is hashed, and of a recording that is read at once where all of it is asked for.
CHUNK_ROWS, CHUNK_BYTES, SMALL_BYTES = 1 << 17, 8 << 20, 1 << 20
#: Tasks beyond which pieces share one, as long as it reads 128 MB at most, and rows of a batch that small recordings share.
TASKS, TASK_BYTES, BATCH_ROWS = 512, 128 << 20, 10_000
#: Fixed values of the format: the ranges of a gyroscope in degrees a second, and the fields that are read for a recording's clock and range.
GYRO_RANGES = (250, 500, 1000, 2000, 4000)
FIRST_FRAME, MOTION_RANGES = 24, 65


@dataclass(frozen=True)
class Layout:
    """Rows of equal size in a record: their decoder, the bytes of a row, the most bytes of a record, and the name of the clock and its bytes in a row."""

    kind: int
    decode: Callable[[bytes], dict]
    width: int
    most: int
    columns: str
    clock: str = "us"
    header: bool = False


LAYOUTS = {
    name: Layout(kind, decode, width, most, columns, "utc_s" if name == "gps" else "us", name == "view")
    for name, width, most in (("exposure", 16, 64 << 20), ("attitude", 36, 1 << 40), ("raw_motion", 20, 1 << 40), ("view", 120, 1 << 40), ("gps", 53, 53 * 100_000))
    for kind, decode, columns in (trailer.STREAMS[name],)
}
SCHEMAS = {name: f"source string, sample long, {x.columns}" for name, x in LAYOUTS.items()} | {
    "records": "source string, kind int, encoding int, offset long, size long, has_header boolean, version int, sha256 string",
    "metadata": "source string, position int, number int, wire int, value long, payload binary",
    "motion": "source string, sample long, t double, ax double, ay double, az double, wx double, wy double, wz double",
    "faults": "source string, reason string",
}
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


class Part(InputPartition):
    """Pieces of recordings: (source, length, first and last part (not included) of how many, file, where the recording starts in it)."""

    def __init__(self, pieces: list[tuple[str, int, int, int, int, str, int]]):
        super().__init__(pieces)
        self.pieces = pieces


class RecordingSource(DataSource):
    """Options: path (a file or a folder, with all below), or manifest (a Parquet table of source and length; with path and start, a recording is so many bytes of the file `path`, and source is its name only); stream (a name of SCHEMAS);
    split_bytes (of a recording's part at most, 128 MB; beyond 512 parts, those of up to 128 MB share tasks); suffix (of the names that are read);
    streams: those that `faults` looks at, joined by commas, all by default;
    on_error: `fail` (the default) or `skip`, which leaves out recordings that break a rule: the stream `faults` names them and the first reason;
    ordered: `true` if clocks are known to increase, as the stream `faults` tells: filters on the clock then choose the range that is read.

    A schema given to the reader names the columns that are decoded. Filters on source, kind and the clock are used to read less; Spark applies them again.
    """

    @classmethod
    def name(cls) -> str:
        return "solstice.recording"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("stream", "records")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RecordingReader(dict(self.options), schema)


def listed(options: dict[str, str]) -> list[tuple[str, int, str, int]]:
    """(source, length, file, start) of the recordings that are read, in the order of files; a file is a URI."""
    if "manifest" in options:
        system, path = fs.FileSystem.from_uri(options["manifest"])
        rows = pq.read_table(path, filesystem=system)
        source, length = rows["source"].to_pylist(), rows["length"].to_pylist()
        within = "path" in rows.column_names
        files = rows["path"].dictionary_encode().to_pylist() if within else source
        return sorted(zip(source, length, files, rows["start"].to_pylist() if within else [0] * len(source), strict=True), key=lambda x: (x[2], x[3], x[0]))
    path, suffix = options["path"], options.get("suffix", "")
    scheme = re.match(r"[a-z0-9]+:(//[^/]*)?", path)
    system, place = fs.FileSystem.from_uri(path if scheme else f"file://{posixpath.abspath(path)}")
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    start = "file://" if not scheme or scheme[0].startswith("file:") else scheme[0].rstrip("/") + ("" if place.startswith("/") else "//" if "//" not in scheme[0] else "")
    if scheme and not scheme[0].startswith("file:") and scheme[1]:
        start = f"{scheme[0].split('//')[0]}//"
    return sorted((f"{start}{x.path}", x.size, f"{start}{x.path}", 0) for x in found if x.type == fs.FileType.File and x.path.endswith(suffix) and not posixpath.basename(x.path).startswith((".", "_")))


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.fields = options, schema.names
        self.stream = options.get("stream", "records")
        self.skip, self.ordered = options.get("on_error", "fail") == "skip", options.get("ordered", "false") == "true"
        self.sources: set[str] | None = None
        self.kinds: set[int] | None = None
        self.low, self.high = -(1 << 63), (1 << 63) - 1
        self.kinds_of = dict(c.split() for c in SCHEMAS[self.stream].split(", "))
        wrong = [f.name for f in schema if f.dataType.simpleString().replace("bigint", "long") != self.kinds_of.get(f.name)]
        if wrong:
            raise ValueError(f"the stream {self.stream} has no such columns: {', '.join(wrong)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what names sources, kinds and bounds of the clock. All filters stay with Spark as well."""
        clock = (LAYOUTS[self.stream].clock,) if self.stream in LAYOUTS else None
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is not None and f.attribute == ("source",):
                self.sources = named if self.sources is None else self.sources & named
            elif named is not None and f.attribute == ("kind",) and self.stream == "records":
                self.kinds = named if self.kinds is None else self.kinds & named
            elif clock is not None and getattr(f, "attribute", None) == clock:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[Part]:
        most = int(self.options.get("split_bytes", 128 << 20))
        whole = self.stream in ("records", "metadata", "faults")
        pieces, total = [], 0
        for source, length, path, start in listed(self.options):
            if self.sources is not None and source not in self.sources:
                continue
            parts = 1 if whole else max(1, -(-length // most))
            pieces += [(source, length, k, k + 1, parts, path, start) for k in range(parts)]
            total += length
        share = most
        if sum(p[4] > 1 for p in pieces) + total // most > TASKS:
            share = max(most, min(TASK_BYTES, -(-total // TASKS)))
        out, held, size = [], [], 0
        for p in pieces:
            one = -(-p[1] // p[4])
            if held and (size + one > share or share == most and (p[4] > 1 or held[-1][4] > 1)):
                out.append(Part(held))
                held, size = [], 0
            if held and held[-1][0] == p[0] and held[-1][3] == p[2]:  # parts that follow are read as one
                held[-1] = (*held[-1][:3], p[3], *p[4:])
            else:
                held.append(p)
            size += one
        return out + [Part(held)] * bool(held) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return shared(self.found(partition))

    def found(self, partition: Part) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        try:
            for source, length, first, last, parts, path, start in partition.pieces:
                if path != opened:
                    if file is not None:
                        file.close()
                    system, place = fs.FileSystem.from_uri(path)
                    file, opened = system.open_input_file(place), path
                data = Ranges(file, length, start)
                if length <= SMALL_BYTES and last - first == parts:
                    data = Ranges(io.BytesIO(data[0:length]), length)
                yield from self.pieces(source, data, first, last, parts)
        finally:
            if file is not None:
                file.close()

    def pieces(self, source: str, data: Ranges, first: int, last: int, parts: int) -> Iterator[pa.RecordBatch]:
        try:
            if self.stream == "faults":
                yield from self.faults(source, data)
            elif self.stream == "records":
                yield from self.records(source, data)
            elif self.stream == "metadata":
                yield from self.metadata(source, data)
            else:
                if self.skip:
                    check(data, self.stream)
                yield from self.rows(source, data, first, last, parts)
        except FormatError as broken:
            if not self.skip:
                raise FormatError(f"{source}: {broken}") from None

    def batch(self, source: str, found: dict[str, object], n: int) -> pa.RecordBatch:
        columns = [pa.array([source] * n if c == "source" else found[c], ARROW[self.kinds_of[c]]) for c in self.fields]
        return pa.RecordBatch.from_arrays(columns, names=self.fields)

    def records(self, source: str, data: Ranges) -> Iterator[pa.RecordBatch]:
        rows = [x for x in trailer.inventory_of(data) if self.kinds is None or x[0] in self.kinds]
        found = dict(zip(("kind", "encoding", "offset", "size", "has_header", "version"), zip(*rows, strict=True), strict=True)) if rows else {}
        if rows:
            yield self.batch(source, found | {"sha256": [digest(data, at, size) for _, _, at, size, _, _ in rows] if "sha256" in self.fields else None}, len(rows))

    def metadata(self, source: str, data: Ranges) -> Iterator[pa.RecordBatch]:
        rows = [(k, *x) for k, x in enumerate(message(data))]
        if rows:
            need(all(x[3] is None or x[3] < 1 << 63 for x in rows), "number above 63 bits")
            yield self.batch(source, dict(zip(("position", "number", "wire", "value", "payload"), zip(*rows, strict=True), strict=True)), len(rows))

    def rows(self, source: str, data: Ranges, part: int, end: int, parts: int) -> Iterator[pa.RecordBatch]:
        layout, found = placed(data, self.stream)
        if found is None:
            return
        start, n = found
        first, last = n * part // parts, n * end // parts
        if self.ordered and self.stream in LAYOUTS:
            first, last = within(data, layout, start, first, last, self.low, self.high)
        clock = Clock(data) if self.stream == "motion" else None
        for a in range(first, last, CHUNK_ROWS):
            b = min(last, a + CHUNK_ROWS)
            chunk = data[start + a * layout.width : start + b * layout.width]
            got = layout.decode(chunk if not layout.header else header_of(chunk))
            if clock is not None:
                before = data[start + (a - 1) * layout.width : start + a * layout.width] if a else b""
                got = clock.motion(got, layout.decode(before)["us"] if before else None)
            yield self.batch(source, got | {"sample": np.arange(a, b)}, b - a)

    def faults(self, source: str, data: Ranges) -> Iterator[pa.RecordBatch]:
        reason = None
        try:
            for stream in self.options.get("streams", ",".join((*LAYOUTS, "motion"))).split(","):
                if stream != "motion" or any(x[0] == trailer.METADATA for x in trailer.inventory_of(data)):
                    check(data, stream, ordered=stream != "gps")
        except FormatError as broken:
            reason = str(broken)
        if reason:
            yield self.batch(source, {"reason": [reason]}, 1)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, those of small batches together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def header_of(chunk: bytes) -> bytes:
    """A chunk of views behind the shortest header, as the decoder wants one."""
    return (4).to_bytes(4, "little") + chunk


def digest(data: Ranges, at: int, size: int) -> str:
    """The SHA-256 of a record, read in chunks."""
    out = hashlib.sha256()
    for a in range(at, at + size, CHUNK_BYTES):
        out.update(data[a : min(a + CHUNK_BYTES, at + size)])
    return out.hexdigest()


def message(data: Ranges) -> list[tuple]:
    """The fields of the metadata record; none without one."""
    for kind, _, at, size, _, _ in trailer.inventory_of(data):
        if kind == trailer.METADATA:
            need(size <= 1 << 20, "metadata above 1 MB")
            return trailer.wire_fields(data[at : at + size])
    return []


def placed(data: Ranges, stream: str) -> tuple[Layout, tuple[int, int] | None]:
    """The layout of a stream, and where its rows start and how many there are; None without its record."""
    layout = LAYOUTS["raw_motion" if stream == "motion" else stream]
    for kind, encoding, at, size, _, _ in trailer.inventory_of(data):
        if kind == layout.kind:
            need(encoding == 0, f"record {kind} is encoded")
            skip = 0
            if layout.header:
                need(size >= 4, "view header cut off")
                skip = int.from_bytes(data[at : at + 4], "little")
                need(4 <= skip <= min(size - 2 * layout.width, 1 << 20), "view header out of bounds")
            need(0 < size - skip and size <= layout.most and (size - skip) % layout.width == 0, f"{stream} must be whole rows of {layout.width} bytes")
            return layout, (at + skip, (size - skip) // layout.width)
    return layout, None


def within(data: Ranges, layout: Layout, start: int, first: int, last: int, low: int, high: int) -> tuple[int, int]:
    """The rows of a range whose clock is from low to high, by bisection of a clock that increases."""

    def cut(bound: int) -> int:
        """The first row with a clock of at least the bound."""
        a, b = first, last
        while a < b:
            m = (a + b) // 2
            at = start + m * layout.width
            a, b = (m + 1, b) if int.from_bytes(data[at : at + 8], "little") < bound else (a, m)
        return a

    return cut(max(low, 0)) if low > 0 else first, cut(high + 1) if high < (1 << 63) - 1 else last


class Clock:
    """The first frame's time and the motion sensor's ranges, from the metadata; counts become units."""

    def __init__(self, data: Ranges):
        fields = message(data)
        of = lambda number, wire: [x for x in fields if x[0] == number and x[1] == wire]
        first, ranges = of(FIRST_FRAME, 0), of(MOTION_RANGES, 2)
        need(len(first) == 1 and len(ranges) == 1, "no first frame or no motion ranges")
        inner = {x[0]: x[2] for x in trailer.wire_fields(ranges[0][3]) if x[1] == 0}
        self.origin, self.g, self.degrees = first[0][2], inner.get(1), inner.get(2)
        need(self.degrees in GYRO_RANGES and isinstance(self.g, int) and 0 < self.g <= 64, "unknown motion range")

    def motion(self, counts: dict[str, np.ndarray], before: np.ndarray | None) -> dict[str, np.ndarray]:
        """Seconds from the first frame, g and radians a second. before: the clock of the row above. Steps must be above 0 and up to 10 ms, and no turn at the edge of its range."""
        us = counts["us"] if before is None else np.concatenate([before, counts["us"]])
        step = np.diff(us)
        need(bool((step > 0).all()), "motion clock does not increase")
        need(not len(step) or int(step.max()) <= 10_001, "gap in the motion clock")
        turns = {k: counts[k].astype(float) for k in ("gx", "gy", "gz")}
        need(all(bool(((x >= 8) & (x <= 65527)).all()) for x in turns.values()), "motion is saturated")
        scaled = lambda x, most: (x - 32768) * most / 32768
        out = {"t": (counts["us"] - self.origin) / 1e6}
        out |= {f"w{c}": np.radians(scaled(turns[f"g{c}"], self.degrees)) for c in "xyz"}
        return out | {f"a{c}": scaled(counts[f"a{c}"].astype(float), self.g) for c in "xyz"}


def check(data: Ranges, stream: str, ordered: bool = False) -> None:
    """Reads a stream through, chunk by chunk, for its rules; those of the rate too, of motion. ordered: the clock must increase."""
    layout, found = placed(data, stream)
    if found is None:
        return
    start, n = found
    clock, before, steps = Clock(data) if stream == "motion" else None, None, []
    need(stream != "motion" or n >= 100, "fewer than 100 samples of motion")
    for a in range(0, n, CHUNK_ROWS):
        chunk = data[start + a * layout.width : start + min(n, a + CHUNK_ROWS) * layout.width]
        got = layout.decode(chunk if not layout.header else header_of(chunk))
        us = got[layout.clock]
        if clock is not None:
            clock.motion(got, before)
        if ordered:
            need(bool((np.diff(us if before is None else np.concatenate([before, us])) > 0).all()), f"{stream} clock does not increase")
        if clock is not None:
            steps.append(np.bincount(np.diff(us), minlength=10_002))  # steps are whole microseconds up to 10,001
        before = us[-1:]
    if clock is not None:
        counts = np.cumsum(np.sum(steps, axis=0))
        median = int(np.searchsorted(counts, (counts[-1] + 1) // 2)) if counts[-1] else 0
        need(median > 0 and 200 <= 1e6 / median <= 2000, "unsupported motion rate")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)


def scan(spark: SparkSession, stream: str, columns: str | None = None, **options) -> DataFrame:
    """The rows of a stream; columns: those wanted, with types, as in a schema. options: path or manifest, and others of RecordingSource."""
    register(spark)
    reader = spark.read.format("solstice.recording").option("stream", stream).options(**options)
    return (reader.schema(columns) if columns else reader).load()
