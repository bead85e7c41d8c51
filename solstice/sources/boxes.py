"""MP4 boxes of files as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Boxes that hold other boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta"})


def boxes_of(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, offset, size) of each box, parents before children. Sizes below 8 or beyond the parent are refused."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("box cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and end - start >= 16:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} out of bounds")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, start, size
        if kind in CONTAINERS:
            yield from boxes_of(data, start + head, start + size, name)
        start += size


def boxes(files: DataFrame) -> DataFrame:
    """(source, path, offset, size) of the boxes of each file (source, content)."""

    def run(batches):
        for batch in batches:
            rows = [{"source": s.as_py(), "path": p, "offset": o, "size": n} for s, c in zip(batch.column(0), batch.column(1), strict=True) for p, o, n in boxes_of(c.as_py())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("source", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
    return files.select("source", "content").mapInArrow(run, "source string, path string, offset long, size long")
