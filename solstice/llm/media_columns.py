"""Media columns: content-addressed payloads in tar shards, with metadata from header-only reads."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_batches, materialize, new_path

#: Payloads are padded to whole rows of so many samples; a shard ends after so many bytes.
WIDTH, SHARD_BYTES = 192, 256 << 20
#: Fixed values of the PNG format: its first bytes, and the bytes up to the end of the header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """data with spaces behind, up to a positive multiple of width."""
    return data + b" " * (-len(data) % width if data else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey image, a row for each `width` bytes of the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each row begins with filter 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no image header where the row points to")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The payload of an image that to_png() made."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, body = HEADER_BYTES, b""
    while data[at + 4 : at + 8] != b"IEND":
        size = struct.unpack(">I", data[at : at + 4])[0]
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a stored image is damaged")
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes, width: int = WIDTH) -> str:
    """Sum, sum of squares and total horizontal change of the samples, and a 64-bit hash of which of 8 x 8 areas are lighter than all."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width).astype(np.int64)
    sums, squares, change = int(image.sum()), int((image * image).sum()), int(np.abs(np.diff(image, axis=1)).sum())
    columns = image.reshape(len(image), 8, width // 8).sum(axis=2)
    edges = [k * len(image) // 8 for k in range(9)]
    bits = 0
    for k in range(8):
        area = columns[edges[k] : max(edges[k + 1], edges[k] + 1)]
        for x in area.sum(axis=0):
            bits = bits << 1 | int(int(x) * image.size > sums * len(area) * (width // 8))
    return f"sum={sums};squares={squares};change={change};areas={bits:016x}"


class ShardWriter:
    """Writes tar shards of one task; a payload that it has written already is not written again."""

    def __init__(self, folder: str, most: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder)
        self.most, self.out, self.at, self.known = most, None, 0, {}

    def add(self, digest: bytes, data: bytes) -> tuple[str, int]:
        """(shard, offset of the data)."""
        if digest in self.known:
            return self.known[digest]
        if self.out is not None and self.at > self.most:
            self.close()
        if self.out is None:
            context = TaskContext.get()
            self.name, self.at = f"{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}.tar", 0
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(digest.hex() + ".png")
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % 512))
        place = self.name, self.at + 512
        self.at += 512 + len(data) + -len(data) % 512
        self.known[digest] = place
        return place

    def close(self) -> None:
        """Two empty blocks end an archive. What was remembered goes with the shard, so memory stays bounded."""
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
        self.out, self.known = None, {}


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores each row's text as an image in tar shards below folder, a URI that all executors share.

    Returns per row: id, n_bytes, digest (SHA-256 of the
    stored image: its address), shard, offset, length. The payload is the text in UTF-8 with
    spaces up to a positive multiple of width; null is empty. No payload passes
    through a shuffle: each task writes its own shards, each payload once to a
    shard; places() names one place for a payload that several tasks met. A
    retried task writes new shards; no row points to those of the lost attempt.
    """

    def run(batches):
        writer = ShardWriter(folder, shard_bytes)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                payload = pad(data, width)
                media = to_png(payload, width)
                digest = hashlib.sha256(media).digest()
                rows.append((len(data), digest, *writer.add(digest, media), len(media)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["id", *names])
        writer.close()

    names = ["n_bytes", "digest", "shard", "offset", "length"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # Written out, so that a lost executor never makes a shard be written again that rows point to already.
    with arrow_batches(docs.sparkSession, 1000):
        return materialize(rows.mapInArrow(run, f"id {kind}, n_bytes long, digest binary, shard string, offset long, length long"), "media-rows")


def places(stored: DataFrame) -> DataFrame:
    """One (digest, shard, offset, length) per digest, the first; dealt out in the order in which they lie in the shards."""
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("digest", "at.*").repartitionByRange(parts, "shard", "offset")


def _read(folder: str, batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[bytes, bytes]]:
    """(digest, data) of each place; at most `most` bytes of each are read."""
    files, root = fs.FileSystem.from_uri(folder)
    name, file = None, None
    for batch in batches:
        for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != name:
                if file is not None:
                    file.close()
                name, file = shard, files.open_input_file(f"{root}/{shard}")
            file.seek(offset)
            yield digest, file.read(length if most is None else min(most, length))
    if file is not None:
        file.close()


def _rows(found: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while rows := list(islice(found, size)):
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)


def header_columns(at: DataFrame, folder: str) -> DataFrame:
    """Per place: digest, width, height, bits; only the first HEADER_BYTES bytes of each image are read."""
    schema = pa.schema([("digest", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32())])

    def run(batches):
        yield from _rows(((d, *png_header(x)) for d, x in _read(folder, batches, HEADER_BYTES)), schema)

    return at.select("digest", "shard", "offset", "length").mapInArrow(run, "digest binary, width int, height int, bits int")


def payload_columns(at: DataFrame, folder: str) -> DataFrame:
    """Per place, from the bytes read back: digest, and payload_bytes, read_sha256, tail_crc32, feature of the payload.

    An image that is not what its digest says fails.
    """
    schema = pa.schema([("digest", pa.binary()), ("payload_bytes", pa.int64()), ("read_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("feature", pa.string())])

    def one(digest: bytes, data: bytes) -> tuple:
        if hashlib.sha256(data).digest() != digest:
            raise ValueError(f"stored bytes differ from their digest {digest.hex()}")
        payload = from_png(data)
        return digest, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), feature(payload)

    def run(batches):
        yield from _rows((one(*x) for x in _read(folder, batches, None)), schema)

    return at.select("digest", "shard", "offset", "length").mapInArrow(run, "digest binary, payload_bytes long, read_sha256 binary, tail_crc32 long, feature string")


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, the place and digest of its stored image, and its metadata and payload columns.

    Columns: id, n_bytes, digest, shard, offset, length, width, height, bits,
    payload_bytes, read_sha256, tail_crc32, feature; both hashes in lower-case hexadecimal. Null texts
    are empty texts: one row of spaces. Repeated rows and equal texts share one
    place. No rows give no rows. Other columns of docs are ignored, whatever their names.

    All that is read is found once per digest and then joined to the rows; that join's
    inputs are plain shuffles, so Spark splits a digest with very many rows.
    """
    folder = folder or new_path(docs.sparkSession, "media")
    stored = store(docs, folder, id_col, text_col)
    at = materialize(places(stored), "media-places")
    found = at.join(header_columns(at, folder), "digest").join(payload_columns(at, folder), "digest")
    found = materialize(found.drop("length"), "media-found")
    out = stored.drop("shard", "offset").join(found, "digest")
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("digest", "read_sha256")})


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", F.col("read_sha256").alias("payload_sha256"), "tail_crc32",
        F.col("length").alias("media_bytes"), F.col("digest").alias("media_sha256"), "feature", "width", "height",
    )
