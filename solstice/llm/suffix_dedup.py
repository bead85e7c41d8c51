"""Repeated byte strings by distributed prefix doubling from sampled positions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import mix, powers, row_slices, sums, text_bytes, windows
from .shared import arrow_batches, bound_batches, materialize

#: Texts are taken in slices of about so many bytes; positions in a slice have so many bits.
SLICE, PLACE = 1 << 20, np.uint64((1 << 21) - 1)
#: Texts that a task holds at once.
BATCH = 1000
#: rank: of the half string. place: see packed(); with SURE, if the half string is in the batch twice; MARK for the half string alone.
SPOT = np.dtype([("rank", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("place", "<i8")])
SURE, MARK = np.int64(1 << 62), np.int64(-1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def spots(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts (text r is data[ends[r]:ends[r + 1]]): rank, text, at, n, d of each sampled position.

    Every string of `size` bytes is represented by the half string (size // 2 bytes) in it with
    the least hash, the last one of equals. Equal strings are so by equal halves at
    the same distance. A sampled position stands for the n strings that start at
    `at` and behind it; it lies d bytes behind `at`. Its rank is a 64-bit fingerprint of its half string.
    """
    half = size // 2
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none.astype(np.uint64), none, none, none, none
    ranks = windows(sums(data), half)
    place = np.arange(len(ranks), dtype=np.uint64)
    least = sliding_least((ranks & ~PLACE) | (PLACE - place), size - half + 1)
    text_end = np.repeat(ends[1:], np.diff(ends))[: len(least)]
    starts = np.flatnonzero(text_end - np.arange(len(least)) >= size)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none
    chosen = (PLACE - (least[starts] & PLACE)).astype(np.int64)
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1) | (text_end[starts[1:]] != text_end[starts[:-1]]))
    first = np.flatnonzero(new)
    at = starts[first]
    text = np.searchsorted(ends, at, "right") - 1
    return ranks[chosen[first]], text, at - ends[text], np.diff(np.append(first, len(starts))), chosen[first] - at


def packed(at: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return (at << 16 | n << 8 | d).astype(np.int64)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def all_spots(column: pa.Array, k1: np.ndarray, k2: np.ndarray, size: int) -> np.ndarray:
    """SPOT rows of a column of texts. Texts longer than a slice are taken in parts that overlap by size - 1 bytes."""
    data, offsets = text_bytes(column)
    found = []
    for a, b in row_slices(offsets, SLICE):
        low, high = offsets[a], offsets[b]
        if high - low <= SLICE + size:
            parts = [(0, data[low:high], offsets[a : b + 1] - low)]
        else:  # one long text
            cuts = range(0, int(high - low) - size + 1, SLICE)
            parts = [(c, x := data[low + c : min(high, low + c + SLICE + size - 1)], np.array([0, len(x)])) for c in cuts]
        for shift, part, ends in parts:
            rank, text, at, n, d = spots(part, ends, size)
            rows = np.zeros(len(rank), SPOT)
            rows["rank"], rows["k1"], rows["k2"], rows["place"] = rank, k1[a + text], k2[a + text], packed(at + shift, n, d)
            found.append(rows)
    return np.concatenate(found) if found else np.zeros(0, SPOT)


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorting order by the keys, where groups begin in it, and the size of each row's group, in that order."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    return order, first, np.repeat(count, count)


def repeated_spots(docs: DataFrame, size: int) -> DataFrame:
    """(k1, k2, place): the sampled positions whose half string is at another one as well. An exact filter before the doubling.

    What is unique at half the length cannot repeat at the full one and is dropped. Tasks pack what goes to a bucket into one row. A half string that a batch has twice is repeated for
    certain: its positions go to any buckets, and one mark of it to its own, so a bucket gets each half string once from a batch at most.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        for batch in batches:
            rows = all_spots(batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy(), size)
            order, first, count = groups_of(rows["rank"])
            rows = rows[order]
            marks = rows[first][count[first] > 1]
            marks["place"] = MARK
            bucket = mix(np.where(count > 1, rows["rank"] ^ mix(rows["place"].astype(np.uint64) + rows["k1"].astype(np.uint64)), rows["rank"]))
            rows["place"] |= np.where(count > 1, SURE, 0)
            rows = np.concatenate([rows, marks])
            bucket = (np.concatenate([bucket, mix(marks["rank"])]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, cuts = rows[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "rows": pa.array([rows[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())})

    def sift(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), SPOT) for x in table.column("rows")])
        sure = (rows["place"] != MARK) & (rows["place"] & SURE > 0)
        rest = rows[~sure]
        order, first, count = groups_of(rest["rank"])
        rest = rest[order]
        marked = np.zeros(len(rest), np.int64)
        if len(first):
            marked = np.repeat(np.add.reduceat(rest["place"] == MARK, first), np.diff(np.append(first, len(rest))))
        rest = rest[((count > 1) | (marked > 0)) & (rest["place"] != MARK)]
        kept = np.concatenate([rows[sure], rest])
        return pa.table({"k1": kept["k1"], "k2": kept["k2"], "place": kept["place"] & ~SURE})

    return docs.select("k1", "k2", "text").mapInArrow(pack, "bucket int, rows binary").groupBy("bucket").applyInArrow(sift, "k1 long, k2 long, place long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, packed): compressed texts, for joins by key."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([zlib.compress((x.as_py() or "").encode(), 1) for x in batch.column(2)], pa.binary())], names=["k1", "k2", "packed"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, packed binary")


RANKS = np.dtype([("r1", "<i8"), ("r2", "<i8"), ("salt", "<i8"), ("whole", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("place", "<i8"), ("many", "?"), ("old", "?")])


def rank_pairs(data: np.ndarray, base: np.ndarray, place: np.ndarray, size: int, width: int) -> tuple[np.ndarray, ...]:
    """Of sets of neighbouring strings, cut where the distance of their starts to the sampled position passes a multiple of `width`: which
    set a part comes from, the rank pair of its core, the fingerprint of all its bytes, and its place.

    data: joined texts; base: where each set's text begins. The core is what all strings of a whole part have in common, size - width + 1 bytes: its
    rank is the pair of the ranks of its first and its last half string.
    """
    half = size // 2
    at, n, d = unpacked(place)
    low, high = (d - n + 1) // width, d // width
    parts = high - low + 1
    owner = np.repeat(np.arange(len(place)), parts)
    cell = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    top = np.minimum(d[owner], cell * width + width - 1)
    count = top - np.maximum((d - n + 1)[owner], cell * width) + 1
    start = at[owner] + d[owner] - top
    total = sums(data)
    inverse = powers(len(total))[1]
    of = lambda a, length: mix((total[a + length] - total[a]) * inverse[a])
    first = base[owner] + start
    core = first + top - cell * width
    whole = mix(of(first, count - 1 + size) + (count << 8 | top).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return owner, of(core, half), of(core + (size - width + 1) - half, half), whole, packed(start, count, top)


def ranked(texts: DataFrame, size: int, width: int) -> DataFrame:
    """RANKS rows of the sets of texts (k1, k2, packed, sets array<struct<place,many>>), cut to parts of `width`.

    A core that a batch has twice is repeated for certain. Its parts are told apart by a salt, of equal ones all but the first by any salt, and a mark of the
    core goes to salt 0 (those others have negative ones): so of a core, and of each of its parts, a batch sends one row to a group at most, however common they are.
    """

    def run(batches):
        for batch in batches:
            found, buffer, sets = [], [], []
            filled = 0

            def flush():
                nonlocal filled
                if sets:
                    base, place, many, k1, k2 = (np.concatenate(x) for x in zip(*sets, strict=True))
                    owner, r1, r2, whole, places = rank_pairs(np.frombuffer(b"".join(buffer), np.uint8), base, place, size, width)
                    rows = np.zeros(len(owner), RANKS)
                    rows["r1"], rows["r2"], rows["whole"], rows["place"] = r1.astype(np.int64), r2.astype(np.int64), whole.astype(np.int64), places
                    rows["k1"], rows["k2"], rows["many"], rows["old"] = k1[owner], k2[owner], many[owner], many[owner]
                    found.append(rows)
                buffer.clear()
                sets.clear()
                filled = 0

            for k1, k2, text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = zlib.decompress(text.as_py())
                place, many = np.array([x["place"] for x in some], np.int64), np.array([x["many"] for x in some], bool)
                for cut in range(0, max(1, len(data)), SLICE):  # a long text in parts
                    here = place >> 16
                    here = (here >= cut) & (here < cut + SLICE)
                    if here.any():
                        part = data[cut : cut + SLICE + 2 * size]
                        k = int(here.sum())
                        sets.append((np.full(k, filled - cut), place[here], many[here], np.full(k, k1), np.full(k, k2)))
                        buffer.append(part)
                        filled += len(part)
                        if filled >= SLICE:
                            flush()
            flush()
            if found:
                yield pa.RecordBatch.from_pandas(salted(np.concatenate(found)), preserve_index=False)

    def salted(rows: np.ndarray):
        import pandas as pd

        order, first, count = groups_of(rows["r1"], rows["r2"])
        rows, sure = rows[order], count > 1
        marks = rows[first][sure[first]]
        order, begins, same = groups_of(rows["r1"], rows["r2"], rows["whole"])
        rows, sure = rows[order], sure[order]
        rows["many"] |= same > 1
        lead = np.zeros(len(rows), bool)
        lead[begins] = True
        salt = mix(rows["whole"].astype(np.uint64) + np.where(lead, np.uint64(0), mix(rows["place"].astype(np.uint64) + rows["k1"].astype(np.uint64))))
        salt = (salt >> np.uint64(1) | np.uint64(1)).astype(np.int64)
        rows["salt"] = np.where(sure, np.where(lead, salt, -salt), 0)
        out = pd.DataFrame({c: np.concatenate([rows[c], marks[c]]) for c in RANKS.names})
        out["mark"] = np.arange(len(out)) >= len(rows)
        out.loc[out["mark"], "salt"] = 0
        return out

    kinds = "r1 long, r2 long, salt long, whole long, k1 long, k2 long, place long, many boolean, old boolean, mark boolean"
    return texts.mapInArrow(run, kinds)


def doubled(rows: DataFrame, last: bool) -> DataFrame:
    """(k1, k2, place, many, found, on) of ranked(): Spark sorts them by rank pair; parts of a unique core are dropped.

    many: all strings of the part repeat (the part is somewhere else as well). found: that is known only now. on: it goes on to longer cores; of equal parts that
    are known one does, for the others to meet it, and only where a part of the core isn't known.
    """
    core, part = W.partitionBy("r1", "r2", "salt"), W.partitionBy("r1", "r2", "salt", "whole")
    rows = rows.withColumns(
        {
            "_n": F.count("*").over(core), "_open": F.count_if(~F.col("many") | F.col("mark")).over(core),
            "_same": F.sum(F.when(F.col("mark"), 2 if last else 0).when(F.col("many"), 2).otherwise(1)).over(part), "_k": F.row_number().over(part.orderBy("mark", "k1", "place")),
        }
    ).where("not mark")
    rows = rows.withColumn("_many", F.col("many") | (F.col("_same") > 1))
    waits = (F.col("_k") == 1) & ((F.col("_open") > 0) | (F.col("salt") > 0))
    on = F.lit(False) if last else (F.col("salt") >= 0) & ((F.col("salt") > 0) | (F.col("_n") > 1)) & (~F.col("_many") | waits)
    out = rows.select("k1", "k2", "place", F.col("_many").alias("many"), (F.col("_many") & ~F.col("old")).alias("found"), on.alias("on"))
    return out.where("found or on")


def removed_runs(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs [start, end) of what the spans cover; spans that touch are one run."""
    start = end = -1
    for a, b in sorted(spans):
        if a > end:
            if end > start:
                yield start, end
            start, end = a, b
        end = max(end, b)
    if end > start:
        yield start, end


def widths(half: int) -> list[int]:
    """Of the parts in each round, down to single strings."""
    return list(dict.fromkeys([half + 1, *(int(np.ceil((half + 1) ** p)) for p in (2 / 3, 1 / 3)), 1]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept binary (the rest of its UTF-8 bytes).

    Each byte goes that is covered by a string of `size` bytes (an even number up to 500) which also starts
    elsewhere in any row, the same one included. Strings do not cross rows, are
    judged on the input, and overlaps count. Null texts are empty; repeated rows
    are rows of their own, so all their strings repeat. No rows give no rows; other
    columns are ignored. A row's key is a 128-bit hash of id and text.

    Prefix doubling from sampled positions, so that no repeat is missed. All strings that a sampled position stands for have a core in
    common. In rounds Spark sorts the cores by rank pairs, of their first half string and of the one at an offset, which grows from round to round until the core is the whole
    string; unique cores are dropped. Strings of a core that is somewhere else go on in smaller parts with longer cores, unless
    the part as a whole is somewhere else, which settles all its strings.
    """
    if size % 2 or not 2 <= size <= 500:
        raise ValueError("the size must be an even number of 2 to 500 bytes")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(1), "text", "id")})
    texts, results = packed_texts(docs), []
    with arrow_batches(spark, BATCH):
        sets = repeated_spots(docs, size).withColumn("many", F.lit(False))
        for width in widths(size // 2):
            sets = sets.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "many")).alias("sets"))
            sets = materialize(sets, "repeat-sets")
            rows = doubled(ranked(texts.join(sets, ["k1", "k2"]), size, width), width == 1)
            rows = materialize(rows, "repeat-ranks")
            results.append(rows.where("found").select("k1", "k2", "place"))
            sets = rows.where("on").select("k1", "k2", "place", "many")
        found = results[0]
        for more in results[1:]:
            found = found.unionByName(more)
        spans = materialize(found.groupBy("k1", "k2").agg(F.collect_set("place").alias("places")), "repeat-spans")

    def cut(batches):
        for batch in (whole.slice(a, BATCH) for whole in batches for a in range(0, whole.num_rows, BATCH)):
            n, gone, runs, rest = [], [], [], []
            for text, places in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = zlib.decompress(text.as_py())
                where = list(removed_runs([(x >> 16, (x >> 16) + (x >> 8 & 255) - 1 + size) for x in places or []]))
                kept, at = [], 0
                for a, b in where:
                    kept.append(data[at:a])
                    at = b
                n.append(len(data))
                gone.append(sum(b - a for a, b in where))
                runs.append(len(where))
                rest.append(b"".join([*kept, data[at:]]))
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([zlib.compress((x.as_py() or "").encode(), 1) for x in batch.column(3)], pa.binary())], names=["id", "k1", "k2", "packed"])

    rows = docs.select("id", "k1", "k2", "text").mapInArrow(pack, f"id {kind}, k1 long, k2 long, packed binary")
    return rows.join(spans, ["k1", "k2"], "left").select("id", "packed", "places").mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
