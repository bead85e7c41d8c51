"""Near-duplicate vectors by tiled comparison along principal axes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, materialize, new_path

#: Vectors in a tile, about; and rows and columns of a tile pair that are compared at once.
TILE, STRIP, WIDTH = 4096, 512, 512
#: Tiles that a row of work compares one tile with; and tasks that the rows of work are dealt to, at most.
RUN, TASKS = 8, 4096
#: The part of the axes, leading ones, whose products bound a cosine.
LEADING = 7 / 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all zero, to length 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """The axes of the unit vectors' second moments, largest first; the driver gets dims * dims sums."""

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = unit(rows_of(batch.column(0), dims))
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(dims * dims, dtype=np.int32), "x": total.ravel()})

    sums = vectors.select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    matrix = np.zeros(dims * dims)
    matrix[sums["i"].to_numpy()] = sums["x"].to_numpy()
    _, axes = np.linalg.eigh(matrix.reshape(dims, dims))
    return axes[:, ::-1].copy()


class Side(NamedTuple):
    """What a tile's vectors are compared by: the unit vectors, in single precision too, and their leading axes with the length of the rest as one more."""

    exact: np.ndarray
    single: np.ndarray
    leading: np.ndarray


def side(x: np.ndarray, axes: np.ndarray) -> Side:
    x = unit(x)
    k = math.ceil(x.shape[1] * LEADING)
    along = x @ axes
    return Side(x, x.astype(np.float32), np.column_stack([along[:, :k], np.sqrt((along[:, k:] ** 2).sum(axis=1))]).astype(np.float32))


def true_at(mask: np.ndarray) -> np.ndarray:
    """Where a mask is true, in its flat order: eight of a sparse one at a time."""
    flat = mask.ravel()
    cut = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:cut].view(np.uint64))
    if len(some) * 32 > cut:
        return np.flatnonzero(flat)
    at = (some[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], cut + np.flatnonzero(flat[cut:])])


def linked(a: Side, b: Side, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b with cosine >= threshold (of one tile with itself: i < j).

    What the axes behind the leading ones can add is at most the product of the rows' lengths
    along them: pairs that cannot reach the threshold are left after one product in single precision. The rest get their
    whole cosine in it, and in double precision, of the given components, where that is too near to the threshold to tell.
    """
    slack = 1e-5 + 2.4e-7 * a.exact.shape[1]  # above the rounding of single precision
    least = np.float32(threshold - slack)
    right = b.leading.T.copy()
    for s in range(0, len(a.exact), STRIP):
        for t in range(s // WIDTH * WIDTH if same else 0, len(b.exact), WIDTH):
            rows, cols = slice(s, s + STRIP), slice(t, t + WIDTH)
            bound = a.leading[rows] @ right[:, cols]
            at = true_at(bound >= least)
            if len(at) * 16 > bound.size:
                whole = a.single[rows] @ b.single[cols].T
                at = np.flatnonzero(whole >= least)
                cosine = whole.ravel()[at]
                ii, jj = np.divmod(at, whole.shape[1])
                ii, jj = ii + s, jj + t
            elif len(at):
                ii, jj = np.divmod(at, bound.shape[1])
                ii, jj = ii + s, jj + t
                cosine = np.einsum("ij,ij->i", a.single[ii], b.single[jj])
            else:
                continue
            keep = cosine >= np.float32(threshold + slack)
            near = np.flatnonzero(~keep & (cosine >= least))
            keep[near] = (a.exact[ii[near]] * b.exact[jj[near]]).sum(axis=1) >= threshold
            if same:
                keep &= ii < jj
            if keep.any():
                yield ii[keep], jj[keep]


def least_labels(n: int, ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[ii], label[jj])
        new = label.copy()
        np.minimum.at(new, ii, low)
        np.minimum.at(new, jj, low)
        np.minimum.at(new, label[ii], low)
        np.minimum.at(new, label[jj], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def read_tile(files: fs.FileSystem, path: str, dims: int, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, copies, vectors) of a tile's file; none without one."""
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims))
    with files.open_input_file(path) as file:
        data = file.read()
    n = len(data) // (16 + dims * (4 if single else 8))
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.float32 if single else np.float64, n * dims, 16 * n).reshape(-1, dims)


def compare_tiles(work: DataFrame, folder: str, axes: np.ndarray, dims: int, single: bool, threshold: float) -> DataFrame:
    """(id, degree, to): per vector with links in a pair of tiles, how many rows it links with, and the smallest id of its local component.

    work: tile i and the tiles first to last. A task reads them from the shared folder, so only their numbers are dealt out. A tile pair returns at most a row for
    each of its vectors, however many links there are.
    """

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for i, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = read(files, f"{root}/{i}")
                for j in range(first, last + 1):
                    other = one if i == j else read(files, f"{root}/{j}")
                    if len(other[0]):
                        yield from compared(one, other, i == j)

    def read(files, path):
        ids, copies, x = read_tile(files, path, dims, single)
        return ids, copies, side(x, axes) if len(ids) else None

    def compared(one, other, same):
        sides = [one] if same else [one, other]
        ids, copies = (np.concatenate([x[k] for x in sides]) for k in (0, 1))
        shift = 0 if same else len(one[0])
        degree, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        order = np.argsort(ids)  # labels by rank, so that the smallest label is the smallest id
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        for ii, jj in linked(one[2], sides[-1][2], threshold, same):
            jj = jj + shift
            # Sums of doubles are exact to 2^53 copies.
            degree += np.bincount(ii, copies[jj], len(ids)).astype(np.int64) + np.bincount(jj, copies[ii], len(ids)).astype(np.int64)
            p, q = rank[ii], rank[jj]
            far = label[p] != label[q]
            if far.any():
                label = least_labels(len(ids), np.concatenate([p[far], np.arange(len(ids))]), np.concatenate([q[far], label]))
        found = np.flatnonzero(degree)
        if len(found):
            yield pa.RecordBatch.from_pydict({"id": ids[found], "degree": degree[found], "to": ids[order[label[rank[found]]]]})

    return work.mapInArrow(run, "id long, degree long, to long")


def _links(vectors: DataFrame, dims: int, single: bool, threshold: float, tile: int) -> DataFrame:
    """compare_tiles() of the distinct vectors (id, copies, v) of one length."""
    spark = vectors.sparkSession
    axes = principal_axes(vectors, dims)

    def first_axis(batches):
        for batch in batches:
            x = np.clip(unit(rows_of(batch.column(2), dims)) @ axes[:, 0], -1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arccos(x))], names=["id", "copies", "v", "angle"])

    number = "float" if single else "double"
    placed = vectors.select("id", "copies", "v").mapInArrow(first_axis, f"id long, copies long, v array<{number}>, angle double")
    # Equal angles are divided by a hash far below what matters to the bound.
    placed = materialize(placed.withColumn("angle", F.col("angle") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * 1e-13), "vectors-placed")
    parts = max(1, round(placed.count() / tile))
    cuts = sorted(set(placed.approxQuantile("angle", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []

    def tiles(batches):
        edges = np.array(cuts)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(3).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["id", "copies", "v", "angle", "tile"])

    folder = new_path(spark, "vector-tiles")

    def write(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        angle, tile = table["angle"].to_numpy(), table["tile"][0].as_py()
        v = rows_of(table["v"].chunk(0) if table["v"].num_chunks else table["v"], dims)
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{tile}") as file:
            for part in (table["id"].to_numpy(), table["copies"].to_numpy(), np.ascontiguousarray(v, np.float32 if single else np.float64)):
                file.write(part.tobytes())
        return pa.table({"tile": pa.array([tile], pa.int32()), "low": [angle.min()], "high": [angle.max()]})

    dealt = placed.mapInArrow(tiles, f"id long, copies long, v array<{number}>, angle double, tile int")
    # Tiles are ranges of the angle to the first axis; vectors further apart in it than this have a smaller cosine.
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    known = dealt.groupBy("tile").applyInArrow(write, "tile int, low double, high double").toPandas().sort_values("tile")
    order = known["tile"].to_numpy()
    last = order[np.searchsorted(known["low"].to_numpy(), known["high"].to_numpy() + reach, "right") - 1]
    spans = spark.createDataFrame([(int(i), int(j)) for i, j in zip(order, last, strict=True)], "i int, last int")
    runs = spans.select("i", F.explode(F.sequence("i", "last", F.lit(RUN))).alias("first"), "last")
    runs = runs.select("i", "first", F.least("last", F.col("first") + RUN - 1).alias("last"))
    # Rows of work are short, so tasks are counted by them and not by bytes, which AQE would gather in one.
    count = sum((int(j) - int(i)) // RUN + 1 for i, j in zip(order, last, strict=True))
    return compare_tiles(runs.repartition(min(count, TASKS)), folder, axes, dims, single, threshold)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links (other rows with cosine >= threshold), component_id (smallest id reachable), kept (it is its own component's id).

    Ids are whole numbers. Vectors that are null, empty, all zero or hold null or non-finite components
    link with nothing, nor do rows without an id; vectors of different lengths don't link
    (up to 16 lengths). Equal vectors, repeated rows included, are compared once and
    counted as often as they occur. No rows give no rows. Other columns are ignored.

    All pairs of tiles that the first axis does not rule out are compared: the
    result is exact, and the work is quadratic where vectors spread evenly. Tiles are files that tasks
    read, so what is shuffled grows with the vectors only. Each tile
    pair returns counts and a spanning part of its links, never all its pairs.
    """
    single = rows.schema[vec_col].dataType.elementType.simpleString() == "float"
    number = "float" if single else "double"
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{number}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("v", F.when(good, F.transform("v", lambda x: x + F.lit(0).cast(number)))), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = materialize(classes, "vector-classes")
    sizes = sorted(x.n for x in classes.select(F.size("v").alias("n")).distinct().limit(17).collect())
    if len(sizes) > 16:
        raise ValueError("vectors of more than 16 lengths")
    found = None
    for dims in sizes:
        part = _links(classes.where(F.size("v") == dims), dims, single, threshold, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = materialize(found, "vector-links")
    degree = found.groupBy("id").agg(F.sum("degree").alias("degree"))
    groups = connected_components(found.select(F.col("id").alias("src"), F.col("to").alias("dst")))
    classes = classes.join(degree, "id", "left").join(groups, "id", "left")
    classes = classes.select("v", F.coalesce("degree", F.lit(0)).alias("degree"), "copies", F.coalesce("component", "id").alias("component"))
    classes = materialize(classes, "vector-results")
    # A join sorts by the hash; rows that are no vector have one of their own.
    key = F.when(F.col("v").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("v"))
    out = rows.withColumn("h", key).join(classes.withColumn("h", F.xxhash64("v")), ["h", "v"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce(F.col("degree") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
with recursive v as (
    select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, m.component_id, e.vec_id = m.component_id as kept
from embeddings e join (select a as vec_id, min(b) as component_id from reach group by a) m using (vec_id)
"""
