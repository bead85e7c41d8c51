"""The two nearest vectors of each query, exactly, without comparing all: pivots bound what tiles can hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .recurrence import numbered

#: Pivots of a block, and vectors of a tile.
PIVOTS, TILE = 8, 500


def matrix(packed: list[bytes]) -> np.ndarray:
    """Vectors as rows, from their packed doubles."""
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def pivots_of(base: DataFrame, count: int) -> DataFrame:
    """(block, pivots): vectors of the block, each the one of the least hash under a seed of its own, so no block is gathered."""
    return base.groupBy("block").agg(F.array(*[F.min(F.struct(F.xxhash64(F.lit(k), "item").alias("h"), "v"))["v"] for k in range(count)]).alias("pivots"))


def placed(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """rows (block, item, v) with cell (the nearest pivot), own (how far it is) and far (packed distances to all pivots). Rows of a block without pivots are left out."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("block", "item")}

    def run(batches):
        for batch in batches:
            blocks, points = batch.column("block").to_pylist(), batch.column("v").to_pylist()
            starts = [k for k in range(len(blocks)) if not k or blocks[k] != blocks[k - 1]]
            found = []
            for a, z in zip(starts, [*starts[1:], len(blocks)], strict=True):  # rows of one block
                v, centres = matrix(points[a:z]), matrix(batch.column("pivots")[a].as_py())
                found.append(np.stack([np.sqrt(((v - c) ** 2).sum(axis=1)) for c in centres], axis=1))
            far = np.concatenate(found) if found else np.zeros((0, 1))
            made = [pa.array(far.argmin(axis=1), pa.int32()), pa.array(far.min(axis=1, initial=np.inf), pa.float64()), pa.array([x.tobytes() for x in far], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "item", "v")), *made], names=["block", "item", "v", "cell", "own", "far"])

    return rows.join(pivots, "block").mapInArrow(run, f"block {kinds['block']}, item {kinds['item']}, v binary, cell int, own double, far binary")


def tiles_of(rows: DataFrame, size: int) -> DataFrame:
    """(block, tile, items, vs, fars, low, high): vectors of one cell at like distances of its pivot, up to twice `size` of them, and the bounds of their distances to each pivot (packed)."""
    place = F.struct("block", "cell")
    widest = rows.groupBy("block").agg(F.max("own").alias("_widest"))
    dealt = rows.join(widest, "block").withColumn("place", place)
    bucket = F.coalesce(F.floor(F.col("own") * 64 / F.nullif(F.col("_widest"), F.lit(0.0))), F.lit(0))
    dealt = numbered(dealt.select("place", "block", "item", "v", "own", "far", "_widest"), "place", bucket, ["own", "item"], size)
    lists = dealt.groupBy("block", "place", "chunk").agg(F.array_sort(F.collect_list(F.struct("item", "v", "far"))).alias("x"))
    lists = lists.select("block", F.concat_ws(".", "place.cell", "chunk").alias("tile"), F.col("x.item").alias("items"), F.col("x.v").alias("vs"), F.col("x.far").alias("fars"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema)

    def bound(batches):
        for batch in batches:
            fars = [matrix(x) for x in batch.column("fars").to_pylist()]
            low, high = ([f(x, axis=0).tobytes() for x in fars] for f in (np.min, np.max))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=[*batch.schema.names, "low", "high"])

    return stored(lists.mapInArrow(bound, f"{kinds}, low binary, high binary"))


def met_tiles(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(block, qt, bt, least, apart, held): every two tiles of a block, by their bounds alone: a distance that no two vectors of them fall below, how far apart their middles are, and the base tile's vectors."""
    kind = base.schema["block"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ql, qh, bl, bh = (np.stack([np.frombuffer(x.as_py(), np.float64) for x in batch.column(c)]) if batch.num_rows else np.zeros((0, 1)) for c in ("ql", "qh", "bl", "bh"))
            gap = np.maximum(0, np.maximum(ql - bh, bl - qh)).max(axis=1)
            apart = np.abs(ql + qh - bl - bh).max(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "qt", "bt")), pa.array(gap * (1 - 1e-9)), pa.array(apart), batch.column("held")], names=["block", "qt", "bt", "least", "apart", "held"])

    a = queries.select("block", F.col("tile").alias("qt"), F.col("low").alias("ql"), F.col("high").alias("qh"))
    b = base.select("block", F.col("tile").alias("bt"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.size("items").alias("held"))
    return a.join(b.where("held > 0"), "block").mapInArrow(run, f"block {kind}, qt string, bt string, least double, apart double, held int")


def beyond(far: np.ndarray, low: bytes, high: bytes) -> np.ndarray:
    """For each query (its distances to the pivots) a distance that no vector of a tile falls below."""
    low, high = np.frombuffer(low, np.float64), np.frombuffer(high, np.float64)
    return np.maximum(0, np.maximum(far - high, low - far)).max(axis=1) * (1 - 1e-9)


def wanted(pairs: DataFrame, queries: DataFrame, base: DataFrame, reach: DataFrame) -> DataFrame:
    """The pairs (block, qt, bt) of which a query of qt could have a vector of bt within its limit. Vectors stay where they are: only bounds meet."""
    q = queries.select("block", F.col("tile").alias("qt"), F.col("fars").alias("qf"))
    rows = pairs.select("block", "qt", "bt").join(q, ["block", "qt"]).join(reach, ["block", "qt"]).join(base.select("block", F.col("tile").alias("bt"), "low", "high"), ["block", "bt"])

    def run(batches):
        for batch in batches:
            keep = [bool((beyond(matrix(f.as_py()), low.as_py(), high.as_py()) <= np.array(x.as_py())).any()) for f, x, low, high in zip(*(batch.column(c) for c in ("qf", "limits", "low", "high")), strict=True)]
            yield batch.select(["block", "qt", "bt"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("block", "qt", "bt", "qf", "limits", "low", "high").mapInArrow(run, f"block {base.schema['block'].dataType.simpleString()}, qt string, bt string")


def closest(points: np.ndarray, v: np.ndarray) -> list[tuple[float, int]]:
    """The two nearest points of a query and their distances, the first ones of equals; candidates come from products, distances are then worked out exactly."""
    squares = (points * points).sum(axis=1)
    about = squares - 2 * (points @ v)
    slack = 1e-9 * (float(squares.max()) + float(v @ v)) + 1e-300
    second = np.partition(about, 1)[1] if len(about) > 1 else about.max()
    some = np.flatnonzero(about <= second + slack)
    d = np.sqrt(((points[some] - v) ** 2).sum(axis=1))
    return [(float(d[k]), int(some[k])) for k in np.argsort(d, kind="stable")[:2]]


def compared(pairs: DataFrame, queries: DataFrame, base: DataFrame, reach: DataFrame | None) -> DataFrame:
    """(block, qt, query_id, d, id): up to two nearest of each query in each base tile of the pairs (block, qt, bt). reach: block, qt, limits (for each query of the tile a distance beyond which nothing counts): queries that are farther off are left out."""
    q = queries.select("block", F.col("tile").alias("qt"), F.col("items").alias("qi"), F.col("vs").alias("qv"), F.col("fars").alias("qf"))
    b = base.select("block", F.col("tile").alias("bt"), F.col("items").alias("bi"), F.col("vs").alias("bv"), "low", "high")
    rows = pairs.select("block", "qt", "bt").join(q, ["block", "qt"]).join(b, ["block", "bt"])
    rows = rows.withColumn("limits", F.lit(None).cast("array<double>")) if reach is None else rows.join(reach, ["block", "qt"])
    rows = rows.select("block", "qt", "qi", "qv", "qf", "bi", "bv", "low", "high", "limits")
    kinds = [queries.schema["items"].dataType.elementType.simpleString(), base.schema["items"].dataType.elementType.simpleString()]

    def run(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                block, qt, qi, qv, qf, bi, bv, low, high, limits = (c[0].as_py() for c in batch.columns)
                points, vectors, far = matrix(bv), matrix(qv), None if limits is None else matrix(qf)
                some = range(len(qi)) if limits is None else np.flatnonzero(beyond(far, low, high) <= np.array(limits)).tolist()
                found = [(qi[i], d, bi[j]) for i in some for d, j in closest(points, vectors[i])]
                ids, ds, others = zip(*found, strict=True) if found else ((), (), ())
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, batch.schema.field("block").type), pa.array([qt] * n, pa.string()), pa.array(ids, batch.schema.field("qi").type.value_type), pa.array(ds, pa.float64()), pa.array(others, batch.schema.field("bi").type.value_type)],
                    names=["block", "qt", "query_id", "d", "id"],
                )

    return rows.mapInArrow(run, f"block {base.schema['block'].dataType.simpleString()}, qt string, query_id {kinds[0]}, d double, id {kinds[1]}")


def two_best(found: DataFrame) -> DataFrame:
    """(block, qt, query_id, x): the first two by distance, then id, of what tiles gave."""
    return found.groupBy("block", "qt", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, 2).alias("x"))


def searched(queries: DataFrame, base: DataFrame, size: int = TILE, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(best, met): two_best() over all base vectors of a query's block, and every pair of tiles with `touched`: whether it was compared.

    queries, base: block, item, v (array of double). Each tile of queries first meets the tile in which the pivots place its neighbours; what that gives bounds the distance of the second
    nearest, and a tile whose bounds lie beyond that for all queries of the tile is left. In the others, queries beyond their own bound are left. By the triangle inequality nothing is lost.
    Null vectors and null blocks are left out. A tile has up to twice `size` vectors; where no block has more than `size`, blocks are compared as they are.
    """
    pack = F.pandas_udf(lambda s: s.map(lambda v: np.asarray(v, np.float64).tobytes()), "binary")
    a, b = (x.where("v is not null").select("block", "item", pack(F.col("v").cast("array<double>")).alias("v")) for x in (queries, base))
    a, b = stored(a), stored(b)
    largest = a.groupBy("block").count().unionByName(b.groupBy("block").count()).agg(F.max("count")).first()[0] or 0
    if largest <= size:  # a block is a tile: there is nothing to bound
        qs, bs = (x.where("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", "v"))).alias("x")).select("block", F.lit("0").alias("tile"), F.col("x.item").alias("items"), F.col("x.v").alias("vs"), *[F.lit(None).cast(k).alias(c) for c, k in (("fars", "array<binary>"), ("low", "binary"), ("high", "binary"))]) for x in (a, b))
        met = qs.select("block", F.col("tile").alias("qt")).join(bs.select("block", F.col("tile").alias("bt")), "block")
        return two_best(compared(met, qs, bs, None)), met.withColumn("touched", F.lit(True))
    chosen = stored(pivots_of(b, pivots))
    qs, bs = tiles_of(placed(a, chosen), size), tiles_of(placed(b, chosen), size)
    met = stored(met_tiles(qs, bs))
    home = met.groupBy("block", "qt").agg(F.min(F.struct(F.col("held") < 2, "least", "apart", "bt")).alias("m")).select("block", "qt", F.col("m.bt").alias("bt"))
    home = stored(home)
    first = stored(compared(home, qs, bs, None))
    limit = F.when(F.size("x") == 2, F.col("x")[1]["d"]).otherwise(F.lit(float("inf")))
    reach = two_best(first).groupBy("block", "qt").agg(F.array_sort(F.collect_list(F.struct("query_id", limit.alias("limit")))).alias("l"))  # in the order of the tile's items
    reach = stored(reach.select("block", "qt", F.col("l.limit").alias("limits"), F.array_max("l.limit").alias("radius")))
    rest = met.join(home, ["block", "qt", "bt"], "left_anti").join(reach.select("block", "qt", "radius"), ["block", "qt"]).where("least <= radius")
    rest = stored(wanted(rest, qs, bs, reach.drop("radius")))
    more = compared(rest, qs, bs, reach.drop("radius"))
    touched = met.select("block", "qt", "bt").join(home.unionByName(rest).withColumn("touched", F.lit(True)), ["block", "qt", "bt"], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    return two_best(first.unionByName(more)), touched


def nearest_two(queries: DataFrame, base: DataFrame, block: str, query_id: str, base_id: str, vector: str, ratio: float = 0.72, size: int = TILE) -> DataFrame:
    """Per query with two neighbours in its block: the nearest, both distances, and whether the first is under ratio times the second.

    A query meets the vectors of its own block (a frame pair) only, and of those what searched() can't rule out. Equal distances go by id. Ids are different within a block.
    """
    named = [x.select(F.col(block).alias("block"), F.col(i).alias("item"), F.col(vector).alias("v")) for x, i in ((queries, query_id), (base, base_id))]
    best, _ = searched(*named, size)
    one, two = F.col("x")[0], F.col("x")[1]
    return best.where("size(x) = 2").select(F.col("block").alias(block), "query_id", one["id"].alias("base_id"), one["d"].alias("d1"), two["d"].alias("d2"), (one["d"] < ratio * two["d"]).alias("kept"))
