"""Robust rotations by consensus, for groups of any size: trials are fitted in the tasks that count their votes, and votes are partial sums over chunks of a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from .groups import in_groups
from .quantiles import exact_quantiles
from .recurrence import numbered

SOURCE, TARGET = ("ax", "ay", "az"), ("bx", "by", "bz")
#: Rows of a chunk, and scores that a task holds at once.
CHUNK, SCORES = 1 << 14, 1 << 20


def rotations(m: np.ndarray) -> np.ndarray:
    """The rotations that take sources to targets best, from sums of products m[k, i, j] of source i and target j."""
    u, _, vt = np.linalg.svd(m)
    turn = np.ones((len(m), 3))
    turn[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    return np.einsum("nji,nj,nkj->nik", vt, turn, u)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rotation_of(sums: pd.Series) -> pd.Series:
    """Nine numbers, row by row, from nine sums of products."""
    m = np.array([np.asarray(x, float).reshape(3, 3) for x in sums]).reshape(-1, 3, 3)
    return pd.Series(list(rotations(m).reshape(-1, 9)))


@F.pandas_udf(T.DoubleType())
def weakest_axis(sums: pd.Series) -> pd.Series:
    """The least singular value of the sources, from their six sums of products."""
    m = np.array([np.asarray(x, float)[[0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(3, 3) for x in sums]).reshape(-1, 3, 3)
    return pd.Series(np.sqrt(np.maximum(np.linalg.eigvalsh(m)[:, 0], 0)))


def numbered_pairs(pairs: DataFrame, group: list[str], chunk: int = CHUNK) -> DataFrame:
    """(g, k, n, chunk, the coordinates): rows numbered within their group whatever the order of arrival, written once; equal rows are alike."""
    both = [*SOURCE, *TARGET]
    rows = pairs.select(F.struct(*group).alias("g"), *[F.col(c).cast("double").alias(c) for c in both])
    return stored(numbered(rows, "g", F.pmod(F.xxhash64(*both), F.lit(256)), both, chunk))


def drawn_rotations(rows: DataFrame, picks: DataFrame, seed: int) -> DataFrame:
    """(g, trial, rotation): the fits of three different rows each, drawn by hashes of seed and trial. picks: g, n, trial."""
    draw = lambda slot, below: F.pmod(F.xxhash64(F.lit(seed), F.col("trial"), F.lit(slot)), below)
    picks = picks.withColumns({"i": draw(0, F.col("n")), "j": draw(1, F.col("n") - 1), "l": draw(2, F.col("n") - 2)})
    picks = picks.withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("int"))
    picks = picks.withColumn("l", F.col("l") + (F.col("l") >= F.least("i", "j")).cast("int"))
    picks = picks.withColumn("l", F.col("l") + (F.col("l") >= F.greatest("i", "j")).cast("int"))
    drawn = picks.select("g", "trial", F.explode(F.array("i", "j", "l")).alias("k")).join(rows, ["g", "k"])
    sums = drawn.groupBy("g", "trial").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"m{i}{j}") for i, a in enumerate(SOURCE) for j, b in enumerate(TARGET)])
    return sums.select("g", "trial", rotation_of(F.array(*[F.col(f"m{i}{j}") for i in range(3) for j in range(3)])).alias("rotation"))


def trial_rotations(rows: DataFrame, trials: int, seed: int) -> DataFrame:
    """(g, trial, rotation): all trials as rows, for groups of three rows or more. votes() makes the same ones in its tasks."""
    picks = rows.groupBy("g").agg(F.first("n").alias("n")).where("n >= 3").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    return drawn_rotations(rows, picks, seed)


def draws(hashes: np.ndarray, n: int) -> np.ndarray:
    """The three rows of each trial in a group of n, from its three hashes, as drawn_rotations() draws them."""
    i, j, k = hashes[:, 0] % n, hashes[:, 1] % (n - 1), hashes[:, 2] % (n - 2)
    j = j + (j >= i)
    k = k + (k >= np.minimum(i, j))
    return np.stack([i, j, k + (k >= np.maximum(i, j))], axis=1)


def votes(rows: DataFrame, trials: int, seed: int, limit: float, chunk: int = CHUNK) -> DataFrame:
    """(g, trial, inliers): how many rows each trial's rotation takes within the limit (a cosine), of groups of three rows or more; of groups in one chunk, the first trial with the most.

    Trials are fitted where they vote: a task has a chunk, and of a group with more chunks all rows that its trials draw as well. The driver holds three hashes a trial.
    """
    hashed = rows.sparkSession.range(trials).select(*[F.xxhash64(F.lit(seed), F.col("id").cast("int"), F.lit(slot)) for slot in range(3)])
    hashes = np.array([tuple(r) for r in hashed.collect()], np.int64).reshape(-1, 3)  # trials in order: range() keeps it
    both = [*SOURCE, *TARGET]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("g", "chunk", "k", "n", *both).schema)

    def sampled(batches):
        for part in batches:
            keep = np.zeros(len(part), bool)
            for n in part.n.unique():
                mine = part.n.to_numpy() == n
                keep[mine] = np.isin(part.k.to_numpy()[mine], draws(hashes, int(n)))
            yield part[keep]

    large = rows.where((F.col("n") >= 2 * chunk) & (F.col("n") >= 3)).select("g", "chunk", "k", "n", *both)
    places = large.select("g", "chunk").distinct()
    sent = large.mapInPandas(sampled, columns).drop("chunk").hint("merge").join(places, "g")
    dealt = rows.where("n >= 3").select("g", "chunk", "k", "n", *both, F.lit(1).alias("kind")).unionByName(sent.withColumn("kind", F.lit(0)))

    def count(part: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        v, k, n, kind, g = part[both].to_numpy(float), part.k.to_numpy(), part.n.to_numpy(), part.kind.to_numpy(), part.g
        found = []
        for start, end in bounds:
            first = start + int((kind[start:end] == 0).sum())  # the chunk's own rows come behind those that are drawn
            known = slice(start, first) if first > start else slice(start, end)
            three = v[known][np.searchsorted(k[known], draws(hashes, int(n[start])))]
            turns = rotations(np.einsum("tri,trj->tij", three[:, :, :3], three[:, :, 3:])).reshape(-1, 9)
            own = v[first:end]
            products = (own[:, 3:, None] * own[:, None, :3]).reshape(-1, 9)
            block = max(1, SCORES // len(own))
            inside = np.concatenate([(turns[a : a + block] @ products.T >= limit).sum(axis=1) for a in range(0, len(turns), block)])
            told = [int(inside.argmax())] if len(own) == n[start] else range(len(inside))
            found.append(pd.DataFrame({"g": [g.iloc[start]] * len(told), "trial": told, "inliers": inside[told]}))
        return pd.concat(found)

    group = rows.schema["g"].dataType.simpleString()
    counted = in_groups(dealt, ["g", "chunk"], ["kind", "k"], count, f"g {group}, trial int, inliers long")
    return counted.groupBy("g", "trial").agg(F.sum("inliers").alias("inliers"))


def _cosine(rotation: Column) -> Column:
    """Of the angle between the turned source and the target."""
    return sum((F.get(rotation, F.lit(3 * i + j)) * F.col(TARGET[i]) * F.col(SOURCE[j]) for i in range(3) for j in range(3)), F.lit(0.0))


def robust_rotations(pairs: DataFrame, group: str | list[str], degrees: float = 1.0, trials: int = 3000, seed: int = 1, least: int = 6, part: float = 0.0, spread: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """Per group of pairs of unit rays (ax, ay, az, bx, by, bz): pairs, inliers, rotation (row by row, target = rotation * source), median and p95 error in degrees of the inliers, status.

    The first trial with the most inliers wins; all its inliers refit the rotation by sums of products. `rejected`, without a rotation: fewer than `least` pairs or inliers, fewer inliers than `part` of the
    pairs, a ray that is not finite, or inliers whose weakest axis is under `spread`. The result does not depend on chunks or the order of rows.
    """
    groups = [group] if isinstance(group, str) else list(group)
    rows = numbered_pairs(pairs, groups, chunk)
    limit = float(np.cos(np.radians(degrees)))
    sound = F.bool_and(F.forall(F.array(*SOURCE, *TARGET), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)))
    sizes = rows.groupBy("g").agg(F.count("*").alias("pairs"), sound.alias("sound"))
    fit = sizes.where(F.col("sound") & (F.col("pairs") >= max(3, least))).select("g")
    usable = rows.join(fit, "g", "left_semi")
    counts = votes(usable, trials, seed, limit, chunk)
    best = counts.groupBy("g").agg(F.max(F.struct("inliers", (-F.col("trial")).alias("t"))).alias("x")).select("g", (-F.col("x.t")).alias("trial"), F.col("x.inliers").alias("inliers"))
    best = stored(best.join(sizes.select("g", F.col("pairs").alias("n")), "g"))
    first = stored(best.join(drawn_rotations(usable, best, seed), ["g", "trial"]))
    inner = usable.join(first.select("g", "rotation"), "g").where(_cosine(F.col("rotation")) >= limit)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}{j}") for i, a in enumerate(SOURCE) for j, b in enumerate(TARGET)] + [F.sum(F.col(SOURCE[i]) * F.col(SOURCE[j])).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)]
    again = inner.groupBy("g").agg(F.count("*").alias("inliers"), *sums)
    again = again.select("g", "inliers", rotation_of(F.array(*[F.col(f"m{i}{j}") for i in range(3) for j in range(3)])).alias("refit"), weakest_axis(F.array(*[F.col(f"s{i}{j}") for i in range(3) for j in range(i, 3)])).alias("axis"))
    again = stored(again)
    errors = inner.join(again.select("g", "refit"), "g")
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine(F.col("refit"))))))
    spreads = exact_quantiles(stored(errors.select("g", angle.alias("angle"))), ["g"], F.col("angle"), [0.5, 0.95]).select("g", "q")
    out = sizes.join(again, "g", "left").join(spreads, "g", "left")
    good = F.coalesce((F.col("inliers") >= least) & (F.col("inliers") >= part * F.col("pairs")) & (F.col("axis") >= spread), F.lit(False))
    return out.select(
        *[F.col(f"g.{c}").alias(c) for c in groups], "pairs", F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"), F.when(good, F.get("q", F.lit(0))).alias("median_error"),
        F.when(good, F.get("q", F.lit(1))).alias("p95_error"), F.when(good, F.col("refit")).alias("rotation"), F.when(good, "fitted").otherwise("rejected").alias("status"),
    )
