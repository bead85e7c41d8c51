"""Bounded nonlinear least squares for all sources at once: each round's normal equations are sums over parts of the observations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: residuals(part, parameters): one number per residual, from the arrays of a part.
Residuals = Callable[[dict, np.ndarray], np.ndarray]


def derivative(residuals: Residuals, part: dict, x: np.ndarray, r: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """By a small step in each parameter, in units of the scales."""
    out = np.empty((len(r), len(x)))
    for k in range(len(x)):
        moved = x.copy()
        moved[k] += 1e-6 * scale[k]
        out[:, k] = (residuals(part, moved) - r) / 1e-6
    return out


def sums_of(residuals: Residuals, part: dict, x: np.ndarray, scale: np.ndarray, soft: float | None) -> np.ndarray:
    """[cost, gradient, normal matrix, the same without weights] of a part. soft: beyond it a residual counts like its size, not its square."""
    r = residuals(part, x)
    j = derivative(residuals, part, x, r, scale)
    if soft is None:
        cost, w = (r * r).sum(), np.ones(len(r))
    else:
        root = np.sqrt(1 + (r / soft) ** 2)
        cost, w = (2 * soft * soft * (root - 1)).sum(), 1 / root
    weighted = j * w[:, None]
    return np.concatenate([[cost], weighted.T @ r, (weighted.T @ j).ravel(), (j.T @ j).ravel()])


def next_step(row: dict, scale: np.ndarray) -> np.ndarray:
    """The damped step from the best parameters so far, within the bounds; a parameter that a bound holds back is left out of the step."""
    x, low, high = (np.asarray(row[c], float) for c in ("x", "low", "high"))
    k = len(x)
    g, n = np.asarray(row["sums"], float)[1 : k + 1], np.asarray(row["sums"], float)[k + 1 : k + 1 + k * k].reshape(k, k)
    free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
    step = np.zeros(k)
    if free.any():
        held = n[np.ix_(free, free)]
        step[free] = np.linalg.solve(held + row["damping"] * (np.diag(np.diag(held)) + 1e-12 * np.eye(free.sum())), -g[free])
    return np.clip(x + step * scale, low, high)


def fit(parts: DataFrame, starts: DataFrame, residuals: Residuals, scale: list[float], soft: float | None = None, rounds: int = 60) -> DataFrame:
    """(source, x array, sums array, settled): the parameters of the least sum of squares within bounds, per source.

    parts: source and columns of arrays or numbers that residuals() takes; a source has as many parts as it needs. starts: source, x, low, high (arrays of double).
    Each round evaluates one trial of every source that has not settled: tasks give a part's cost, gradient and normal matrix at the trial,
    Spark adds them up by source, and each source accepts the trial, or damps more. The driver sees one number a round. settled: the step or the gain is negligible.
    sums: cost, gradient, normal matrix and that without weights, at x, in units of the scales.
    """
    units = np.asarray(scale, float)
    names = [c for c in parts.columns if c != "source"]
    kind = parts.schema["source"].dataType.simpleString()
    state_type = f"source {kind}, x array<double>, low array<double>, high array<double>, trial array<double>, sums array<double>, damping double, settled boolean"

    def evaluate(batches):
        for rows in batches:
            out = [sums_of(residuals, {c: np.asarray(row[c]) for c in names}, np.asarray(row["trial"], float), units, soft) for row in rows.to_dict("records")]
            yield pd.DataFrame({"source": rows.source, "s": out})

    def advance(batches):
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                found = np.asarray(row.pop("found"), float)
                first = row["sums"] is None
                better = first or found[0] <= row["sums"][0]
                if better:
                    gain = np.inf if first else row["sums"][0] - found[0]
                    moved = np.inf if first else np.abs((np.asarray(row["trial"]) - np.asarray(row["x"])) / units).max()
                    row |= {"x": row["trial"], "sums": found, "damping": row["damping"] if first else max(row["damping"] / 9, 1e-12)}
                    row["settled"] = bool(not first and (moved < 1e-10 or gain <= 1e-14 * found[0]) or found[0] == 0)
                else:
                    small = np.abs((np.asarray(row["trial"]) - np.asarray(row["x"])) / units).max() < 1e-9
                    row["damping"] *= 8
                    row["settled"] = bool(small or row["damping"] > 1e9)  # no direction improves
                row["trial"] = next_step(row, units)
                out.append(row)
            yield pd.DataFrame(out, columns=["source", "x", "low", "high", "trial", "sums", "damping", "settled"])

    state = starts.select("source", "x", "low", "high", F.col("x").alias("trial"), F.lit(None).cast("array<double>").alias("sums"), F.lit(1e-3).alias("damping"), F.lit(False).alias("settled"))
    state = stored(state)
    for _ in range(rounds):
        going = state.where("not settled")
        if going.isEmpty():
            break
        told = parts.join(going.select("source", "trial"), "source").mapInPandas(evaluate, f"source {kind}, s array<double>")
        k = len(scale)
        total = told.groupBy("source").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(1 + k + 2 * k * k)]).alias("found"))
        moved = going.join(total, "source").select(*state.columns, "found").mapInPandas(advance, state_type)
        state = stored(moved.unionByName(state.where("settled")))
    return state.select("source", "x", "sums", "settled")


def evaluated(parts: DataFrame, fits: DataFrame, measure: Callable[[dict, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(source, ...): rows that measure() makes of each part and the parameters x of its source. schema: of what it makes."""
    names = [c for c in parts.columns if c != "source"]
    kind = parts.schema["source"].dataType.simpleString()

    def run(batches):
        for rows in batches:
            out = [pd.DataFrame(measure({c: np.asarray(row[c]) for c in names}, np.asarray(row["x"], float))).assign(source=row["source"]) for row in rows.to_dict("records")]
            if out:
                yield pd.concat(out)[["source", *[c.split()[0] for c in schema.split(", ")]]]

    return parts.join(fits.select("source", "x"), "source").mapInPandas(run, f"source {kind}, {schema}")
