"""Linear recurrences over sources of any length: filters and fading states, chunk by chunk.

A chunk of a source's rows is a linear map of the state before it. Tasks work out each chunk from a state of zero, the chunks' end states are
scanned per source (one row a chunk), and each chunk adds what its start state contributes. Within a chunk whole blocks are
matrix products, so no row is visited by Python.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .groups import in_groups

#: Rows of a chunk (the last one of a source has up to twice as many), and of a block within it.
CHUNK, BLOCK = 1 << 16, 128


def numbered(df: DataFrame, source: str, bucket: Column, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """df with k (the row's number within its source, from 0), n (the source's rows) and chunk.

    bucket: a part of a source's order, as a stretch of time. Buckets are counted, the counts summed up per source, and rows
    numbered within their bucket, so no source is sorted in one task. Rows of a null source are one source. order: what tells a bucket's rows apart.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(source, "_bucket").agg(F.count("*").alias("_rows"))
    whole = W.partitionBy(source)
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(source).alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    rows = df.withColumn("_at", F.row_number().over(W.partitionBy(source, "_bucket").orderBy(*order)) - 1)
    rows = rows.join(counts, F.col(source).eqNullSafe(F.col("_source")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    k = F.col("_before") + F.col("_at")
    last = F.greatest(F.floor(F.col("n") / chunk) - 1, F.lit(0))
    return rows.withColumn("k", k).withColumn("chunk", F.least(F.floor(k / chunk), last)).drop("_bucket", "_source", "_b", "_before", "_at")


def butterworth3(cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the digital low-pass of order three: poles of the analog one by the bilinear transform."""
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    poles = warped * np.exp(1j * np.pi * np.array([2 / 3, 1, 4 / 3]))
    digital = (2 * rate + poles) / (2 * rate - poles)
    a = np.poly(digital).real
    b = np.poly([-1.0, -1.0, -1.0])
    return b * a.sum() / b.sum(), a


class Filter:
    """The matrices of a low-pass of order three for blocks of rows; its state is three numbers."""

    def __init__(self, cutoff: float, rate: float):
        b, a = butterworth3(cutoff, rate)
        step = np.array([[-a[1], 1, 0], [-a[2], 0, 1], [-a[3], 0, 0]])
        enter = b[1:] - a[1:] * b[0]
        powers = [np.eye(3)]
        for _ in range(BLOCK):
            powers.append(step @ powers[-1])
        self.powers = np.stack(powers)
        self.out = self.powers[:BLOCK, 0]  # of a start state to each row's output
        impulse = np.concatenate([[b[0]], self.powers[: BLOCK - 1, 0] @ enter])
        i, j = np.indices((BLOCK, BLOCK))
        self.direct = np.where(i >= j, impulse[np.maximum(i - j, 0)], 0.0)
        self.end = np.stack([self.powers[BLOCK - 1 - k] @ enter for k in range(BLOCK)], axis=1)
        #: The state at which a constant 1 gives 1.
        self.settled = np.array([(b - a)[k:].sum() for k in (1, 2, 3)])

    def over(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output, end state) of rows x channels from a start state of 3 x channels."""
        full = len(x) // BLOCK
        blocks = x[: full * BLOCK].reshape(full, BLOCK, x.shape[1])
        ends, states = self.end @ blocks, []
        for end in ends:
            states.append(state)
            state = self.powers[BLOCK] @ state + end
        y = self.direct @ blocks + self.out @ (np.stack(states) if states else np.zeros((0, 3, x.shape[1])))
        rest = x[full * BLOCK :]
        m = len(rest)
        tail = self.direct[:m, :m] @ rest + self.out[:m] @ state
        state = self.powers[m] @ state + self.end[:, BLOCK - m :] @ rest if m else state
        return np.concatenate([y.reshape(-1, x.shape[1]), tail]), state

    def after(self, n: int) -> np.ndarray:
        """What n rows of zeros make of a state."""
        return np.linalg.matrix_power(self.powers[BLOCK], n // BLOCK) @ self.powers[n % BLOCK]


@functools.lru_cache(maxsize=64)
def _filter(cutoff: float, rate: float) -> Filter:
    return Filter(cutoff, rate)


VALUES = ["x", "y", "z"]
STATE = [f"s{k}" for k in range(9)]


def _directed(rows: DataFrame, source_kind: str, cutoff: float, edge: int, forward: bool) -> DataFrame:
    """One direction of the filter. rows: source, chunk, k, n, rate, t and the values, a table that is read twice; forward also makes the `edge` rows behind the end, which backward starts from."""
    order = F.col("k") if forward else F.col("k").desc()

    def sequence(x: np.ndarray, chunk: int, last: bool) -> tuple[np.ndarray, int]:
        """A chunk's input with the rows that go on before and behind it, and how many those before are."""
        before = 2 * x[0] - x[edge:0:-1] if forward and chunk == 0 else x[:0]
        behind = 2 * x[-1] - x[-2 : -edge - 2 : -1] if forward and last else x[:0]
        return np.concatenate([before, x, behind]), len(before)

    def arrays(part: pd.DataFrame):
        return part[VALUES].to_numpy(float), part.chunk.to_numpy(), part.k.to_numpy(), part.n.to_numpy(), part.rate.to_numpy(float)

    def summary(part: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        v, chunk, k, n, rate = arrays(part)
        numbers = np.empty((len(bounds), 4 + len(STATE)))
        lengths = np.empty(len(bounds), int)
        for i, (a, z) in enumerate(bounds):
            x = sequence(v[a:z], chunk[a], k[z - 1] == n[z - 1] - 1)[0]
            lengths[i] = len(x)
            numbers[i] = rate[a], *x[0], *_filter(cutoff, rate[a]).over(x, np.zeros((3, 3)))[1].ravel()
        out = pd.DataFrame(numbers, columns=["rate", *VALUES, *STATE])
        first = [a for a, _ in bounds]
        return out.assign(source=part.source.iloc[first].to_numpy(), chunk=chunk[first], rows=lengths)[["source", "chunk", "rows", "rate", *VALUES, *STATE]]

    def scan(parts: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        v, ends, lengths, rate = parts[VALUES].to_numpy(float), parts[STATE].to_numpy(float).reshape(-1, 3, 3), parts["rows"].to_numpy(), parts.rate.to_numpy(float)
        states = np.empty((len(parts), 9))
        for a, z in bounds:
            low = _filter(cutoff, rate[a])
            state = low.settled[:, None] * v[a]
            for i in range(a, z):
                states[i] = state.ravel()
                if i + 1 < z:
                    state = low.after(int(lengths[i])) @ state + ends[i]
        return parts[["source", "chunk"]].assign(carry=list(states))

    def apply(part: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        v, chunk, k, n, rate = arrays(part)
        taken, made, number = [], [], []
        for a, z in bounds:
            first = a + 1  # the state before the chunk comes first
            x, skip = sequence(v[first:z], chunk[a], k[z - 1] == n[z - 1] - 1)
            y = _filter(cutoff, rate[first]).over(x, np.asarray(part.carry.iloc[a], float).reshape(3, 3))[0][skip:]
            more = len(y) - (z - first)
            taken += [np.arange(first, z), np.full(more, z - 1)]
            number += [k[first:z], n[z - 1] + np.arange(more)]
            made.append(y)
        taken, number, made = np.concatenate(taken), np.concatenate(number), np.concatenate(made)
        t = np.where(number == k[taken], part.t.to_numpy(float)[taken], np.nan)
        out = part[["source", "chunk", "n", "rate"]].iloc[taken].assign(k=number, t=t, **{c: made[:, i] for i, c in enumerate(VALUES)})
        return out[["source", "chunk", "k", "n", "rate", "t", *VALUES]]

    state = ", ".join(f"{c} double" for c in STATE)
    ends = in_groups(rows, ["source", "chunk"], [order], summary, f"source {source_kind}, chunk long, rows long, rate double, x double, y double, z double, {state}")
    carries = in_groups(ends, ["source"], [F.col("chunk") if forward else F.col("chunk").desc()], scan, f"source {source_kind}, chunk long, carry array<double>")
    lead = carries.select("source", "chunk", *[F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in ("k", "n", "rate", "t", *VALUES)], "carry", F.lit(0).alias("kind"))
    met = rows.select("source", "chunk", "k", "n", "rate", "t", *VALUES, F.lit(None).cast("array<double>").alias("carry"), F.lit(1).alias("kind")).unionByName(lead)
    return in_groups(met, ["source", "chunk"], ["kind", order], apply, f"source {source_kind}, chunk long, k long, n long, rate double, t double, x double, y double, z double")


def zero_phase_lowpass(samples: DataFrame, cutoff: float = 2.0, bucket: float = 60.0, chunk: int = CHUNK, edge: int = 12) -> DataFrame:
    """(source, t, x, y, z, status): the values without what is faster than `cutoff` Hz, filtered forward and backward, so nothing is delayed.

    samples: source, t (seconds), x, y, z. The sampling rate is one over the median step, to the microsecond. Both ends go on mirrored at their point, and the filter starts settled.
    status: `ok`; `short` for sources of at most `edge` rows; `rate` if the median step is not positive or the cutoff is not below half the rate. Only `ok` has values.
    A source of any length is as many tasks as it has chunks. Rows of equal times go by their values.
    """
    kind = samples.schema["source"].dataType.simpleString()
    rows = stored(numbered(samples.select("source", "t", *VALUES), "source", F.floor(F.col("t") / bucket), ["t", *VALUES], chunk))
    # A chunk's first row is also the next one of the chunk before, so each step is seen in one chunk.
    seen = rows.select("source", "k", "t", F.explode(F.when((F.col("k") > 0) & (F.floor((F.col("k") - 1) / chunk) < F.floor(F.col("k") / chunk)), F.array(F.floor(F.col("k") / chunk), F.floor(F.col("k") / chunk) - 1)).otherwise(F.array(F.floor(F.col("k") / chunk)))).alias("c"))
    step = F.round((F.col("t") - F.lag("t").over(W.partitionBy("source", "c").orderBy("k"))) * 1_000_000).cast("long")
    rates = seen.withColumn("step", step).groupBy("source").agg((1e6 / F.nullif(F.greatest(F.percentile("step", F.lit(0.5)), F.lit(0.0)), F.lit(0.0))).alias("rate"))
    rows = rows.join(rates.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    status = F.when(F.col("n") <= edge, "short").when(F.col("rate").isNull() | (F.col("rate") <= 2 * cutoff), "rate").otherwise("ok")
    rows = stored(rows.withColumn("status", status))
    good = rows.where("status = 'ok'").select("source", "chunk", "k", "n", "rate", "t", *VALUES)
    there = stored(_directed(good, kind, cutoff, edge, True))
    back = _directed(there, kind, cutoff, edge, False).where(F.col("k") < F.col("n")).select("source", "t", *VALUES, F.lit("ok").alias("status"))
    none = [F.lit(None).cast("double").alias(c) for c in VALUES]
    return back.unionByName(rows.where("status <> 'ok'").select("source", "t", *none, "status"))


def fading_state(df: DataFrame, source: str, bucket: Column, order: list[str], value: Column, supported: Column, gain: float, decay: float, keep: list[str], chunk: int = CHUNK) -> DataFrame:
    """(source, keep, state): the first supported value, then moved by gain times the difference, or times decay where the value is not supported; null before the first.

    Each row is a map s -> a s + b, and such maps make another: chunks are composed in tasks, their maps scanned, and the states before them applied. The first supported value
    is the map to itself. The same as series.ema() without a limit, for sources of any length. Null values are not supported.
    """
    ok = F.coalesce(supported, F.lit(False)) & value.isNotNull()
    rows = df.withColumns({"_ok": ok, "_v": F.coalesce(value.cast("double"), F.lit(0.0))})
    rows = stored(numbered(rows, source, bucket, order, chunk).select(F.col(source).alias("source"), *keep, "k", "chunk", "_ok", "_v"))
    kind = rows.schema["source"].dataType.simpleString()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def maps(good: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b of rows 0 to k together; a source's first supported row starts anew, wherever it lies."""
        a, b = np.where(good, 1 - gain, decay), np.where(good, gain * v, 0.0)
        reach = 1
        while reach < len(a):
            a[reach:], b[reach:] = a[reach:] * a[:-reach], a[reach:] * b[:-reach] + b[reach:]
            reach *= 2
        return a, b

    def begun(good: np.ndarray, v: np.ndarray) -> np.ndarray:
        """States, if the chunk's first supported value is the source's; NaN before it."""
        first = int(good.argmax()) if good.any() else len(good)
        state = np.full(len(good), np.nan)
        if first < len(good):
            a, b = maps(good[first + 1 :], v[first + 1 :])
            state[first] = v[first]
            state[first + 1 :] = a * state[first] + b
        return state

    def summary(part: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        ok, v, out = part._ok.to_numpy(bool), part._v.to_numpy(float), []
        for first, z in bounds:
            a, b = maps(ok[first:z], v[first:z])
            out.append((a[-1], b[-1], bool(ok[first:z].any()), begun(ok[first:z], v[first:z])[-1]))
        return pd.concat([part[["source", "chunk", *keep]].iloc[[x for x, _ in bounds]].reset_index(drop=True), pd.DataFrame(out, columns=["a", "b", "some", "fresh"])], axis=1)

    def scan(parts: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        a, b, some, fresh = (parts[c].to_numpy() for c in ("a", "b", "some", "fresh"))
        states = np.full(len(parts), np.nan)
        for first, z in bounds:
            for i in range(first + 1, z):
                if not np.isnan(states[i - 1]):
                    states[i] = a[i - 1] * states[i - 1] + b[i - 1]
                elif some[i - 1]:
                    states[i] = fresh[i - 1]
        return parts[["source", "chunk", *keep]].assign(before=states)

    def apply(part: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        ok, v, before, state = part._ok.to_numpy(bool), part._v.to_numpy(float), part.before.to_numpy(float), np.empty(len(part))
        lead = np.zeros(len(part), bool)
        for first, z in bounds:
            lead[first] = True  # the state before the chunk comes first
            if np.isnan(before[first]):
                state[first + 1 : z] = begun(ok[first + 1 : z], v[first + 1 : z])
            else:
                a, b = maps(ok[first + 1 : z], v[first + 1 : z])
                state[first + 1 : z] = a * before[first] + b
        return part[["source", *keep]].assign(state=state)[~lead]

    ends = in_groups(rows, ["source", "chunk"], ["k"], summary, f"source {kind}, chunk long, {kinds}, a double, b double, some boolean, fresh double")
    carries = in_groups(ends, ["source"], ["chunk"], scan, f"source {kind}, chunk long, {kinds}, before double")
    lead = carries.select("source", "chunk", "before", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("k"), F.lit(False).alias("_ok"), F.lit(0.0).alias("_v"), *keep)  # with the ids of a row, as nulls would make them inexact
    met = rows.withColumns({"before": F.lit(None).cast("double"), "kind": F.lit(1)}).unionByName(lead)
    out = in_groups(met, ["source", "chunk"], ["kind", "k"], apply, f"source {kind}, {kinds}, state double")
    return out.withColumn("state", F.when(~F.isnan("state"), F.col("state")))
