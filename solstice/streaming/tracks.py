"""Streaming forms of the track segments and of the decaying state.

Rows of a source must arrive in the order of their clock, as the batch forms
demand; an earlier one is late and goes to the dead letters. State is a few numbers per source, dropped
when a source is silent for `silent_ms`, if given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def sorted_rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A source's rows of a batch; the order counts across Arrow batches."""
    return pd.concat(list(batches), ignore_index=True).sort_values(["us", "id"], kind="stable")


def expiry(silent_ms: int | None) -> str:
    """Streams with an expiry run on for ever, also those that are to end when all is read; so it is asked for."""
    return GroupStateTimeout.NoTimeout if silent_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def segments(events: DataFrame, gap_us: int, silent_ms: int | None = None) -> DataFrame:
    """(source, id, us, value, segment, status): status ok, void, invalid or late; ok rows carry their segment from 0.

    events: source long, id long, us long, value double, void boolean, invalid boolean. Void rows do not
    move the clock; invalid ones do. A late row changes nothing. A source that was silent for `silent_ms`, if given, begins anew.
    State: the last segment, the clock, and whether something broke the track since the last valid row.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        segment, clock, dirty = state.get if state.exists else (0, None, False)
        rows = sorted_rows(batches)
        us, void, invalid = rows.us.to_numpy(np.int64), rows.void.to_numpy(bool), rows.invalid.to_numpy(bool)
        least = np.iinfo(np.int64).min
        clocks = np.maximum.accumulate(np.concatenate([[least if clock is None else clock], np.where(void, least, us)]))
        before = clocks[:-1]
        late = ~void & (us < before)
        acquired = ~void & ~late
        gap = acquired & (before != least) & (us - np.where(before == least, us, before) > gap_us)
        ok = acquired & ~invalid
        breaks = np.cumsum(void | gap | (acquired & invalid))
        seen = breaks[ok]
        steps = np.diff(np.concatenate([[-1 if dirty else 0], seen])) != 0
        number = segment + np.cumsum(steps)
        numbers = np.full(len(rows), -1)
        numbers[ok] = number
        if len(seen):
            segment, dirty = int(number[-1]), bool(breaks[-1] > seen[-1])
        else:
            dirty = dirty or bool(len(breaks) and breaks[-1] > 0)
        if clocks[-1] != least:
            clock = int(clocks[-1])
        state.update((segment, clock, dirty))
        if silent_ms is not None:
            state.setTimeoutDuration(silent_ms)
        status = np.select([void, late, invalid], ["void", "late", "invalid"], "ok")
        yield pd.DataFrame({"source": key[0], "id": rows.id.to_numpy(), "us": us, "value": rows.value.to_numpy(), "segment": pd.Series(numbers, dtype="Int64").where(ok), "status": status})

    return events.groupBy("source").applyInPandasWithState(
        step, "source long, id long, us long, value double, segment long, status string", "segment long, clock long, dirty boolean", "append", expiry(silent_ms)
    )


def decaying_state(events: DataFrame, gain: float, decay: float, limit: float | None = None, silent_ms: int | None = None) -> DataFrame:
    """(source, id, us, state): the fold of operators.series.ema() over a stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows, out = sorted_rows(batches), []
        for value, supported in zip(rows.value.tolist(), rows.supported.tolist(), strict=True):
            if supported:
                move = 0.0 if last is None else gain * (value - last)
                if limit is not None:
                    move = max(-limit, min(limit, move))
                last = value if last is None else last + move
            elif last is not None:
                last *= decay
            out.append(last)
        state.update((last,))
        if silent_ms is not None:
            state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame({"source": key[0], "id": rows.id.to_numpy(), "us": rows.us.to_numpy(), "state": pd.Series(out, dtype="float64")})

    return events.groupBy("source").applyInPandasWithState(step, "source long, id long, us long, state double", "last double", "append", expiry(silent_ms))
