"""Whole groups of sorted partitions, many at a time: a small group costs no call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame


def starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups of neighbouring rows with equal keys start; nulls are equal."""
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = False
        for c in keys:
            v, none = rows[c].to_numpy(), rows[c].isna().to_numpy()
            new[1:] |= (v[1:] != v[:-1]) & ~(none[1:] & none[:-1])
    return np.flatnonzero(new)


def whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches in frames of whole groups: a group that may go on in the next batch is held back."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        cut = starts(rows, keys)[-1]
        other = bool(held) and len(starts(pd.concat([held[-1].tail(1)[keys], rows.head(1)[keys]]), keys)) > 1
        if cut or other:
            yield pd.concat([*held, rows.iloc[:cut]], ignore_index=True) if held else rows.iloc[:cut].reset_index(drop=True)
            held = [rows.iloc[cut:]]
        else:
            held.append(rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def in_groups(df: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema: str) -> DataFrame:
    """run(rows, bounds) over all groups of equal keys: rows are those of many whole groups, sorted within each by the order, and bounds their first rows and ends.

    Groups are dealt out by their keys, as groupBy() does; a task holds the groups of a batch, or one that is larger.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole(batches, keys):
            at = starts(rows, keys).tolist()
            yield run(rows, list(zip(at, [*at[1:], len(rows)], strict=True)))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(each, schema)
