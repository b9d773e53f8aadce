"""Continuous periods and gaps from overlapping integer intervals, by canonical dyadic blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morbiscope.operators.grouped import gathered, whole_groups

_OUT = "group_key string, span_kind string, start_day int, end_day int"


def dyadic_blocks(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical blocks ``[index * 2**level, (index + 1) * 2**level)`` of half-open intervals with ``0 <= lo < hi``.

    At each level at most the leftmost odd and the rightmost even block belong to the decomposition,
    so the arrays are halved level by level until the two ends meet.
    """
    groups, starts, levels = [], [], []
    level = 0
    while lo.size:
        left, right = (lo & 1 == 1), (hi & 1 == 1)
        groups += [group[left], group[right]]
        starts += [lo[left] << level, (hi[right] - 1) << level]
        levels += [np.full(int(left.sum()), level), np.full(int(right.sum()), level)]
        lo, hi, level = (lo + 1) >> 1, hi >> 1, level + 1
        more = lo < hi
        group, lo, hi = group[more], lo[more], hi[more]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (groups, starts, levels))  # type: ignore[return-value]


def uncovered(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct blocks without an ancestor among them, ordered by group and start.

    Two dyadic blocks nest or are disjoint. In the order (group, start, larger first) a block is covered
    exactly if some earlier block of its group ends at or after its own end.
    """
    order = np.lexsort((-level, start, group))
    group, start, level = group[order], start[order], level[order]
    end = start + (np.int64(1) << level)
    if not group.size:
        return group, start, level
    first = np.r_[True, group[1:] != group[:-1]]
    rank = np.cumsum(first) - 1
    span = end.max() + 1  # lifts each group above the one before, so that one running maximum serves all
    reach = np.maximum.accumulate(end + rank * span) - rank * span
    covered = np.r_[False, (reach[:-1] >= end[1:]) & ~first[1:]]
    return group[~covered], start[~covered], level[~covered]


def merge_siblings(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sibling pairs become their parent, from the lowest level upward, until none is left."""
    at = 0
    while group.size and at <= level.max():
        size = np.int64(1) << at
        pair = (
            (level[:-1] == at)
            & (level[1:] == at)
            & (group[:-1] == group[1:])
            & (start[1:] == start[:-1] + size)
            & ((start[:-1] >> at) & 1 == 0)
        )
        if pair.any():
            level = level.copy()
            level[:-1][pair] += 1
            keep = np.r_[True, ~pair]
            group, start, level = group[keep], start[keep], level[keep]
        at += 1
    return group, start, level


def coalesce_blocks(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent blocks of a group joined into periods: (group, first, end)."""
    if not group.size:
        return group, start, start
    end = start + (np.int64(1) << level)
    opens = np.r_[True, (group[1:] != group[:-1]) | (start[1:] > end[:-1])]
    closes = np.r_[opens[1:], True]
    return group[opens], start[opens], end[closes]


def spans(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Periods and gaps (group, is_gap, start, end) of any integer intervals, empty ones ignored."""
    real = lo < hi
    group, lo, hi = group[real], lo[real], hi[real]
    base = lo.min() if lo.size else 0
    g, s, e = coalesce_blocks(*merge_siblings(*uncovered(*dyadic_blocks(group, lo - base, hi - base))))
    inner = g[1:] == g[:-1]
    return (
        np.r_[g, g[1:][inner]],
        np.r_[np.zeros(g.size, bool), np.ones(int(inner.sum()), bool)],
        np.r_[s, e[:-1][inner]] + base,
        np.r_[e, s[1:][inner]] + base,
    )


def _spans_of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys = batch.column(0).dictionary_encode()
    g, gap, s, e = spans(
        keys.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64),
        batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64),
    )
    return pa.RecordBatch.from_arrays(
        [
            keys.dictionary.take(pa.array(g)).cast(pa.string()),
            pa.array(np.where(gap, "gap", "period").astype(object), pa.string()),
            pa.array(s, pa.int32()),
            pa.array(e, pa.int32()),
        ],
        names=["group_key", "span_kind", "start_day", "end_day"],
    )


def _spans_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from map(_spans_of_batch, whole_groups(batches))


def periods_and_gaps(intervals: DataFrame, *, key: str, start: str, end: str) -> DataFrame:
    """Continuous periods and the gaps between them, per key.

    ``key`` is a string column, ``start`` and ``end`` are dates, half-open. Result: ``group_key``,
    ``span_kind`` (``period`` or ``gap``), ``start_day``, ``end_day`` (dates). Touching periods are one;
    a gap always lies between two periods of its key.

    Defined cases: rows with a null key, start or end, or with ``end <= start``, cover nothing; repeated
    rows count once; a key with one period has no gap; an empty table gives an empty result; other
    columns are ignored.

    Scale: equal intervals are removed by a map-side-combined aggregation spread over all columns, so a
    hot key loses its repeats before it is gathered. What is gathered per key is bounded by the calendar,
    not by the rows: at most (distinct days) x (distinct lengths). Blocks are made and merged with numpy over
    Arrow batches that hold many keys; no per-key Python call.
    """
    slim = (
        intervals.select(F.col(key).alias("group_key"), F.unix_date(F.col(start)).alias("s"), F.unix_date(F.col(end)).alias("e"))
        .where("group_key is not null and s < e")
        .distinct()
    )
    out = gathered(slim, "group_key").mapInArrow(_spans_of_partition, _OUT)
    return out.select(
        "group_key",
        "span_kind",
        F.date_from_unix_date("start_day").alias("start_day"),
        F.date_from_unix_date("end_day").alias("end_day"),
    )
