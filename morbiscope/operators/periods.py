"""Reporting periods that must not overlap: which of them are taken, by one sweep per location.

Periods are half-open. A *ranking* names sources from the first to the last, and within each source its
resolutions from the finest to the coarsest, as conditions on the rows:

    ranking = [[own weeks, own months, own years], [other weeks, other months]]

A period is taken unless it meets a period of an earlier source (taken or not), or a *taken* period of an
earlier resolution of its own source. So a month that lost to its weeks frees the year it would have blocked
within the source, while it still keeps out later sources.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morbiscope.operators.checks import Check
from morbiscope.operators.grouped import gathered, whole_groups

_VERDICT = "__vp string, __vl int, __vs int, __ve int, __taken boolean, __clash boolean"


class _Blockers:
    """Intervals on one axis, able to say which others they meet."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        order = np.argsort(lo, kind="stable")
        self.lo, self.reach = lo[order], np.maximum.accumulate(hi[order]) if lo.size else hi

    def meet(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """True where some blocker begins before ``hi`` and the furthest of those ends after ``lo``."""
        before = np.searchsorted(self.lo, hi, side="left")
        return (before > 0) & (self.reach[before - 1] > lo) if self.lo.size else np.zeros(lo.size, bool)


def sweep(place: np.ndarray, level: np.ndarray, s: np.ndarray, e: np.ndarray, copies: np.ndarray, sources: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(taken, clash) of the distinct intervals of many places; ``sources`` is the first level of each source.

    Places are laid one after another on one axis, so each step is vectorised over all of them. A taken
    interval clashes if several rows have it, or if it begins before an earlier taken one has ended.
    """
    base = s.min() if s.size else 0
    span = (e.max() if e.size else 0) - base
    lo, hi = place * span + (s - base), place * span + (e - base)
    taken = np.zeros(s.size, bool)
    bounds = [*sources, np.iinfo(np.int32).max]
    for first, end in zip(bounds, bounds[1:]):
        earlier = _Blockers(lo[level < first], hi[level < first])
        for at in np.unique(level[(level >= first) & (level < end)]):
            here = np.flatnonzero(level == at)
            own = taken & (level >= first)
            taken[here] = ~(earlier.meet(lo[here], hi[here]) | _Blockers(lo[own], hi[own]).meet(lo[here], hi[here]))
    clash = np.zeros(s.size, bool)
    order = np.flatnonzero(taken)
    order = order[np.lexsort((hi[order], lo[order]))]
    if order.size:
        reach = np.maximum.accumulate(hi[order])
        clash[order] = copies[order] > 1
        clash[order[1:]] |= lo[order[1:]] < reach[:-1]
    return taken, clash


def _interval_table(rows: DataFrame, location: Sequence[str], level: Column, start: str, end: str) -> DataFrame:
    """``rows`` with ``__place`` (text, each part with its length, so that no two places are alike), ``__level`` and the interval as day numbers."""
    texts = [F.col(k).cast("string") for k in location]
    place = F.concat(*[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]) if texts else F.lit("")
    return rows.withColumns({"__place": place, "__level": level, "__s": F.unix_date(F.col(start)), "__e": F.unix_date(F.col(end))})


def _levels(ranking: Sequence[Sequence[Column]]) -> tuple[Column, list[int]]:
    level, sources, n = F.lit(None).cast("int"), [], sum(map(len, ranking))
    for source in reversed(ranking):
        for condition in reversed(source):
            n -= 1
            level = F.when(condition, F.lit(n)).otherwise(level)
        sources.insert(0, n)
    return level, sources


def select_periods(rows: DataFrame, location: Sequence[str], ranking: Sequence[Sequence[Column]], label: str, start: str = "start_date", end: str = "period_end") -> tuple[DataFrame, list[Check]]:
    """The rows of ``rows`` that are taken under ``ranking``, and a check that taken periods do not overlap.

    Defined cases: a null part of the location is a location of its own; rows that meet no condition of the
    ranking, or without a start, an end or any length, are not taken and block nothing; repeated rows are
    all taken or all not, and if taken violate the check; empty tables are allowed; columns of ``rows`` that
    begin with two underscores are not.

    Scale: whether a row is taken depends on its location, level and interval only, so these are first made
    distinct with map-side combine. What a task then gets of one location is bounded by the calendar,
    however many rows the location has. Rows meet their verdict in an equi-join that AQE may split.
    """
    level, sources = _levels(ranking)
    keyed = _interval_table(rows, location, level, start, end)
    distinct = keyed.where("__level is not null and __s < __e").groupBy("__place", "__level", "__s", "__e").agg(F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            place = batch.column(0).dictionary_encode()
            level, s, e, copies = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
            taken, clash = sweep(place.indices.to_numpy(zero_copy_only=False).astype(np.int64), level, s, e, copies, sources)
            columns = [batch.column(0), *[batch.column(i) for i in (1, 2, 3)], pa.array(taken), pa.array(clash)]
            yield pa.RecordBatch.from_arrays(columns, names=["__vp", "__vl", "__vs", "__ve", "__taken", "__clash"])

    verdicts = gathered(distinct, "__place").mapInArrow(run, _VERDICT).where("__taken")
    on = (F.col("__place") == F.col("__vp")) & (F.col("__level") == F.col("__vl")) & (F.col("__s") == F.col("__vs")) & (F.col("__e") == F.col("__ve"))
    joined = keyed.join(verdicts, on)
    return joined.select(*rows.columns), [Check(f"{label}: overlapping selection", joined.where("__clash").select(*rows.columns))]


def disjoint_from(rows: DataFrame, blockers: DataFrame, location: Sequence[str], start: str = "start_date", end: str = "period_end") -> DataFrame:
    """Rows whose period meets no blocker's at the same location: the ranking of two sources, blockers first.

    Defined cases as for ``select_periods``; only the location and the period of ``blockers`` are read.
    """
    slim = [*location, start, end]
    fence = blockers.select(*slim).distinct().withColumn("__fence", F.lit(True))
    both = rows.withColumn("__fence", F.lit(False)).unionByName(fence, allowMissingColumns=True)
    taken, _ = select_periods(both, location, [[F.col("__fence")], [~F.col("__fence")]], "disjoint", start, end)
    return taken.where("not __fence").select(*rows.columns)


def overlapping(rows: DataFrame, location: Sequence[str], order: Sequence[str] = (), start: str = "start_date", end: str = "period_end") -> DataFrame:
    """Rows that begin before an earlier period of their location has ended, in the order start, end, ``order``.

    Of rows with the same period all but the first by ``order`` overlap it (all that tie for the first are
    kept, so a total order flags every copy but one). Rows without a start, an end or any length overlap nothing.

    Scale: the running end is taken over the distinct periods of a location, which the calendar bounds.
    """
    keyed = _interval_table(rows, location, F.lit(0), start, end).withColumn("__order", F.struct(F.lit(0), *[F.col(c) for c in order]))
    distinct = keyed.where("__s < __e").groupBy("__place", "__s", "__e").agg(F.min("__order").alias("__first"))
    so_far = Window.partitionBy("__place").orderBy("__s", "__e").rowsBetween(Window.unboundedPreceding, -1)
    periods = distinct.select(F.col("__place").alias("__vp"), F.col("__s").alias("__vs"), F.col("__e").alias("__ve"), "__first", F.max("__e").over(so_far).alias("__reach"))
    on = (F.col("__place") == F.col("__vp")) & (F.col("__s") == F.col("__vs")) & (F.col("__e") == F.col("__ve"))
    return keyed.join(periods, on).where((F.col("__s") < F.col("__reach")) | (F.col("__order") > F.col("__first"))).select(*rows.columns)


def finest_per_group(df: DataFrame, group: Sequence[str], rank: str) -> DataFrame:
    """Rows of the finest (lowest) rank of their group, joined back from a pre-aggregated minimum."""
    least = df.groupBy(*group).agg(F.min(rank).alias("__least"))
    return df.join(least, list(group)).where(F.col(rank) == F.col("__least")).drop("__least")
