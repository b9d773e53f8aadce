"""Attributes as known at event time, from periodic as-known snapshots and change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morbiscope.runtime import written

SNAPSHOT_DAYS = 365


def _period(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(days)).cast("int")


def as_known_join(
    events: DataFrame,
    changes: DataFrame,
    *,
    key: str,
    event_day: str,
    visible: Sequence[str],
    rank: Sequence[str],
    attributes: Sequence[str],
    snapshot_days: int = SNAPSHOT_DAYS,
) -> DataFrame:
    """``events`` (all columns kept) with the ``attributes`` that were known on ``event_day``.

    A change applies to an event if its ``key`` is the same and every date in ``visible`` is present and
    not after ``event_day``; of those that apply, the highest ``rank`` (compared left to right) holds, ties
    by the larger attributes. So a change becomes visible on the latest of its ``visible`` dates, and the
    state as known on a day is the maximum of the changes that became visible until then.

    Method: time is cut into periods of ``snapshot_days``. The snapshot of a key at a period's start is the
    maximum of all changes that became visible before; the log of a period holds its changes, in the order in
    which they became visible. An event is joined to the snapshot that precedes it, and the changes of the
    log up to its day are replayed on it (a fold); changes of other periods are not touched.

    Result columns: those of ``events``, then ``known`` (boolean: some change applied) and the attributes
    prefixed ``known_``. Defined cases: events with a null key or day, or without an applying change, keep
    their row with ``known`` false; changes with a null key or date never apply; repeated changes count
    once; either side may be empty; other columns of ``changes`` are ignored, so names cannot clash.

    Scale: changes are combined on the map side to one per key and day, so a log has at most
    ``snapshot_days`` entries and a key at most one snapshot a period, however many changes it has; no task
    gets the history of a key. Snapshot and log of a period are one row, which an event meets in one
    equi-join: no event is multiplied and AQE may split a hot key. Both are written first, so Spark
    broadcasts them only if their measured size is below its threshold.
    """
    seen = F.greatest(*[F.col(v) for v in visible])  # skips nulls, hence the filter before
    usable = changes
    for c in (key, *visible):
        usable = usable.where(F.col(c).isNotNull())
    state = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(rank)], *[F.col(a).alias(a) for a in attributes])
    daily = usable.select(F.col(key).alias("ck"), seen.alias("vis"), state.alias("state")).groupBy("ck", "vis").agg(F.max("state").alias("state"))
    daily = daily.withColumn("period", _period(F.col("vis"), snapshot_days))
    logs = written(
        daily.groupBy("ck", "period").agg(F.array_sort(F.collect_list(F.struct("vis", "state"))).alias("log"), F.max("state").alias("top")),  # at most snapshot_days entries
        "asof-logs",
    )
    last = events.agg(F.max(_period(F.col(event_day), snapshot_days))).first()[0]  # one number
    by_period = Window.partitionBy("ck").orderBy("period")  # one row per period with changes
    so_far = logs.select("ck", "period", F.max("top").over(by_period.rowsBetween(Window.unboundedPreceding, 0)).alias("state"), F.lead("period").over(by_period).alias("next_period"))
    # A snapshot for every later period up to and including that of the next change (or of the last event).
    snapshots = written(
        so_far.select("ck", "state", (F.col("period") + 1).alias("lo"), F.coalesce(F.col("next_period"), F.lit(last).cast("int")).alias("hi"))
        .where("lo <= hi")
        .select("ck", "state", F.explode(F.sequence("lo", "hi")).alias("period")),
        "asof-snapshots",
    )
    frames = written(snapshots.withColumnRenamed("state", "snapshot").join(logs.select("ck", "period", "log"), ["ck", "period"], "full_outer"), "asof-frames")
    ev = events.select(
        F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("ev"),
        F.col(key).alias("ek"),
        F.col(event_day).alias("day"),
        _period(F.col(event_day), snapshot_days).alias("ep"),
    )
    joined = ev.join(frames, (F.col("ek") == F.col("ck")) & (F.col("ep") == F.col("period")), "left")
    intervening = F.filter(F.coalesce("log", F.array().cast(frames.schema["log"].dataType)), lambda change: change["vis"] <= F.col("day"))
    known = joined.select("ev", F.aggregate(intervening, F.col("snapshot"), lambda held, change: F.greatest(held, change["state"])).alias("known"))
    return known.select("ev.*", F.col("known").isNotNull().alias("known"), *[F.col("known")[a].alias(f"known_{a}") for a in attributes])
