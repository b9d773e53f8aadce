"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morbiscope.runtime import written


def canonical_hash(columns: Sequence[Column]) -> Column:
    """64-bit hash of the row's values, with null distinguished from every value."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def snapshot_changes(rows: DataFrame, keys: Sequence[str], values: Sequence[str], snapshot: str, recency: str) -> DataFrame:
    """Records added, removed or changed from each snapshot to the next.

    ``rows`` holds all snapshots; ``snapshot`` tells them apart and orders them; of several rows of one
    record in one snapshot the one with the highest ``recency`` holds (null is lowest; full ties are
    settled by the larger values, so the result does not depend on row order).

    A full outer join on the primary key puts each snapshot beside its predecessor: a missing side is an
    addition or a removal; where both are present the canonical row hashes are compared, and the values
    themselves behind equal hashes. The first snapshot has no predecessor and yields nothing.

    Defined cases: null key parts are values like any other (null equals null); a null snapshot is no
    snapshot and its rows are ignored; repeated rows collapse; an empty table gives an empty result; other
    columns are ignored, whatever they are called.

    Scale: one map-side-combined aggregation on (snapshot, key) bounds hot keys to one row per map task;
    only the list of snapshots (one row per delivery date) is broadcast, and only if Spark measures it as small.
    """
    known = rows.where(F.col(snapshot).isNotNull()).select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(snapshot).alias("snap"),
        F.struct(
            F.col(recency).isNotNull().alias("has"),
            F.col(recency).alias("at"),
            *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)],
        ).alias("version"),
    )
    ks, vs = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]
    records = known.groupBy("snap", *ks).agg(F.max("version").alias("version"))
    records = records.select(
        "snap", *ks, *[F.col(f"version.{v}").alias(v) for v in vs]
    ).withColumn("row_hash", canonical_hash([F.col(v) for v in vs]))
    records = written(records, "snapshot-records")  # both sides of the join and the order read it
    # The order of snapshots: one row per distinct snapshot, each with its successor.
    by_snap = Window.orderBy("snap")
    order = records.select("snap").distinct().select("snap", F.lead("snap").over(by_snap).alias("next_snap"), F.lag("snap").over(by_snap).alias("prior_snap"))
    old = records.join(order, "snap").where("next_snap is not null").select(
        F.col("next_snap").alias("snap"), *ks, *[F.col(v).alias(f"old_{v}") for v in vs], F.col("row_hash").alias("old_hash")
    )
    new = records.join(order, "snap").where("prior_snap is not null").drop("next_snap", "prior_snap")
    o, n = old.alias("o"), new.alias("n")
    on = F.col("o.snap") == F.col("n.snap")
    for k in ks:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    same = F.lit(True)
    for v in vs:
        same = same & F.col(f"o.old_{v}").eqNullSafe(F.col(f"n.{v}"))
    kind = (
        F.when(F.col("o.old_hash").isNull(), "added")
        .when(F.col("n.row_hash").isNull(), "removed")
        .when((F.col("o.old_hash") != F.col("n.row_hash")) | ~same, "changed")
    )
    absent = F.col("n.row_hash").isNull()
    return (
        o.join(n, on, "full_outer")
        .select(
            *[F.when(absent, F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(name) for k, name in zip(ks, keys)],
            F.coalesce(F.col("n.snap"), F.col("o.snap")).alias(snapshot),
            kind.alias("change_kind"),
        )
        .where("change_kind is not null")
    )
