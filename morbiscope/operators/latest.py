"""Which row, version or snapshot holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morbiscope.operators.checks import Check, ContractError, conflicting_keys, require_columns


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total ``order``.

    ``row_number() = 1`` lets Spark put a group limit before the shuffle, so a hot key sends at most one
    row per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def best_per_key(df: DataFrame, keys: Sequence[str], priority: Column, measures: Sequence[str], order: Sequence[Column], label: str) -> tuple[DataFrame, list[Check]]:
    """The best row per key by ``priority`` then ``order``; conflicting ``measures`` at one priority are a violation."""
    ranked = df.withColumn("__priority", priority)
    check = Check(f"{label}: conflicting {', '.join(measures)} within one key", conflicting_keys(ranked, [*keys, "__priority"], measures))
    return first_per_key(ranked, keys, [F.col("__priority").asc(), *order]).drop("__priority"), [check]


def version_key(version: Column) -> Column:
    """``V1.10`` as [1, 10], which orders after [1, 9]; anything else is null."""
    tidy = F.trim(version)
    return F.when(tidy.rlike(r"^[Vv]?\d{1,9}(\.\d{1,9})*$"), F.transform(F.split(F.regexp_replace(tidy, "^[Vv]", ""), r"\."), lambda x: x.cast("int")))


def latest_version(df: DataFrame, column: str) -> DataFrame:
    """One row with the numerically highest dotted version (null if there is none)."""
    names = df.select(column).distinct()  # few, so that versions are not read from every row
    key = version_key(F.col(column))
    return names.where(key.isNotNull()).agg(F.max_by(F.col(column), key).alias(column))


def newest(df: DataFrame, column: str, dotted: bool, label: str) -> str:
    """The highest dotted version, or the greatest value, of ``column``; a table that has none is refused."""
    require_columns(df, [column], label)
    top = (latest_version(df, column) if dotted else df.agg(F.max(column))).first()
    if top is None or not top[0]:
        raise ContractError(f"{label}: no {column}")
    return top[0]


def rows_of_latest_version(df: DataFrame, column: str) -> DataFrame:
    """Rows of the highest dotted version; as a literal, so that other partitions are pruned. Without a version, no rows."""
    top = latest_version(df, column).first()[0]
    return df.where(F.col(column) == F.lit(top)) if top is not None else df.limit(0)


def rows_of_latest_snapshot(df: DataFrame, column: str) -> DataFrame:
    """Rows of the greatest partition value; as a literal, so that other partitions are pruned. Without a value, no rows."""
    top = df.agg(F.max(column)).first()[0]
    return df.where(F.col(column) == F.lit(top)) if top is not None else df.limit(0)


def with_parents(children: DataFrame, group: str, order: Sequence[Column], parent: dict[str, Column]) -> DataFrame:
    """Children plus one parent row per group, taken from its first child with ``parent`` columns replaced."""
    heads = first_per_key(children, [group], order)
    return heads.select(*[parent.get(c, F.col(c)).cast(children.schema[c].dataType).alias(c) for c in children.columns]).unionByName(children)
