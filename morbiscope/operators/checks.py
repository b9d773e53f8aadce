"""Contracts and data checks, built lazily and enforced together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not hold what its contract says."""


@dataclass(frozen=True)
class Check:
    """A named frame that must be empty."""

    name: str
    violations: DataFrame


def enforce(*checks: Check) -> None:
    """Evaluate all checks in one job; any violation raises ``ContractError`` naming every failed check."""
    if not checks:
        return
    probes = [c.violations.limit(1).select(F.lit(c.name).alias("check")) for c in checks]
    failed = sorted({r[0] for r in reduce(DataFrame.unionAll, probes).collect()})
    if failed:
        raise ContractError("; ".join(failed))


def violation_rows(*checks: Check) -> DataFrame:
    """``check`` (its name) and ``key`` (the violation as JSON) of every violation of every check."""
    return reduce(DataFrame.unionAll, [c.violations.select(F.lit(c.name).alias("check"), F.to_json(F.struct("*")).alias("key")) for c in checks])


def require_columns(df: DataFrame, needed: Sequence[str], label: str) -> None:
    if missing := sorted(set(needed) - set(df.columns)):
        raise ContractError(f"{label}: missing columns {missing}")


def require_schema(df: DataFrame, contract: Mapping[str, str], label: str) -> None:
    """Names and types, in any order."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    if have != dict(contract):
        raise ContractError(f"{label}: schema differs in {sorted(set(have.items()) ^ set(contract.items()))}")


def require_rows(df: DataFrame, label: str) -> int:
    """The number of rows of a frame that can be read and is not empty."""
    n = df.count()
    if not n:
        raise ContractError(f"{label}: no rows")
    return n


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def conflicting_keys(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Keys under which some measure has more than one value."""
    counts = df.groupBy(*keys).agg(*[F.count_distinct(m).alias(f"n_{m}") for m in measures])
    return counts.where(reduce(lambda a, b: a | b, [F.col(f"n_{m}") > 1 for m in measures]))


def dependency_breaks(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Keys that do not have exactly one value of each attribute."""
    counts = df.groupBy(key).agg(*[F.count_distinct(a).alias(f"n_{a}") for a in attributes])
    return counts.where(reduce(lambda a, b: a | b, [F.col(f"n_{a}") != 1 for a in attributes]))


def all_of(*conditions: Column) -> Column:
    """Conjunction in which null counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(True))


def rules(*conditions: Column, required: Sequence[str] = (), patterns: Mapping[str, str] | None = None, allowed: Mapping[str, Sequence] | None = None) -> Column:
    """One predicate from declared rules: present columns, texts of a shape, values of a list, and others."""
    return all_of(
        *[F.col(n).isNotNull() for n in required],
        *[F.col(n).rlike(f"^(?:{p})$") for n, p in (patterns or {}).items()],
        *[F.col(n).isin(*v) for n, v in (allowed or {}).items()],
        *conditions,
    )


def matching(df: DataFrame, **equals: object) -> DataFrame:
    """Rows with the given values; a column the table lacks matches nothing."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value)) if name in df.columns else df.limit(0)
    return df


def parsed(df: DataFrame, *columns: Column) -> DataFrame:
    """``df.select(*columns)`` whose expressions are evaluated once.

    The optimiser would repeat costly expressions in every filter it pushes below the projection. A column
    that it must not move (the partition id) keeps later filters above it; it is dropped again.
    """
    return df.select(*columns, F.spark_partition_id().alias("__held")).where("__held >= 0").drop("__held")


def undisputed(df: DataFrame, keys: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """Rows whose key no check lists; null keys equal null. The checks' frames hold ``keys``."""
    for check in checks:
        bad = check.violations.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)]).distinct()
        df = df.join(bad, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(keys)]), "left_anti")
    return df
