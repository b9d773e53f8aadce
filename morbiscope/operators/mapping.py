"""Codes and names against a dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morbiscope.functions.expressions import chosen
from morbiscope.operators.checks import Check, duplicate_keys, require_columns


def name_check(df: DataFrame, dimension: DataFrame, code: str, name_key: Column, dim_key: str, label: str) -> tuple[DataFrame, list[Check]]:
    """Counts of rows whose code the dimension knows; a known code under another name is a violation.

    Joins are plain equi-joins: Spark broadcasts the dimension if its size allows.
    """
    d = dimension.select(F.col(code).alias("__code"), F.col(dim_key).alias("__dim"))
    joined = df.withColumn("__own", name_key).join(d, F.col(code) == F.col("__code"), "left")
    counts = joined.agg(F.count_if(F.col("__dim").isNotNull()).alias("known_rows"), F.count_if(F.col("__dim").isNull()).alias("unknown_rows"))
    return counts, [
        Check(f"{label}: dimension lists a code twice", duplicate_keys(d, "__code")),
        Check(f"{label}: name conflicts with code", joined.where("__dim is not null and __own <> __dim")),
    ]


def map_codes(df: DataFrame, lookup: DataFrame, *, scope: str, name_key: Column, lookup_key: str, code: str, code_guess: Column, name_applies: Column, label: str) -> tuple[DataFrame, list[Check]]:
    """``mapped_code`` and ``map_method`` per row: by name first, else by a code computed from the row's own.

    Null names match the lookup's null name (the parent unit). Two ways giving two codes, and a lookup with
    a name or a code twice in one scope, are violations.
    """
    by_name = lookup.select(F.col(scope).alias("__ns"), F.col(lookup_key).alias("__nk"), F.col(code).alias("__by_name"))
    by_code = lookup.where(F.col(lookup_key).isNotNull()).select(F.col(scope).alias("__cs"), F.col(code).alias("__by_code"))
    j = df.withColumn("__own", name_key).withColumn("__guess", code_guess).withColumn("__use", name_applies)
    j = j.join(by_name, (F.col(scope) == F.col("__ns")) & F.col("__own").eqNullSafe(F.col("__nk")) & F.col("__use"), "left")
    j = j.join(by_code, (F.col(scope) == F.col("__cs")) & (F.col("__guess") == F.col("__by_code")), "left")
    value, method = chosen(compact_name=F.col("__by_name"), source_code=F.col("__by_code"))
    out = j.select(*df.columns, value.alias("mapped_code"), method.alias("map_method"))
    return out, [
        Check(f"{label}: lookup name is ambiguous", duplicate_keys(by_name, "__ns", "__nk")),
        Check(f"{label}: lookup code is ambiguous", duplicate_keys(by_name, "__ns", "__by_name")),
        Check(f"{label}: name and code disagree", j.where("__by_name <> __by_code")),
    ]


def orphans(df: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(parents.select(*keys), list(keys), "left_anti")


def enrich(df: DataFrame, extra: DataFrame, keys: Sequence[str], fallback: dict[str, tuple[str, str]]) -> DataFrame:
    """Left join; each ``fallback`` column is the first of its two sources that is present."""
    joined = df.join(extra, list(keys), "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(a), F.col(b)).alias(name) for name, (a, b) in fallback.items()])


def reconcile(left: DataFrame, right: DataFrame, key: str, values: tuple[str, str] | None = None) -> DataFrame:
    """``key`` and ``status``: left_only, right_only, same, or (with ``values``) renamed."""
    l = left.select(F.col(key).alias("lk"), (F.col(values[0]) if values else F.lit("")).alias("lv")).distinct()  # noqa: E741
    r = right.select(F.col(key).alias("rk"), (F.col(values[1]) if values else F.lit("")).alias("rv")).distinct()
    status = F.when(F.col("rk").isNull(), "left_only").when(F.col("lk").isNull(), "right_only").when(F.col("lv").eqNullSafe(F.col("rv")), "same").otherwise("renamed")
    return l.join(r, F.col("lk") == F.col("rk"), "full_outer").select(F.coalesce("lk", "rk").alias(key), status.alias("status"))


def roll_up(df: DataFrame, crosswalk: DataFrame, old: str, new: str, measure: str, group: Sequence[str] = ()) -> DataFrame:
    """Sums of ``measure`` by the new code of a many-to-one crosswalk, pre-aggregated by the old code."""
    small = df.groupBy(old, *group).agg(F.sum(measure).alias("__part"))
    return small.join(crosswalk.select(old, new).distinct(), old).groupBy(new, *group).agg(F.sum("__part").alias(measure))


def crosswalk_counts(crosswalk: DataFrame, old: str, new: str) -> DataFrame:
    """One row: rows, distinct old and new units, and rows that repeat an old unit."""
    counts = crosswalk.agg(F.count("*").alias("n_rows"), F.count_distinct(old).alias("old_units"), F.count_distinct(new).alias("new_units"))
    return counts.withColumn("repeated", F.col("n_rows") - F.col("old_units"))


def crosswalk_shape(crosswalk: DataFrame, old: str, new: str, new_units: int) -> list[Check]:
    """Every old unit once, and exactly ``new_units`` new ones; a crosswalk without these columns is refused."""
    require_columns(crosswalk, [old, new], "crosswalk")
    counts = crosswalk_counts(crosswalk, old, new)
    return [Check("crosswalk: old unit listed twice", duplicate_keys(crosswalk, old)), Check(f"crosswalk: not {new_units} new units", counts.where(F.col("new_units") != new_units))]


def reconcile_with_reference(crosswalk: DataFrame, reference: DataFrame | None, key: str, values: tuple[str, str]) -> tuple[DataFrame | None, list[str]]:
    """``reconcile`` against a reference that may be absent, which is a warning and no error."""
    if reference is None:
        return None, ["no reference to compare the crosswalk with"]
    return reconcile(crosswalk, reference, key, values), []
