"""Profiling and descriptive operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morbiscope.functions.expressions import inclusive_days


def profile(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """Per column: type, rows, nulls, percentage of nulls, distinct values.

    Distinct values are exact: each column is counted by an aggregation of its own, whose map side combines
    equal values, so no row is multiplied by the number of columns and no stage carries more than one column.
    With ``rsd`` they are estimated to that relative error, all columns in one pass of sketches.
    """
    n = F.count("*").alias("n_rows")
    if rsd is not None:
        one = df.agg(n, *[x for i, c in enumerate(df.columns) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.approx_count_distinct(F.col(f"`{c}`"), rsd).alias(f"d{i}"))])
        parts = [one.select(F.lit(i).alias("i"), "n_rows", F.col(f"n{i}").alias("present"), F.col(f"d{i}").alias("distinct_count")) for i in range(len(df.columns))]
    else:
        values = lambda c: df.groupBy(F.col(f"`{c}`").alias("v")).agg(n)
        parts = [
            values(c).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n_rows"))), F.lit(0)).alias("present"), F.count("v").alias("distinct_count")).select(F.lit(i).alias("i"), "n_rows", "present", "distinct_count")
            for i, c in enumerate(df.columns)
        ]
    counts = reduce(DataFrame.unionAll, parts)
    names = F.array(*[F.struct(F.lit(f.name).alias("n"), F.lit(f.dataType.simpleString()).alias("t")) for f in df.schema])
    out = counts.select(names[F.col("i")]["n"].alias("column_name"), names[F.col("i")]["t"].alias("column_type"), "n_rows", (F.col("n_rows") - F.col("present")).alias("null_count"), "distinct_count")
    return out.withColumn("null_percent", F.round(F.when(F.col("n_rows") > 0, 100.0 * F.col("null_count") / F.col("n_rows")).otherwise(0.0), 4))


def duplicate_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows, distinct full rows, distinct keys and the surpluses."""
    whole, part = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(f"`{c}`") for c in key])
    one = df.agg(F.count("*").alias("n_rows"), F.count_distinct(whole).alias("distinct_rows"), F.count_distinct(part).alias("distinct_keys"))
    return one.select("n_rows", (F.col("n_rows") - F.col("distinct_rows")).alias("duplicate_rows"), "distinct_keys", (F.col("n_rows") - F.col("distinct_keys")).alias("duplicate_keys"))


def accounting(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: number of rows for which each condition holds, in a single aggregate."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def distribution_of_counts(df: DataFrame, group: Sequence[str], counted: str) -> DataFrame:
    """How many groups have how many distinct values."""
    return df.groupBy(*group).agg(F.count_distinct(counted).alias("n_values")).groupBy("n_values").agg(F.count("*").alias("n_groups"))


def pivot_counts(df: DataFrame, group: str, column: str, values: Mapping[str, str]) -> DataFrame:
    """Counts of ``values`` of ``column`` by group, zero where there are none, under the given names."""
    wide = df.groupBy(group).pivot(column, list(values)).count().fillna(0)
    return wide.select(group, *[F.col(f"`{v}`").alias(n) for v, n in values.items()])


def seasonality(df: DataFrame, group: str, month: Column, measure: str, digits: int = 6) -> DataFrame:
    """Mean of ``measure`` by group and month, as a share of the group's highest month."""
    means = df.groupBy(group, month.alias("month_num")).agg(F.avg(measure).alias("mean"))
    top = means.groupBy(group).agg(F.max("mean").alias("top"))
    return means.join(top, group).select(group, "month_num", F.round(F.col("mean") / F.col("top"), digits).alias("season_index"))


def set_overlap(df: DataFrame, set_col: str, item_col: str, digits: int = 6) -> DataFrame:
    """Jaccard overlap of every two sets that share an item; pairs come from the items, not from all pairs.

    Sets are sources, days or other few things; items may be many.
    """
    items = df.select(F.col(set_col).alias("s"), F.col(item_col).alias("i")).where("i is not null").distinct()
    sizes = items.groupBy("s").agg(F.count("*").alias("n"))
    members = items.groupBy("i").agg(F.array_sort(F.collect_set("s")).alias("sets"))  # at most the number of sets
    pairs = members.select(F.explode("sets").alias("a"), "sets").select("a", F.explode("sets").alias("b")).where("a < b")
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    na, nb = sizes.select(F.col("s").alias("a"), F.col("n").alias("na")), sizes.select(F.col("s").alias("b"), F.col("n").alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), digits).alias("overlap"))


def word_counts(df: DataFrame, words: Column) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of a total order; Spark keeps ``n`` per task."""
    return df.orderBy(*order).limit(n)


def describe_by(df: DataFrame, group: Sequence[str], measure: str, digits: int = 4) -> DataFrame:
    m = F.col(measure)
    r = lambda c: F.round(c, digits)
    return df.groupBy(*group).agg(
        F.count(m).alias("n"), r(F.avg(m)).alias("mean"), r(F.stddev(m)).alias("std"), F.min(m).alias("least"),
        *[r(F.percentile(m, F.lit(q))).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.max(m).alias("most"),
    )


def period_length_check(df: DataFrame, start: str, end: str, resolution: str) -> DataFrame:
    """Rows whose period, both days included, is not as long as its declared resolution, with ``days``.

    A week has 7 days, a month 28 to 31, a year 365 or 366. Rows without a day or with another resolution are
    listed as well; the letter case of the resolution does not matter.
    """
    days, kind = inclusive_days(F.col(start), F.col(end)), F.lower(F.col(resolution))
    fits = F.when(kind.isin("week", "epiweek", "isoweek"), days == 7).when(kind == "month", days.between(28, 31)).when(kind == "year", days.between(365, 366))
    return df.withColumn("days", days).where(~F.coalesce(fits, F.lit(False)))
