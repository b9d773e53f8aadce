"""Records that differ only in layout, collapsed by progressive partition refinement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morbiscope.runtime import written


def bare(text: Column) -> Column:
    """Letters, marks and digits of ``text`` in lower case; null stays null."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{Nd}]", "")


def letter_histogram(text: Column) -> Column:
    """64-bit sum over the hashes of the characters: equal for texts of the same letters in any order."""
    letters = F.transform(F.split(text, ""), lambda c: F.xxhash64(c).cast("decimal(20,0)"))
    return F.aggregate(letters, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))


def unordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two values in an order that does not depend on the side they came from (null first)."""
    swap = F.coalesce(a > b, a.isNotNull() & b.isNull())
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def split_headline(title: Column, publisher: Column) -> tuple[Column, Column]:
    """(headline, publisher) of a bare title that ends or else begins with its bare publisher.

    Otherwise, or without a publisher, the headline is the whole title and the publisher part null.
    """
    known = publisher.isNotNull() & (F.length(publisher) > 0)
    last, first = known & F.endswith(title, publisher), known & F.startswith(title, publisher)
    rest = F.length(title) - F.length(publisher)
    headline = F.when(last, F.substring(title, F.lit(1), rest)).when(first, F.substring(title, F.length(publisher) + 1, rest)).otherwise(title)
    return headline, F.when(last | first, publisher)


def digest(columns: Sequence[Column]) -> tuple[Column, Column]:
    """128 bits, as two numbers, that stand for the values of many columns (null apart from every value)."""
    parts = [x for c in columns for x in (c, c.isNull())]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def refine_copies(rows: DataFrame, id_col: str, refinements: Sequence[Sequence[Column]], exact: Sequence[str]) -> DataFrame:
    """``first_id``, ``copy_id`` and ``copies`` for every member of a group of copies but the smallest id.

    Rows are copies if all ``exact`` columns are equal (null equals null). ``refinements`` are invariants of
    ``exact`` from cheap to costly: the rows are first partitioned by the first ones; only rows in classes
    with several members get the next ones, and only what is left is compared by the exact columns.

    Defined cases: null is a value of its own and differs from an empty text; ids are unique, a repeated
    id counts as one more copy of itself and is not reported; empty tables and tables without copies give an
    empty result; columns not named are carried by nobody, so their names cannot clash.

    Scale: the id, the class and the exact columns are written once and are all that moves; callers keep wide
    columns out of ``exact`` by their ``digest``. Each refinement counts 8-byte class keys with map-side
    combine and writes those of several members, so the semi-join that keeps their rows broadcasts them
    only if they were measured as small. A hot group is one row per map task in every count, and its members
    are only met again in joins that AQE may split. No group is ever collected.
    """
    xs = [f"x_{c}" for c in exact]
    now = rows.select(F.col(id_col).alias("row_id"), *[F.col(c).alias(x) for c, x in zip(exact, xs)], F.xxhash64(*refinements[0]).alias("class_key"))
    now = written(now, "copies-slim")
    for level, invariants in enumerate(refinements):
        if level:
            by_name = now.select("row_id", *xs, "class_key", *[F.col(x).alias(c) for c, x in zip(exact, xs)])
            now = written(by_name.select("row_id", *xs, F.xxhash64("class_key", *invariants).alias("class_key")), "copies-refined")
        several = now.groupBy("class_key").agg(F.count("*").alias("members")).where("members > 1").select("class_key")
        now = now.join(written(several, "copies-classes"), "class_key", "left_semi")
    groups = now.groupBy("class_key", *xs).agg(F.min("row_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    k, g = now.alias("k"), groups.alias("g")
    on = F.col("k.class_key") == F.col("g.class_key")
    for x in xs:
        on = on & F.col(f"k.{x}").eqNullSafe(F.col(f"g.{x}"))
    return k.join(g, on).where("k.row_id <> g.first_id").select("g.first_id", F.col("k.row_id").alias("copy_id"), "g.copies")


def place_copies(opendengue: DataFrame) -> DataFrame:
    """Copies among location rows: the two names in either order say the same, all other content is equal."""
    skip = {"record_id", "_source", "_source_file", "_ingested_at", "adm_0_name", "adm_1_name"}
    high, low = digest([F.col(c) for c in opendengue.columns if c not in skip])
    rows = opendengue.select("record_id", high.alias("high"), low.alias("low"), bare(F.col("adm_0_name")).alias("name0"), bare(F.col("adm_1_name")).alias("name1"))
    first, last = unordered_pair(F.col("name0"), F.col("name1"))
    rows = rows.select("record_id", "high", "low", first.alias("name_lo"), last.alias("name_hi"))
    size = F.coalesce(F.length("name_lo"), F.lit(-1)) + F.coalesce(F.length("name_hi"), F.lit(-1))
    letters = letter_histogram(F.concat(F.coalesce("name_lo", F.lit("")), F.coalesce("name_hi", F.lit(""))))
    return refine_copies(rows, "record_id", [[size, F.col("high"), F.col("low")], [letters]], ["high", "low", "name_lo", "name_hi"])


def news_copies(news: DataFrame) -> DataFrame:
    """Copies among titled deliveries: headline and publisher say the same, in either order."""
    rows = news.where("title is not null").select("delivery_id", bare(F.col("title")).alias("t"), bare(F.col("source")).alias("p"))
    headline, publisher = split_headline(F.col("t"), F.col("p"))
    rows = rows.select("delivery_id", headline.alias("headline"), publisher.alias("publisher"))
    size = F.length("headline")
    return refine_copies(rows, "delivery_id", [[size, F.col("publisher")], [letter_histogram(F.col("headline"))]], ["headline", "publisher"])
