"""Queries of the problems tagged llm, and SQL to compare them with where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morbiscope.llm import layout_copies as L
from morbiscope.llm import canon_names, packing, surrogates, tree_tokenizer
from morbiscope.runtime import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit meant by every typed Admin1 name that is not canonical."""
    return canon_names.opendengue_names(table(spark, sf_dir, "opendengue"), table(spark, sf_dir, "administrative_boundaries"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that differ only in layout, in ``opendengue`` and ``news_rss``."""
    places = L.place_copies(table(spark, sf_dir, "opendengue")).select(F.lit("opendengue").alias("table_name"), "first_id", "copy_id")
    news = L.news_copies(table(spark, sf_dir, "news_rss")).select(F.lit("news_rss").alias("table_name"), "first_id", "copy_id")
    return places.unionByName(news)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tree_tokenizer.encode_documents(table(spark, sf_dir, "documents"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of every document for each capacity."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_capacity"))


def _key(spark: SparkSession) -> str:
    """The key of the surrogates: ``spark.morbiscope.surrogate.key`` of the session, else one that nobody knows."""
    return spark.conf.get("spark.morbiscope.surrogate.key", None) or secrets.token_hex(16)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal information in every document."""
    found = surrogates.protect_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), key=_key(spark), texts=False)
    return found.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.kind", "e.start_pos", "e.end_pos")


def p9_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders, and with surrogates, in place of personal information; collisions refused."""
    return surrogates.protect_checked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), key=_key(spark)).drop("entities")


def p9_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind, how many surrogates stand for several entities, and how many entities have several surrogates."""
    found = surrogates.protect_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), key=_key(spark), texts=False, originals=True)
    entities = found.select(F.explode("entities").alias("e")).select("e.kind", "e.original", "e.surrogate")
    return surrogates.surrogate_accounting(written(entities, "surrogates"))  # two reductions read it


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p4_found": p4_found, "p7_ids": p7_ids, "p8_packing": p8_packing, "p9_found": p9_found, "p9_protected": p9_protected, "p9_collisions": p9_collisions}


def _bare(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]', '', 'g')"


def oracle_sql() -> dict[str, str]:
    others = "adm_2_name, ISO_A0, FAO_GAUL_code, RNE_iso_code, calendar_start_date, Year, dengue_total, S_res, T_res, case_definition_standardised, UUID, release"
    p4 = f"""
with od as (select *, {_bare('adm_0_name')} as a, {_bare('adm_1_name')} as b from opendengue),
o as (select record_id as id, min(record_id) over (partition by {others},
        case when coalesce(a > b, a is not null and b is null) then b else a end, case when coalesce(a > b, a is not null and b is null) then a else b end) as first_id from od),
nt as (select delivery_id as id, {_bare('title')} as t, {_bare('source')} as p from news_rss where title is not null),
n as (select id, min(id) over (partition by
        case when p <> '' and ends_with(t, p) then left(t, length(t) - length(p)) when p <> '' and starts_with(t, p) then substr(t, length(p) + 1) else t end,
        case when p <> '' and (ends_with(t, p) or starts_with(t, p)) then p end) as first_id from nt)
select 'opendengue' as table_name, first_id, id as copy_id from o where id <> first_id
union all select 'news_rss', first_id, id from n where id <> first_id"""
    return {"p4_found": p4}
