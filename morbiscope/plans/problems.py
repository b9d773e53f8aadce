"""The general data problems over the project's tables: p2, p3, p5 and p6, with SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morbiscope.functions import normal as N
from morbiscope.operators.asof import as_known_join
from morbiscope.operators.dyadic import periods_and_gaps
from morbiscope.operators.snapshot_diff import snapshot_changes
from morbiscope.runtime import fresh_dir, table
from morbiscope.streaming.seen_store import deduplicate_deliveries


def _messages(raw: DataFrame) -> DataFrame:
    return raw.select(
        N.trim_all(F.col("guid")).alias("guid"),
        F.coalesce(N.key_upper(F.col("feed_country")), F.lit("")).alias("country"),
        F.col("delivery_id").alias("id"),
        N.instant_micros(F.col("_fetched_at")).alias("at"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of ``news_rss`` that must go."""
    store = deduplicate_deliveries(spark, f"{sf_dir}/news_rss.parquet", fresh_dir(spark, "seen"), _messages, ["guid", "country"])
    return store.removed().select(F.col("id").alias("delivery_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VNM province rows of ``dengue_history`` with the new code known at their start."""
    events = (
        table(spark, sf_dir, "dengue_history")
        .where("iso3 = 'VNM' and s_res = 'Admin1' and p_code is not null and start_date is not null")
        .select("obs_id", N.key_upper(F.col("p_code")).alias("code"), "start_date")
    )
    changes = table(spark, sf_dir, "vn_province_crosswalk").select(
        N.key_upper(F.col("old_pcode_ps")).alias("code"),
        N.parse_day(F.col("effective_from")).alias("effective"),
        N.parse_day(F.col("announced_on")).alias("announced"),
        N.key_upper(F.col("new_pcode")).alias("new_pcode"),
    )
    found = as_known_join(
        events, changes, key="code", event_day="start_date", visible=["effective", "announced"], rank=["effective", "announced"], attributes=["new_pcode"]
    )
    return found.select("obs_id", F.coalesce("known_new_pcode", F.lit("NONE")).alias("new_pcode"))


def _covered(name: str, key: str, start, resolution) -> list:
    kind = N.key_lower(resolution)
    end = (
        F.when(kind.isin("week", "epiweek", "isoweek"), F.date_add(start, 7))
        .when(kind == "month", F.add_months(F.trunc(start, "month"), 1))
        .when(kind == "year", F.add_months(F.trunc(start, "year"), 12))
    )
    return [F.concat(F.lit(name + "\x00"), F.col(key)).alias("series"), start.alias("start"), end.alias("end")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous reporting periods and gaps of every series."""
    od = table(spark, sf_dir, "opendengue").select("UUID", "T_res", N.parse_day(F.col("calendar_start_date")).alias("d"))
    od = od.select(*_covered("opendengue", "UUID", F.col("d"), F.col("T_res")))
    dh = table(spark, sf_dir, "dengue_history").select(*_covered("dengue_history", "series_id", F.col("start_date"), F.col("t_res")))
    found = periods_and_gaps(od.unionByName(dh), key="series", start="start", end="end")
    parts = F.split("group_key", "\x00", 2)
    return found.select(
        parts[0].alias("table_name"),
        parts[1].alias("series_id"),
        "span_kind",
        F.date_format("start_day", "yyyy-MM-dd").alias("start_day"),
        F.date_format("end_day", "yyyy-MM-dd").alias("end_day"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between consecutive snapshots of ``who_gho``."""
    c = F.col
    rows = table(spark, sf_dir, "who_gho").select(
        N.key_upper(c("REPORTING_UNIT")).alias("reporting_unit"),
        N.key_upper(c("ISO3")).alias("iso3"),
        N.parse_int(c("YEAR")).alias("year_num"),
        N.key_lower(c("DATE_TYPE")).alias("date_type"),
        N.parse_int(c("DATE_NUM")).alias("date_num"),
        N.trim_all(c("ingestion_date")).alias("ingestion_date"),
        N.parse_number(c("CASES")).alias("cases"),
        N.parse_day(c("START_DATE")).alias("start_date"),
        N.instant_micros(c("_fetched_at")).alias("fetched"),
    )
    return snapshot_changes(rows, ["reporting_unit", "iso3", "year_num", "date_type", "date_num"], ["cases", "start_date"], "ingestion_date", "fetched").select(
        "reporting_unit", "iso3", "year_num", "date_type", "date_num", "ingestion_date", "change_kind"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found}


# White space of any kind around a text, for DuckDB.
_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _day(x: str) -> str:
    t = _trim(x)
    return (
        f"try_cast(case when regexp_full_match({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?') or regexp_full_match({t}, '\\d{{4}}/\\d{{2}}/\\d{{2}}([T ].*)?') then replace(left({t}, 10), '/', '-') "
        f"when regexp_full_match({t}, '\\d{{8}}') then left({t}, 4) || '-' || substr({t}, 5, 2) || '-' || substr({t}, 7, 2) end as date)"
    )


def _placeholder_null(x: str) -> str:
    t = _trim(x)
    return f"case when upper({t}) not in ('', 'NA', 'N/A', 'NULL', 'NONE') then {t} end"


def oracle_sql() -> dict[str, str]:
    # The table holds instants with an explicit zone, or none.
    at = f"coalesce(try_cast({_trim('_fetched_at')} as timestamptz), '-infinity'::timestamptz)"
    p2 = f"""
select delivery_id from (
  select delivery_id, row_number() over (partition by {_trim('guid')}, coalesce(upper({_trim('feed_country')}), '') order by {at} desc, delivery_id) as n
  from news_rss where guid is not null) where n > 1"""
    p3 = f"""
with e as (select obs_id, upper({_trim('p_code')}) as code, start_date from dengue_history
           where iso3 = 'VNM' and s_res = 'Admin1' and p_code is not null and start_date is not null),
c as (select upper({_trim('old_pcode_ps')}) as code, {_day('effective_from')} as eff, {_day('announced_on')} as ann, upper({_trim('new_pcode')}) as new_pcode from vn_province_crosswalk),
j as (select e.obs_id, c.new_pcode, row_number() over (partition by e.obs_id order by c.eff desc nulls last, c.ann desc nulls last, c.new_pcode desc nulls last) as n
      from e left join c on e.code = c.code and c.eff <= e.start_date and c.ann <= e.start_date)
select obs_id, coalesce(new_pcode, 'NONE') as new_pcode from j where n = 1"""
    p5 = f"""
with r as (
  select 'opendengue' as table_name, UUID as series_id, {_day('calendar_start_date')} as s, lower({_trim('T_res')}) as res from opendengue
  union all select 'dengue_history', series_id, start_date, lower({_trim('t_res')}) from dengue_history),
i as (
  select distinct table_name, series_id, s, cast(case when res in ('week', 'epiweek', 'isoweek') then s + interval 7 day
    when res = 'month' then date_trunc('month', s) + interval 1 month when res = 'year' then date_trunc('year', s) + interval 1 year end as date) as e
  from r where series_id is not null and s is not null and res in ('week', 'epiweek', 'isoweek', 'month', 'year')),
f as (select *, max(e) over (partition by table_name, series_id order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by table_name, series_id order by s, e rows unbounded preceding) as grp from f),
p as (select table_name, series_id, grp, min(s) as s, max(e) as e from g group by all),
q as (select *, lead(s) over (partition by table_name, series_id order by s) as nxt from p)
select table_name, series_id, 'period' as span_kind, strftime(s, '%Y-%m-%d') as start_day, strftime(e, '%Y-%m-%d') as end_day from q
union all select table_name, series_id, 'gap', strftime(e, '%Y-%m-%d'), strftime(nxt, '%Y-%m-%d') from q where nxt is not null"""
    num = lambda x: f"try_cast({_placeholder_null(x)} as decimal(38,9))"
    p6 = f"""
with r as (select upper({_trim('REPORTING_UNIT')}) as reporting_unit, upper({_trim('ISO3')}) as iso3, cast({num('YEAR')} as int) as year_num, lower({_trim('DATE_TYPE')}) as date_type,
  cast({num('DATE_NUM')} as int) as date_num, {_trim('ingestion_date')} as ingestion_date, {num('CASES')} as cases, {_day(_placeholder_null('START_DATE'))} as start_date, {at} as fetched from who_gho),
u as (select * from (select *, row_number() over (partition by reporting_unit, iso3, year_num, date_type, date_num, ingestion_date
  order by fetched desc, cases desc nulls last, start_date desc nulls last) as n from r) where n = 1),
d as (select ingestion_date, lead(ingestion_date) over (order by ingestion_date) as nxt from (select distinct ingestion_date from u)),
o as (select u.*, d.nxt from u join d using (ingestion_date) where d.nxt is not null),
n as (select * from u where ingestion_date > (select min(ingestion_date) from u))
select coalesce(n.reporting_unit, o.reporting_unit) as reporting_unit, coalesce(n.iso3, o.iso3) as iso3, coalesce(n.year_num, o.year_num) as year_num,
  coalesce(n.date_type, o.date_type) as date_type, coalesce(n.date_num, o.date_num) as date_num, coalesce(n.ingestion_date, o.nxt) as ingestion_date,
  case when o.n is null then 'added' when n.n is null then 'removed' else 'changed' end as change_kind
from o full outer join n on o.nxt = n.ingestion_date and o.reporting_unit = n.reporting_unit and o.iso3 = n.iso3 and o.year_num = n.year_num and o.date_type = n.date_type and o.date_num = n.date_num
where o.n is null or n.n is null or o.cases is distinct from n.cases or o.start_date is distinct from n.start_date"""
    return {"p2_found": p2, "p3_found": p3, "p5_found": p5, "p6_found": p6}
