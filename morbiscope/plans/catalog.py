"""Queries that run each operator over whole tables, each with the SQL it must agree with."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morbiscope.functions import expressions as X
from morbiscope.operators import checks as C
from morbiscope.operators import latest as L
from morbiscope.operators import mapping as M
from morbiscope.operators import periods as P
from morbiscope.operators import quality as Q
from morbiscope.plans import ingest as I
from morbiscope.plans import pipelines
from morbiscope.plans import runs as U
from morbiscope.runtime import fresh_dir, spread, table, written
from morbiscope.sources import readers as R
from morbiscope.sources.store import TableStore

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
AS_OF, PROCESSED = date(2026, 10, 15), datetime(2026, 10, 15)
c = F.col


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- periods ------------------------------------------------------------------------------------------------
def _order_periods(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    kind = F.when(p.isin("1", "4"), "week").when(p.isin("2", "5"), "month").otherwise("year")
    rows = o.select(c("o_custkey").alias("cust"), F.when(p.isin("4", "5"), "B").otherwise("A").alias("feed"), kind.alias("t_res"), c("o_orderdate").alias("ts"))
    start = F.when(c("t_res") == "week", F.date_trunc("week", "ts")).when(c("t_res") == "month", F.date_trunc("month", "ts")).otherwise(F.date_trunc("year", "ts"))
    periods = rows.groupBy("cust", "feed", "t_res", start.cast("date").alias("start_date")).agg(F.count("*").alias("n"))
    return periods.withColumn("period_end", X.period_end(c("start_date"), c("t_res")))


_PERIODS = """
with o as (select o_custkey as cust, case when left(o_orderpriority, 1) in ('4', '5') then 'B' else 'A' end as feed,
  case when left(o_orderpriority, 1) in ('1', '4') then 'week' when left(o_orderpriority, 1) in ('2', '5') then 'month' else 'year' end as t_res, o_orderdate as ts from orders),
t as (select cust, feed, t_res, cast(case t_res when 'week' then date_trunc('week', ts) when 'month' then date_trunc('month', ts) else date_trunc('year', ts) end as date) as start_date, count(*) as n from o group by all),
r as (select *, cast(case t_res when 'week' then start_date + interval 7 day when 'month' then start_date + interval 1 month else start_date + interval 12 month end as date) as period_end from t)"""
_MEETS = "b.cust = x.cust and x.start_date < b.period_end and b.start_date < x.period_end"


@query(
    _PERIODS
    + f""",
aw as (select * from r where feed = 'A' and t_res = 'week'),
am as (select * from r x where feed = 'A' and t_res = 'month' and not exists (select 1 from aw b where {_MEETS})),
a2 as (select * from aw union all select * from am),
ay as (select * from r x where feed = 'A' and t_res = 'year' and not exists (select 1 from a2 b where {_MEETS})),
pa as (select * from r where feed = 'A'),
bw as (select * from r x where feed = 'B' and t_res = 'week' and not exists (select 1 from pa b where {_MEETS})),
bm as (select * from r x where feed = 'B' and t_res = 'month' and not exists (select 1 from pa b where {_MEETS}) and not exists (select 1 from bw b where {_MEETS}))
select * from a2 union all select * from ay union all select * from bw union all select * from bm"""
)
def period_history(spark, sf):
    return _period_history(spark, sf)[0]


def _period_history(spark: SparkSession, sf: str) -> tuple[DataFrame, list[C.Check]]:
    rows = written(_order_periods(spark, sf), "order-periods")  # the sweep and the join with its verdicts read it
    a, b = c("feed") == "A", c("feed") == "B"
    ranking = [[a & (c("t_res") == r) for r in ("week", "month", "year")], [b & (c("t_res") == r) for r in ("week", "month")]]
    return P.select_periods(rows, ["cust"], ranking, "orders")


@query(_PERIODS + f" select x.cust, x.start_date, x.n from r x where feed = 'A' and t_res = 'month' and not exists (select 1 from r b where b.feed = 'A' and b.t_res = 'week' and {_MEETS})")
def interval_anti_join(spark, sf):
    rows = written(_order_periods(spark, sf).where("feed = 'A'"), "order-periods")
    return P.disjoint_from(rows.where("t_res = 'month'"), rows.where("t_res = 'week'"), ["cust"]).select("cust", "start_date", "n")


@query(_PERIODS + " select cust, feed, t_res, start_date from (select *, max(period_end) over (partition by cust order by start_date, period_end, feed, t_res rows between unbounded preceding and 1 preceding) as reach from r) where start_date < reach")
def overlap_check(spark, sf):
    return P.overlapping(written(_order_periods(spark, sf), "order-periods"), ["cust"], ["feed", "t_res"]).select("cust", "feed", "t_res", "start_date")


@query(
    _PERIODS
    + """, k as (select *, year(start_date) as yr, case t_res when 'week' then 0 when 'month' then 1 else 2 end as rk from r),
m as (select *, min(rk) over (partition by cust, yr) as least from k) select cust, yr, sum(n) as n from m where rk = least group by 1, 2"""
)
def finest_resolution(spark, sf):
    rows = _order_periods(spark, sf).withColumns({"yr": F.year("start_date"), "rk": X.preference(c("t_res"), ["week", "month"])})
    return P.finest_per_group(rows, ["cust", "yr"], "rk").groupBy("cust", "yr").agg(F.sum("n").alias("n"))


# ---- latest, priority, hierarchy ----------------------------------------------------------------------------
@query(
    """select l_orderkey, l_linenumber, l_returnflag, l_quantity from (select *, row_number() over (partition by l_orderkey
  order by case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end, l_shipdate desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem) where k = 1"""
)
def keep_best_conflict_checked(spark, sf):
    """Its conflicts are the rows of ``keep_best_conflicts``."""
    best, _ = _keep_best(spark, sf)
    return best.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


def _keep_best(spark: SparkSession, sf: str) -> tuple[DataFrame, list[C.Check]]:
    li = table(spark, sf, "lineitem")
    return L.best_per_key(li, ["l_orderkey"], X.preference(c("l_returnflag"), ["R", "A"]), ["l_linestatus"], [c("l_shipdate").desc(), c("l_linenumber"), c("l_partkey"), c("l_suppkey"), c("l_extendedprice")], "lineitem")


@query(
    """select 'lineitem: conflicting l_linestatus within one key' as "check", '{"l_orderkey":' || l_orderkey || ',"__priority":' || p || ',"n_l_linestatus":' || count(distinct l_linestatus) || '}' as key
from (select *, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end as p from lineitem) group by l_orderkey, p having count(distinct l_linestatus) > 1"""
)
def keep_best_conflicts(spark, sf):
    return C.violation_rows(*_keep_best(spark, sf)[1])


@query("select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) as k from events) where k = 1")
def latest_observation(spark, sf):
    return L.first_per_key(table(spark, sf, "events"), ["user_id", "event_type"], [c("ts").desc(), c("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query(
    """with h as (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as k from supplier)
select s_nationkey, cast(null as varchar) as s_name, s_suppkey, s_acctbal from h where k = 1 union all select s_nationkey, s_name, s_suppkey, s_acctbal from supplier"""
)
def first_child_as_parent(spark, sf):
    s = table(spark, sf, "supplier")
    return L.with_parents(s, "s_nationkey", [c("s_acctbal").desc(), c("s_suppkey")], {"s_name": F.lit(None)}).select("s_nationkey", "s_name", "s_suppkey", "s_acctbal")


@query("select ingestion_date, count(*) as n_rows from who_gho where ingestion_date = (select max(ingestion_date) from who_gho) group by 1")
def snapshot_latest(spark, sf):
    return L.rows_of_latest_snapshot(table(spark, sf, "who_gho"), "ingestion_date").groupBy("ingestion_date").agg(F.count("*").alias("n_rows"))


@query(
    """with v as (select distinct release from opendengue where regexp_full_match(trim(release), '[Vv]?[0-9]+(\\.[0-9]+)*')),
t as (select release from v order by list_transform(string_split(regexp_replace(trim(release), '^[Vv]', ''), '.'), lambda x: cast(x as int)) desc limit 1)
select release, count(*) as n_rows from opendengue where release = (select release from t) group by 1"""
)
def version_latest_numeric(spark, sf):
    return L.rows_of_latest_version(table(spark, sf, "opendengue"), "release").groupBy("release").agg(F.count("*").alias("n_rows"))


# ---- checks -------------------------------------------------------------------------------------------------
@query("select text, count(*) as n_rows from documents group by 1 having count(*) > 1")
def duplicate_keys(spark, sf):
    return C.duplicate_keys(table(spark, sf, "documents"), "text")


@query("select text, count(distinct lang) as n_lang, count(distinct source) as n_source from documents group by 1 having count(distinct lang) > 1 or count(distinct source) > 1")
def conflict_keys(spark, sf):
    return C.conflicting_keys(table(spark, sf, "documents"), ["text"], ["lang", "source"])


@query("select p_brand, count(distinct p_type) as n_p_type, count(distinct p_size) as n_p_size from part group by 1 having count(distinct p_type) <> 1 or count(distinct p_size) <> 1")
def functional_dependency(spark, sf):
    return C.dependency_breaks(table(spark, sf, "part"), "p_brand", ["p_type", "p_size"])


@query("select obs_id from dengue_history h where not exists (select 1 from administrative_boundaries b where b.iso3 = h.iso3 and b.p_code = h.p_code)")
def orphan_anti_join(spark, sf):
    """Rows whose code is in no list (a null code is in none)."""
    return M.orphans(table(spark, sf, "dengue_history"), table(spark, sf, "administrative_boundaries"), ["iso3", "p_code"]).select("obs_id")


# ---- text, numbers, dates -----------------------------------------------------------------------------------
def _clean(x: str) -> str:
    t = f"regexp_replace(regexp_replace({x}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '^ | $', '', 'g')"
    return f"case when upper({t}) not in ('', 'NA', 'N/A', 'NULL', 'NONE') then {t} end"


def _title(x: str) -> str:
    part = "list_transform(string_split(w, ' '), lambda v: upper(left(v, 1)) || lower(substr(v, 2)))"
    return f"array_to_string(list_transform(string_split(lower({x}), '-'), lambda w: array_to_string({part}, ' ')), '-')"


@query(f"select record_id, {_clean('adm_1_name')} as adm_1, {_clean('ISO_A0')} as iso, {_clean('RNE_iso_code')} as rne from opendengue")
def clean_text_nulls(spark, sf):
    od = table(spark, sf, "opendengue")
    return od.select("record_id", X.clean_text(c("adm_1_name")).alias("adm_1"), X.clean_text(c("ISO_A0")).alias("iso"), X.clean_text(c("RNE_iso_code")).alias("rne"))


@query(
    f"""with a as (select distinct adm_0_name, adm_1_name from administrative_boundaries),
t as (select adm_0_name, adm_1_name, {_title(_clean('adm_0_name'))} as titled, regexp_replace({_title("regexp_replace(" + _clean('adm_1_name') + ", '([a-z])([A-Z])', '\\1 \\2', 'g')")}, ' +', '', 'g') as compact from a)
select *, lower(compact) as compact_key from t"""
)
def title_compact_names(spark, sf):
    a = table(spark, sf, "administrative_boundaries").select("adm_0_name", "adm_1_name").distinct()
    return a.select("adm_0_name", "adm_1_name", X.hyphen_title(c("adm_0_name")).alias("titled"), X.compact_title(c("adm_1_name")).alias("compact"), X.compact_key(c("adm_1_name")).alias("compact_key"))


def _digits(x: str, pattern: str, kind: str) -> str:
    return f"case when regexp_full_match({_clean(x)}, '{pattern}') then try_cast({_clean(x)} as {kind}) end"


@query(
    f"select record_id, {_digits('Year', '[0-9][0-9][0-9][0-9]', 'int')} as year_num, {_digits('dengue_total', '[0-9]+', 'bigint')} as cases, "
    f"case when regexp_full_match({_clean('calendar_start_date')}, '[0-9]+-[0-9]+-[0-9]+') and length({_clean('calendar_start_date')}) = 10 then try_cast({_clean('calendar_start_date')} as date) end as start_date from opendengue"
)
def guarded_parse(spark, sf):
    od = table(spark, sf, "opendengue")
    return od.select("record_id", X.digits_as(c("Year"), "int", r"\d{4}").alias("year_num"), X.digits_as(c("dengue_total")).alias("cases"), X.day(c("calendar_start_date")).alias("start_date"))


@query(
    """with w as (select REPORTING_UNIT as unit, ISO3 as iso, try_cast(trim(YEAR) as int) as y, try_cast(trim(DATE_NUM) as int) as m from who_gho where lower(trim(DATE_TYPE)) = 'month' and START_DATE is null)
select unit, iso, y, m, case when m between 1 and 12 then make_date(y, m, 1) end as start_date from w"""
)
def derived_month_start(spark, sf):
    w = table(spark, sf, "who_gho").where((F.lower(F.trim("DATE_TYPE")) == "month") & c("START_DATE").isNull())
    w = w.select(c("REPORTING_UNIT").alias("unit"), c("ISO3").alias("iso"), X.digits_as(c("YEAR"), "int", r"\d{4}").alias("y"), X.digits_as(c("DATE_NUM"), "int", r"\d{1,2}").alias("m"))
    return w.withColumn("start_date", X.month_start(c("y"), c("m")))


@query(
    """with t as (select delivery_id, regexp_replace(trim(pubDate), '^[A-Za-z]{3},\\s*', '') as d from news_rss)
select delivery_id, case when d like '%-0000' then null else cast(coalesce(try_strptime(regexp_replace(d, '(UT|GMT|UTC|Z)$', '+0000'), '%d %b %Y %H:%M:%S %z')) as timestamptz) at time zone 'UTC' end as published from t"""
)
def rfc822_parse(spark, sf):
    return table(spark, sf, "news_rss").select("delivery_id", X.clock(X.rfc822(c("pubDate"))).alias("published"))


def _decoded(x: str) -> str:
    """The entities that the news hold, and white space of any kind as one blank; empty as null."""
    out = x
    for entity, sign in (("&nbsp;", " "), ("&mdash;", "—"), ("&#8230;", "…"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{sign}')"
    return f"nullif(regexp_replace(regexp_replace({out}, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g'), '')"


_BODY, _HEADLINE = _decoded("regexp_replace(description, '</?[a-zA-Z][^<>]*>', ' ', 'g')"), _decoded("title")


@query(f"select delivery_id, {_BODY} as body, {_HEADLINE} as headline from news_rss")
def html_to_text(spark, sf):
    return table(spark, sf, "news_rss").select("delivery_id", X.html_text(c("description")).alias("body"), X.plain_title(c("title")).alias("headline"))


_TAGS = {"outbreak": "outbreak|wabah|ổ dịch|surto", "fogging": "fogging|misting|phun", "hospital": "hospital|bệnh viện|ospital|โรงพยาบาล"}


@query(
    "select delivery_id, "
    + ", ".join(f"regexp_matches(lower(concat_ws(' ', title, description)), '{p}') as has_{n}" for n, p in _TAGS.items())
    + " from news_rss"
)
def keyword_tagging(spark, sf):
    n = table(spark, sf, "news_rss")
    texts = [c("title"), c("description")]
    return n.select("delivery_id", *[X.any_pattern(texts, [p]).alias(f"has_{k}") for k, p in _TAGS.items()])


@query("select delivery_id, case when ends_with(title, ' - ' || source) then left(title, length(title) - length(source) - 3) else title end as headline from news_rss")
def headline_suffix(spark, sf):
    return table(spark, sf, "news_rss").select("delivery_id", X.without_suffix(c("title"), c("source")).alias("headline"))


_STOP = ("the", "and", "for", "was", "were", "with", "from", "that", "this", "are")


@query(f"select w as word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) where length(w) > 2 and w not in {_STOP} group by 1")
def word_frequency(spark, sf):
    return Q.word_counts(table(spark, sf, "documents"), X.words(c("text"), _STOP))


@query(f"select w as word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) where length(w) > 2 and w not in {_STOP} group by 1 order by n desc, word limit 20")
def topk_words(spark, sf):
    return Q.top(Q.word_counts(table(spark, sf, "documents"), X.words(c("text"), _STOP)), 20, [c("n").desc(), c("word")])


@query("select p_partkey, regexp_replace(regexp_replace(upper(p_name || ' City'), '\\b(CITY|PROVINCE|REGION|STATE|DISTRICT|MUNICIPALITY)\\b', '', 'g'), '[^A-Z0-9]', '', 'g') as bare, round(log10(p_retailprice), 6) as scale from part")
def bare_names_log_scale(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.bare_name(F.concat("p_name", F.lit(" City"))).alias("bare"), F.round(X.log_scale(c("p_retailprice")), 6).alias("scale"))


@query(
    """select obs_id, regexp_replace(_source_file, '^.*/who_gho/', '') as file, case t_res when 'isoweek' then 'week' when 'epiweek' then 'week' else t_res end as kind,
case t_res when 'isoweek' then 0 when 'epiweek' then 1 when 'month' then 2 else 3 end as rk, cast(case when t_res in ('isoweek', 'epiweek') then start_date + interval 7 day when t_res = 'month' then start_date + interval 1 month when t_res = 'year' then start_date + interval 12 month end as date) as period_end from dengue_history"""
)
def labels_ranks_periods(spark, sf):
    d = table(spark, sf, "dengue_history")
    return d.select(
        "obs_id",
        X.below(c("_source_file"), "who_gho").alias("file"),
        X.relabel(c("t_res"), {"isoweek": "week", "epiweek": "week"}).alias("kind"),
        X.preference(c("t_res"), ["isoweek", "epiweek", "month"]).alias("rk"),
        X.period_end(c("start_date"), c("t_res")).alias("period_end"),
    )


@query("select delivery_id, case when regexp_full_match(trim(source_url), 'https?://[^\\s]+') then trim(source_url) end as url from news_rss")
def web_addresses(spark, sf):
    return table(spark, sf, "news_rss").select("delivery_id", X.web_address(c("source_url")).alias("url"))


# ---- filters ------------------------------------------------------------------------------------------------
@query("select record_id, upper(trim(ISO_A0)) as iso from opendengue where upper(trim(ISO_A0)) in ('THA', 'VNM', 'LAO') and coalesce(adm_2_name, '') not like '#%'")
def scope_filter_isin(spark, sf):
    od = table(spark, sf, "opendengue")
    kept = od.where(F.upper(F.trim("ISO_A0")).isin("THA", "VNM", "LAO") & ~F.startswith(F.coalesce("adm_2_name", F.lit("")), F.lit("#")))
    return kept.select("record_id", F.upper(F.trim("ISO_A0")).alias("iso"))


@query(
    """select event_id from events where regexp_matches(event_type, '^[a-z_]+$') and value between 1 and 50 and not isnan(value) and ts <= timestamp '2024-01-20'
and try_cast(json_extract_string(props, '$.k') as int) between 1 and 53"""
)
def validity_filter(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    ok = C.all_of(c("event_type").rlike("^[a-z_]+$"), c("value").between(1, 50), ~F.isnan("value"), c("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"), k.between(1, 53))
    return e.where(ok).select("event_id")


@query("select obs_id from dengue_history where _source is distinct from 'who_gho' and (s_res <> 'Admin1' or adm_1_name is not null) and (t_res <> 'month' or day(start_date) = 1) and (t_res <> 'year' or (day(start_date) = 1 and month(start_date) = 1))")
def alignment_filter(spark, sf):
    d = table(spark, sf, "dengue_history")
    ok = C.all_of((c("s_res") != "Admin1") | c("adm_1_name").isNotNull(), (c("t_res") != "month") | (F.dayofmonth("start_date") == 1), (c("t_res") != "year") | ((F.dayofmonth("start_date") == 1) & (F.month("start_date") == 1)))
    return d.where(~c("_source").eqNullSafe("who_gho") & ok).select("obs_id")


# ---- mapping ------------------------------------------------------------------------------------------------
_KEY = "lower(regexp_replace(" + _title("regexp_replace(" + _clean("adm_1_name") + ", '([a-z])([A-Z])', '\\1 \\2', 'g')") + ", ' +', '', 'g'))"


@query(
    f"""with l as (select iso3, {_KEY} as k, p_code as cod from administrative_boundaries),
s as (select obs_id, iso3, s_res, {_KEY} as k, case when s_res = 'Admin1' and iso3 in ('THA', 'KHM') and regexp_full_match(p_code, '(TH|KH)-[0-9][0-9]?') then left(p_code, 2) || lpad(substr(p_code, 4), 2, '0') end as guess from dengue_history)
select s.obs_id, coalesce(n.cod, g.cod) as mapped_code, case when n.cod is not null then 'compact_name' when g.cod is not null then 'source_code' else 'unmatched' end as map_method
from s left join l n on n.iso3 = s.iso3 and n.k is not distinct from s.k and (s.s_res = 'Admin0' or (s.s_res = 'Admin1' and s.iso3 <> 'VNM'))
left join l g on g.iso3 = s.iso3 and g.cod = s.guess and g.k is not null"""
)
def code_reformat_map(spark, sf):
    return _code_reformat_map(spark, sf)[0].select("obs_id", "mapped_code", "map_method")


def _code_reformat_map(spark: SparkSession, sf: str) -> tuple[DataFrame, list[C.Check]]:
    lookup = table(spark, sf, "administrative_boundaries").select("iso3", X.compact_key(c("adm_1_name")).alias("k"), c("p_code").alias("cod"))
    rows = table(spark, sf, "dengue_history").select("obs_id", "iso3", "s_res", "adm_1_name", "p_code")
    guess = F.when((c("s_res") == "Admin1") & c("iso3").isin("THA", "KHM"), X.padded_code(c("p_code"), ["TH", "KH"]))
    use = (c("s_res") == "Admin0") | ((c("s_res") == "Admin1") & (c("iso3") != "VNM"))
    return M.map_codes(rows, lookup, scope="iso3", name_key=X.compact_key(c("adm_1_name")), lookup_key="k", code="cod", code_guess=guess, name_applies=use, label="codes")


@query("select count(*) filter (where r_name is not null) as known_rows, count(*) filter (where r_name is null) as unknown_rows from nation left join (select * from region where r_regionkey < 3) on n_regionkey = r_regionkey")
def name_code_validation(spark, sf):
    return _name_code_validation(spark, sf)[0]


def _name_code_validation(spark: SparkSession, sf: str) -> tuple[DataFrame, list[C.Check]]:
    region = table(spark, sf, "region").where("r_regionkey < 3").select(c("r_regionkey").alias("n_regionkey"), "r_name")
    return M.name_check(table(spark, sf, "nation"), region, "n_regionkey", c("n_name"), "r_name", "nation")


@query("select d.doc_id, coalesce(d.iso3, b.iso3) as iso, coalesce(b.valid_on, date '1970-01-01') as valid_on from documents d left join (select iso3, valid_on from administrative_boundaries where adm_1_name is null) b on d.iso3 = b.iso3")
def enrich_left_coalesce(spark, sf):
    b = table(spark, sf, "administrative_boundaries").where("adm_1_name is null").select("iso3", c("iso3").alias("iso_b"), "valid_on")
    d = table(spark, sf, "documents").select("doc_id", "iso3").withColumn("none_on", F.lit("1970-01-01").cast("date"))
    return M.enrich(d, b, ["iso3"], {"iso": ("iso3", "iso_b"), "valid_on": ("valid_on", "none_on")}).select("doc_id", "iso", "valid_on")


@query(
    """with a as (select distinct upper(trim(old_pcode_ps)) as code from vn_province_crosswalk where old_pcode_ps is not null),
h as (select distinct upper(trim(p_code)) as code from dengue_history where iso3 = 'VNM' and p_code is not null)
select coalesce(a.code, h.code) as code, case when h.code is null then 'left_only' when a.code is null then 'right_only' else 'same' end as status from a full outer join h on a.code = h.code"""
)
def reconcile_full_outer(spark, sf):
    a = table(spark, sf, "vn_province_crosswalk").where("old_pcode_ps is not null").select(F.upper(F.trim("old_pcode_ps")).alias("code"))
    h = table(spark, sf, "dengue_history").where("iso3 = 'VNM' and p_code is not null").select(F.upper(F.trim("p_code")).alias("code"))
    return M.reconcile(a, h, "code")


@query("select n_regionkey, round(sum(o_totalprice), 2) as revenue from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def crosswalk_rollup(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey")).select(c("c_nationkey").alias("n_nationkey"), c("o_totalprice").alias("revenue"))
    out = M.roll_up(o, table(spark, sf, "nation"), "n_nationkey", "n_regionkey", "revenue")
    return out.select("n_regionkey", F.round("revenue", 2).alias("revenue"))


@query("select count(*) as n_rows, count(distinct n_nationkey) as old_units, count(distinct n_regionkey) as new_units, count(*) - count(distinct n_nationkey) as repeated from nation")
def crosswalk_shape(spark, sf):
    return M.crosswalk_counts(table(spark, sf, "nation"), "n_nationkey", "n_regionkey")


@query(
    """with a as (select distinct upper(trim(old_pcode_ps)) as code, new_name from vn_province_crosswalk where old_pcode_ps is not null),
b as (select distinct upper(trim(old_pcode_ps)) as code, old_name from vn_province_crosswalk where old_pcode_ps is not null and effective_from > '2005')
select coalesce(a.code, b.code) as code, case when b.code is null then 'left_only' when a.code is null then 'right_only' when a.new_name is not distinct from b.old_name then 'same' else 'renamed' end as status from a full outer join b on a.code = b.code"""
)
def reconcile_renamed(spark, sf):
    x = table(spark, sf, "vn_province_crosswalk").where("old_pcode_ps is not null").withColumn("code", F.upper(F.trim("old_pcode_ps")))
    return M.reconcile_with_reference(x, x.where("effective_from > '2005'"), "code", ("new_name", "old_name"))[0]


# ---- sets ---------------------------------------------------------------------------------------------------
@query("select c_custkey as id, c_name as name, c_mktsegment as segment, cast(null as double) as balance from customer union all select s_suppkey, s_name, null, s_acctbal from supplier")
def union_by_name_missing(spark, sf):
    a = table(spark, sf, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("balance"))
    return R.union_by_name(a, b).select("id", "name", "segment", "balance")


@query(
    """with i as (select distinct ingestion_date as s, link as i from news_rss where link is not null), z as (select s, count(*) as n from i group by 1),
p as (select a.s as a, b.s as b, count(*) as shared from i a join i b on a.i = b.i and a.s < b.s group by 1, 2)
select p.a, p.b, shared, round(shared / (x.n + y.n - shared), 6) as overlap from p join z x on x.s = p.a join z y on y.s = p.b"""
)
def set_overlap(spark, sf):
    return Q.set_overlap(table(spark, sf, "news_rss"), "ingestion_date", "link")


@query("select distinct user_id, event_type, cast(ts as date) as day from events")
def distinct_rows(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type", c("ts").cast("date").alias("day")).distinct()


# ---- aggregates ---------------------------------------------------------------------------------------------
@query("select count(*) filter (where value is null) as no_value, count(*) filter (where value > 20) as high, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where props like '%1%') as ones from events")
def conditional_counts(spark, sf):
    return Q.accounting(table(spark, sf, "events"), no_value=c("value").isNull(), high=c("value") > 20, clicks=c("event_type") == "click", ones=c("props").like("%1%"))


@query("select n_values, count(*) as n_groups from (select user_id, cast(ts as date) as d, count(distinct event_type) as n_values from events group by 1, 2) group by 1")
def two_level_agg(spark, sf):
    return Q.distribution_of_counts(table(spark, sf, "events").withColumn("d", c("ts").cast("date")), ["user_id", "d"], "event_type")


@query("select o_orderpriority, count(*) as n, min(o_orderdate) as first_at, max(o_orderdate) as last_at from orders group by 1")
def minmax_group(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@query("select c_nationkey, count(*) filter (where o_orderpriority = '1-URGENT') as p1, count(*) filter (where o_orderpriority = '2-HIGH') as p2, count(*) filter (where o_orderpriority = '5-LOW') as p5 from orders join customer on o_custkey = c_custkey group by 1")
def pivot_counts(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey"))
    return Q.pivot_counts(o, "c_nationkey", "o_orderpriority", {"1-URGENT": "p1", "2-HIGH": "p2", "5-LOW": "p5"})


@query(
    """with m as (select adm_0_name, month(start_date) as month_num, avg(dengue_total) as mean from dengue_history where start_date is not null and dengue_total is not null group by 1, 2)
select adm_0_name, month_num, round(mean / max(mean) over (partition by adm_0_name), 6) as season_index from m"""
)
def seasonality_index(spark, sf):
    d = table(spark, sf, "dengue_history").where("start_date is not null and dengue_total is not null")
    return Q.seasonality(d, "adm_0_name", F.month("start_date"), "dengue_total")


@query(
    " union all ".join(
        f"select '{n}' as column_name, '{t}' as column_type, count(*) as n_rows, count(*) - count({n}) as null_count, count(distinct {n}) as distinct_count, round(100.0 * (count(*) - count({n})) / count(*), 4) as null_percent from documents"
        for n, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("doc_type", "string"), ("iso3", "string"), ("published_at", "timestamp_ntz"), ("received_at", "timestamp_ntz"))
    )
)
def profile_table(spark, sf):
    return Q.profile(table(spark, sf, "documents"))


@query("select count(*) as n_rows, count(*) - (select count(*) from (select distinct * from news_rss)) as duplicate_rows, (select count(*) from (select distinct guid from news_rss)) as distinct_keys, count(*) - (select count(*) from (select distinct guid from news_rss)) as duplicate_keys from news_rss")
def duplicate_report(spark, sf):
    return Q.duplicate_report(table(spark, sf, "news_rss"), ["guid"])


@query(
    """select case when d < 8 then 'week' when d < 32 then 'month' else 'longer' end as span, count(*) as n, min(d) as least, max(d) as most
from (select date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) + 1 as d from lineitem join orders on l_orderkey = o_orderkey) group by 1"""
)
def shipping_delays(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey"))
    d = j.select(X.inclusive_days(c("o_orderdate").cast("date"), c("l_shipdate").cast("date")).alias("d"))
    span = F.when(c("d") < 8, "week").when(c("d") < 32, "month").otherwise("longer")
    return d.groupBy(span.alias("span")).agg(F.count("*").alias("n"), F.min("d").cast("bigint").alias("least"), F.max("d").cast("bigint").alias("most"))


@query(
    """with d as (select l_orderkey, l_linenumber, cast(o_orderdate as date) as first_day, cast(l_shipdate as date) as last_day, case when l_linenumber < 3 then 'Week' when l_linenumber < 6 then 'month' else 'year' end as t_res from lineitem join orders on l_orderkey = o_orderkey),
n as (select *, cast(date_diff('day', first_day, last_day) + 1 as int) as days from d)
select * from n where not coalesce(case lower(t_res) when 'week' then days = 7 when 'month' then days between 28 and 31 when 'year' then days between 365 and 366 end, false)"""
)
def period_length_check(spark, sf):
    """Line items whose time from order to shipping does not fit the resolution that their number stands for."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey"))
    kind = F.when(c("l_linenumber") < 3, "Week").when(c("l_linenumber") < 6, "month").otherwise("year")
    d = j.select("l_orderkey", "l_linenumber", c("o_orderdate").cast("date").alias("first_day"), c("l_shipdate").cast("date").alias("last_day"), kind.alias("t_res"))
    return Q.period_length_check(d, "first_day", "last_day", "t_res")


@query("select adm_0_name, year, count(distinct t_res) as n_t_res from dengue_history group by 1, 2 having count(distinct t_res) > 1")
def mixed_resolution(spark, sf):
    return C.conflicting_keys(table(spark, sf, "dengue_history"), ["adm_0_name", "year"], ["t_res"])


@query("select iso3, count(dengue_total) as n, round(avg(dengue_total), 4) as mean, round(stddev_samp(dengue_total), 4) as std, min(dengue_total) as least, round(quantile_cont(dengue_total, 0.25), 4) as q1, round(quantile_cont(dengue_total, 0.5), 4) as median, round(quantile_cont(dengue_total, 0.75), 4) as q3, max(dengue_total) as most from dengue_history group by 1")
def describe_by_country(spark, sf):
    return Q.describe_by(table(spark, sf, "dengue_history"), ["iso3"], "dengue_total")


@query("select count(*) as n_rows, count(*) filter (where lower(trim(S_res)) in ('admin0', 'admin1')) as in_scope, count(*) filter (where lower(trim(S_res)) not in ('admin0', 'admin1')) as out_of_scope, count(*) filter (where regexp_full_match(dengue_total, '[0-9]+')) as usable_counts from opendengue")
def row_accounting(spark, sf):
    level = F.lower(F.trim("S_res")).isin("admin0", "admin1")
    return Q.accounting(table(spark, sf, "opendengue"), n_rows=F.lit(True), in_scope=level, out_of_scope=~level, usable_counts=c("dengue_total").rlike("^[0-9]+$"))


# ---- sources and store --------------------------------------------------------------------------------------
@query("select event_id, ts, user_id, event_type, value, props, case when event_type = 'click' then 'late' else cast(cast(ts as date) as varchar) end as day from events")
def store_roundtrip(spark, sf):
    """Every partition of ``events`` written, one of them replaced, all read again."""
    # The partition value is text, so rows without a type share the empty one; the type itself stays a column.
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    kind = F.coalesce("event_type", F.lit(""))
    store = TableStore(spark, fresh_dir(spark, "store"), "kind")
    for (k,) in e.select(kind).distinct().collect():  # bounded by the event types
        store.replace_partition(e.where(kind == k), k)
    store.replace_partition(e.where(kind == "click").withColumn("day", F.lit("late")), "click")
    return store.read().drop("kind")


@query("select doc_id, text from documents")
def csv_roundtrip(spark, sf):
    path = fresh_dir(spark, "csv")
    R.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return R.read_csv(spark, path).select(R.csv_value(c("doc_id")).cast("bigint").alias("doc_id"), R.csv_value(c("text")).alias("text"))


@query("select doc_id, text, lang from documents")
def jsonl_roundtrip(spark, sf):
    path = fresh_dir(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.json(path)
    return R.read_jsonl(spark, path).select(c("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


# ---- pipelines ----------------------------------------------------------------------------------------------
def _counts_rows() -> str:
    ok = "adm0 is not null and regexp_full_match(iso3, '[A-Z][A-Z][A-Z]') and sd <= date '2026-10-15' and yr is not null and n is not null and t_res in ('epiweek', 'month', 'year') and (s_res = 'Admin0' or adm1 is not null) and src = 'opendengue' and file is not null and ing is not null"
    return f"""
with l as (select list_transform(string_split(regexp_replace(trim(release), '^[Vv]', ''), '.'), lambda x: cast(x as int)) as v, release from opendengue where regexp_full_match(trim(release), '[Vv]?[0-9]+(\\.[0-9]+)*')),
t as (select {_title(_clean('adm_0_name'))} as adm0, regexp_replace({_title("regexp_replace(" + _clean('adm_1_name') + ", '([a-z])([A-Z])', '\\1 \\2', 'g')")}, ' +', '', 'g') as adm1, upper({_clean('ISO_A0')}) as iso3,
  {_clean('RNE_iso_code')} as p_code, case when regexp_full_match({_clean('calendar_start_date')}, '[0-9]+-[0-9]+-[0-9]+') and length({_clean('calendar_start_date')}) = 10 then try_cast({_clean('calendar_start_date')} as date) end as sd,
  {_digits('Year', '[0-9][0-9][0-9][0-9]', 'int')} as yr, {_digits('dengue_total', '[0-9]+', 'bigint')} as n, case upper({_clean('S_res')}) when 'ADMIN0' then 'Admin0' when 'ADMIN1' then 'Admin1' end as s_res,
  case lower({_clean('T_res')}) when 'week' then 'epiweek' else lower({_clean('T_res')}) end as t_res, {_clean('_source')} as src, {_clean('_source_file')} as file, try_cast({_clean('_ingested_at')} as timestamptz) as ing,
  case lower({_clean('case_definition_standardised')}) when 'total' then 0 when 'suspected and confirmed' then 1 when 'confirmed' then 2 else 3 end as rk
  from opendengue where release = (select release from l order by v desc limit 1)),
k as (select *, min(rk) over (partition by adm0, adm1, iso3, p_code, sd, yr, s_res, t_res) as least from t where s_res is not null and {ok})"""


def _counts_sql() -> str:
    return _counts_rows() + """
select adm0 as adm_0_name, adm1 as adm_1_name, iso3, p_code, sd as start_date, yr as year, s_res, t_res, min(rk) as best_rank, count(*) as candidates from k group by 1, 2, 3, 4, 5, 6, 7, 8"""


@query(_counts_sql())
def counts_grain(spark, sf):
    """Grains of the latest release with the rank of the case definition that holds, and how many rows competed."""
    latest = L.rows_of_latest_version(table(spark, sf, "opendengue"), "release")
    return pipelines.count_candidates(latest, as_of=AS_OF)


_SNAP_DAY = f"case when {_clean('START_DATE')} is not null then case when regexp_full_match({_clean('START_DATE')}, '[0-9]+-[0-9]+-[0-9]+') and length({_clean('START_DATE')}) = 10 then try_cast({_clean('START_DATE')} as date) end when kind = 'month' and num between 1 and 12 then make_date(yr, num, 1) end"


@query(
    f"""with s as (select *, lower({_clean('DATE_TYPE')}) as kind, {_digits('DATE_NUM', '[0-9][0-9]?', 'int')} as num, {_digits('YEAR', '[0-9][0-9][0-9][0-9]', 'int')} as yr, {_digits('CASES', '[0-9]+', 'bigint')} as n, upper({_clean('ISO3')}) as iso
  from who_gho where ingestion_date = (select max(ingestion_date) from who_gho)),
v as (select *, {_SNAP_DAY} as sd from s)
select iso as iso3, yr as year, kind as t_res, num as number, count(*) as candidates, min(sd) as first_start, max(sd) as last_start, cast(sum(n) as bigint) as cases from v
where {_clean('COUNTRY')} is not null and regexp_full_match(iso, '[A-Z][A-Z][A-Z]') and yr is not null and ((kind = 'month' and num between 1 and 12) or (kind in ('isoweek', 'epiweek') and num between 1 and 53))
  and sd <= date '2026-10-15' and n is not null and {_clean('_source')} = 'who_gho' and {_clean('_source_file')} is not null and try_cast({_clean('_ingested_at')} as timestamptz) is not null group by 1, 2, 3, 4"""
)
def snapshot_grain(spark, sf):
    latest = L.rows_of_latest_snapshot(table(spark, sf, "who_gho"), "ingestion_date")
    return pipelines.snapshot_candidates(latest, as_of=AS_OF)


_GRAIN = "adm0, adm1, iso3, p_code, sd, yr, s_res, t_res"


@query(
    _counts_rows()
    + f""",
w as (select {_GRAIN} from (select {_GRAIN}, rk from k group by all having count(distinct n) > 1) group by all),
b as (select *, row_number() over (partition by {_GRAIN} order by rk, ing desc, file, n) as place from k)
select adm0 as adm_0_name, adm1 as adm_1_name, iso3, p_code, sd as start_date, yr as year, n as dengue_total, s_res, t_res, src as _source, file as _source_file, ing at time zone 'UTC' as ingested from b
where place = 1 and not exists (select 1 from w where w.adm0 is not distinct from b.adm0 and w.adm1 is not distinct from b.adm1 and w.iso3 is not distinct from b.iso3 and w.p_code is not distinct from b.p_code
  and w.sd is not distinct from b.sd and w.yr is not distinct from b.yr and w.s_res is not distinct from b.s_res and w.t_res is not distinct from b.t_res)"""
)
def counts_clean(spark, sf):
    """Case counts of the latest release, one row per grain that no check disputes; the others are in ``clean_conflicts``."""
    frame, checks = _counts_clean(spark, sf)
    return _plain(C.undisputed(frame, pipelines.GRAIN, checks), pipelines.HISTORY)


def _plain(frame: DataFrame, contract: dict[str, str]) -> DataFrame:
    kept = [n for n in contract if n not in ("_bronze_ingested_at", "_silver_ingested_at", "pubDate")]
    return frame.select(*kept, X.clock(c("_bronze_ingested_at")).alias("ingested"), *([X.clock(c("pubDate")).alias("published")] if "pubDate" in contract else []))


def _counts_clean(spark: SparkSession, sf: str) -> pipelines.Result:
    latest = spread(L.rows_of_latest_version(table(spark, sf, "opendengue"), "release").select(*pipelines.COUNTS))
    typed = written(pipelines.typed_counts(latest, as_of=AS_OF), "typed-counts")  # the choice and the check read it
    return pipelines.best_counts(typed, PROCESSED)


@query(
    _counts_rows().replace("where s_res is not null and", "where true and").replace("k as (select *, min(rk)", "k0 as (select *, min(rk)")
    + """,
n as (select (select count(*) from t where s_res is not null) as typed, (select count(*) from k0 where s_res is not null) as valid, (select count(*) from (select distinct adm0, adm1, iso3, p_code, sd, yr, s_res, t_res from k0 where s_res is not null)) as output)
select typed as typed_rows, valid as valid_rows, typed - valid as invalid_rows, output as output_rows, valid - output as deduplicated_rows from n"""
)
def counts_accounting(spark, sf):
    latest = L.rows_of_latest_version(table(spark, sf, "opendengue"), "release")
    return pipelines.accounting(pipelines.typed_counts(latest, as_of=AS_OF), pipelines.GRAIN)


_SNAP_ROWS = f"""with s as (select *, lower({_clean('DATE_TYPE')}) as kind, {_digits('DATE_NUM', '[0-9][0-9]?', 'int')} as num, {_digits('YEAR', '[0-9][0-9][0-9][0-9]', 'int')} as yr, {_digits('CASES', '[0-9]+', 'bigint')} as n, upper({_clean('ISO3')}) as iso
  from who_gho where ingestion_date = (select max(ingestion_date) from who_gho)),
v as (select *, {_SNAP_DAY} as sd, {_title(_clean('COUNTRY'))} as adm0, {_clean('_source_file')} as file, try_cast({_clean('_ingested_at')} as timestamptz) as ing from s),
k as (select * from v where adm0 is not null and regexp_full_match(iso, '[A-Z][A-Z][A-Z]') and yr is not null and ((kind = 'month' and num between 1 and 12) or (kind in ('isoweek', 'epiweek') and num between 1 and 53))
  and sd <= date '2026-10-15' and n is not null and {_clean('_source')} = 'who_gho' and file is not null and ing is not null)"""


@query(
    _SNAP_ROWS
    + """,
w as (select iso, yr, kind, num from k group by all having count(distinct n) > 1 or count(distinct sd) > 1),
b as (select *, row_number() over (partition by iso, yr, kind, num order by ing desc, file, n, sd, adm0) as place from k)
select adm0 as adm_0_name, cast(null as varchar) as adm_1_name, b.iso as iso3, cast(null as varchar) as p_code, sd as start_date, b.yr as year, n as dengue_total, 'Admin0' as s_res, b.kind as t_res, 'who_gho' as _source, file as _source_file, ing at time zone 'UTC' as ingested
from b left join w on w.iso = b.iso and w.yr = b.yr and w.kind = b.kind and w.num = b.num where place = 1 and w.iso is null"""
)
def snapshot_clean(spark, sf):
    """National counts of the latest snapshot, one row per key that no check disputes; the others are in ``clean_conflicts``."""
    latest = L.rows_of_latest_snapshot(table(spark, sf, "who_gho"), "ingestion_date")
    typed = written(pipelines.typed_snapshot(latest, as_of=AS_OF), "typed-snapshot")
    calm = C.undisputed(typed, pipelines.SNAPSHOT_KEY, pipelines.best_snapshot(typed, PROCESSED)[1])
    return _plain(pipelines.best_snapshot(calm, PROCESSED)[0], pipelines.HISTORY)


@query(
    _SNAP_ROWS
    + f""",
n as (select (select count(*) from v) as typed, (select count(*) from k) as valid, (select count(*) from (select distinct iso, yr, kind, num from k)) as output,
  (select count(*) from k where {_clean('START_DATE')} is null) as derived_rows, (select count(*) from v where sd > date '2026-10-15') as future_rows)
select typed as typed_rows, valid as valid_rows, typed - valid as invalid_rows, output as output_rows, valid - output as deduplicated_rows, derived_rows, future_rows from n"""
)
def snapshot_accounting(spark, sf):
    latest = L.rows_of_latest_snapshot(table(spark, sf, "who_gho"), "ingestion_date")
    typed = pipelines.typed_snapshot(latest, as_of=AS_OF)
    return pipelines.accounting(typed, pipelines.SNAPSHOT_KEY, derived_rows=c("valid") & c("derived"), future_rows=c("future"))


def _snapshot_clean(spark: SparkSession, sf: str) -> pipelines.Result:
    latest = L.rows_of_latest_snapshot(table(spark, sf, "who_gho"), "ingestion_date")
    return pipelines.clean_snapshot(latest, as_of=AS_OF, processed_at=PROCESSED)


@query()
def clean_conflicts(spark, sf):
    """Violations of the checks of the queries that return rows only."""
    made = [_period_history, _code_reformat_map, _name_code_validation, _counts_clean, _snapshot_clean]
    return C.violation_rows(*[check for f in made for check in f(spark, sf)[1]])


_NEWS_ROWS = f"""with d as (select *, regexp_replace(trim(pubDate), '^[A-Za-z]{{3}},\\s*', '') as pd from news_rss),
t as (select {_clean('guid')} as guid, {_HEADLINE} as title, {_BODY} as description, upper({_clean('feed_country')}) as iso3, upper({_clean('feed_gl')}) as feed_gl, {_clean('feed_query')} as feed_query, {_clean('link')} as link,
  case when pd like '%-0000' then null else try_strptime(regexp_replace(pd, '(UT|GMT|UTC|Z)$', '+0000'), '%d %b %Y %H:%M:%S %z') end as pub, case when regexp_full_match({_clean('source_url')}, 'https?://[^\\s]+') then {_clean('source_url')} end as source_url,
  {_clean('_source_file')} as file, {_clean('_source')} as src, try_cast({_clean('_ingested_at')} as timestamptz) as ing, try_cast({_clean('_fetched_at')} as timestamptz) as fetched from d),
k as (select * from t where guid is not null and title is not null and regexp_full_match(iso3, '[A-Z][A-Z][A-Z]') and regexp_full_match(feed_gl, '[A-Z][A-Z]') and feed_query is not null and regexp_full_match(link, 'https?://[^\\s]+')
  and pub is not null and src = 'news_rss' and file is not null and ing is not null and fetched is not null)"""


@query(
    _NEWS_ROWS
    + """,
b as (select *, row_number() over (partition by guid, iso3, feed_gl, feed_query order by fetched desc, ing desc, file, link, title, pub, description nulls first, source_url nulls first) as place from k)
select guid, title, description, iso3, feed_gl, feed_query, link, source_url, file as _source_file, src as _source, ing at time zone 'UTC' as ingested, pub at time zone 'UTC' as published from b where place = 1"""
)
def news_clean(spark, sf):
    return _plain(pipelines.clean_news(spread(table(spark, sf, "news_rss").select(*pipelines.FEEDS)), processed_at=PROCESSED)[0], pipelines.NEWS)


@query(
    _NEWS_ROWS
    + """,
n as (select (select count(*) from t) as typed, (select count(*) from k) as valid, (select count(*) from (select distinct guid, iso3, feed_gl, feed_query from k)) as output)
select typed as typed_rows, valid as valid_rows, typed - valid as invalid_rows, output as output_rows, valid - output as deduplicated_rows from n"""
)
def news_accounting(spark, sf):
    return pipelines.accounting(pipelines.typed_news(table(spark, sf, "news_rss")), pipelines.NEWS_KEY)


def _history_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dengue_history").select(*[c(n).cast(t).alias(n) for n, t in pipelines.HISTORY.items()])


_HISTORY_OUT = "adm_0_name, adm_1_name, iso3, p_code, start_date, year, dengue_total, s_res, t_res, _source, _source_file"
_COMPACT = "regexp_replace(" + _title("regexp_replace(" + _clean("adm_1_name") + ", '([a-z])([A-Z])', '\\1 \\2', 'g')") + ", ' +', '', 'g')"
_PLACED = "b.s_res = x.s_res and b.iso3 is not distinct from x.iso3 and b.place_name is not distinct from x.place_name and b.place_code is not distinct from x.place_code and x.start_date < b.period_end and b.start_date < x.period_end"


def _history_sql() -> str:
    out = f"""with r as (select * replace ({_COMPACT} as adm_1_name) from dengue_history where s_res = 'Admin0' or (s_res = 'Admin1' and _source = 'opendengue')),
p as (select *, cast(case when t_res in ('epiweek', 'isoweek', 'week') then start_date + interval 7 day when t_res = 'month' then start_date + interval 1 month when t_res = 'year' then start_date + interval 12 month end as date) as period_end,
  case when s_res = 'Admin1' then adm_1_name end as place_name, case when s_res = 'Admin1' then p_code end as place_code from r),
a as (select * from p where _source = 'opendengue' and period_end is not null), o as (select * from p where _source = 'who_gho' and period_end is not null),
a0 as (select * from a where t_res in ('isoweek', 'epiweek')),
a1 as (select * from a x where t_res = 'month' and not exists (select 1 from a0 b where {_PLACED})), a01 as (select * from a0 union all select * from a1),
a2 as (select * from a x where t_res = 'year' and not exists (select 1 from a01 b where {_PLACED})),
f as (select * from o x where not exists (select 1 from a b where {_PLACED})), s0 as (select * from f where t_res = 'isoweek')"""
    for i, kind in enumerate(("epiweek", "month", "year"), 1):
        out += f", n{i} as (select * from f x where t_res = '{kind}' and not exists (select 1 from s{i - 1} b where {_PLACED})), s{i} as (select * from s{i - 1} union all select * from n{i})"
    return out + f" select {_HISTORY_OUT} from a01 union all select {_HISTORY_OUT} from a2 union all select {_HISTORY_OUT} from s3"


@query(_history_sql())
def history_selected(spark, sf):
    """The periods of ``dengue_history`` that do not overlap, by source and resolution."""
    return pipelines.build_history(_history_rows(spark, sf))[0].select(*_HISTORY_OUT.split(", "))


@query(
    f"""with l as (select iso3, {_KEY} as k, p_code as cod from administrative_boundaries),
s as (select * replace ({_COMPACT} as adm_1_name), {_KEY} as k, case when s_res = 'Admin1' and _source = 'opendengue' and iso3 in ('THA', 'KHM') and regexp_full_match(p_code, '(TH|KH)-[0-9][0-9]?') then left(p_code, 2) || lpad(substr(p_code, 4), 2, '0') end as guess from dengue_history)
select s.adm_0_name, s.adm_1_name, s.iso3, coalesce(n.cod, g.cod) as p_code, s.start_date, s.year, s.dengue_total, s.s_res, s.t_res, s._source, s._source_file, case when n.cod is not null then 'compact_name' when g.cod is not null then 'source_code' else 'unmatched' end as map_method
from s left join l n on n.iso3 = s.iso3 and n.k is not distinct from s.k and (s.s_res = 'Admin0' or (s.s_res = 'Admin1' and s.iso3 <> 'VNM')) left join l g on g.iso3 = s.iso3 and g.cod = s.guess and g.k is not null"""
)
def history_mapped(spark, sf):
    return pipelines.map_history(_history_rows(spark, sf), _boundaries(spark, sf))[0].select(*_HISTORY_OUT.split(", "), "map_method")


def _boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "administrative_boundaries").select(*[c(n).cast(t).alias(n) for n, t in pipelines.BOUNDARIES.items()])


@query(
    f"""select count(*) filter (where b.k is not null) as known_rows, count(*) filter (where b.k is null) as unknown_rows from dengue_history h
left join (select iso3, p_code as k from administrative_boundaries where adm_1_name is null and adm_0_name is not null) b on b.iso3 = h.iso3"""
)
def country_check(spark, sf):
    return pipelines.check_countries(_history_rows(spark, sf), _boundaries(spark, sf), "history")[0]


@query(
    f"""with u as (select upper(iso3) as iso3, {_title(_clean('adm_0_name'))} as adm_0_name, {_COMPACT} as adm_1_name, p_code, valid_on, x_coord, y_coord from administrative_boundaries where adm_1_name is not null),
n as (select iso3, p_code as code from administrative_boundaries where adm_1_name is null), h as (select *, row_number() over (partition by iso3 order by p_code) as k from u)
select adm_0_name, adm_1_name, iso3, p_code, valid_on, x_coord, y_coord from u
union all select h.adm_0_name, null, h.iso3, n.code, h.valid_on, null, null from h join n on n.iso3 = h.iso3 where k = 1"""
)
def boundaries_clean(spark, sf):
    """The sheets of the boundaries, made from the table, cleaned: points where there are any, else centres; one derived row per country."""
    b = table(spark, sf, "administrative_boundaries")
    codes = b.where("adm_1_name is null").select("iso3", c("p_code").alias("adm0_pcode"))
    u = b.where("adm_1_name is not null").join(codes, "iso3").withColumn("odd", F.pmod(F.xxhash64("p_code"), F.lit(2)) == 0)
    text = lambda x: c(x).cast("string")
    lineage = [F.lit("hdx_cod_ab").alias("_source"), c("_source_file"), F.lit("2026-10-01T00:00:00Z").alias("_ingested_at"), F.lit("1").alias("admin_level")]
    names = ["iso3", c("adm_0_name").alias("adm0_name"), "adm0_pcode", c("adm_1_name").alias("adm1_name"), c("p_code").alias("adm1_pcode"), text("valid_on").alias("valid_on")]
    units = u.select(F.lit("admin1").alias("_sheet"), *names, F.when(c("odd"), text("x_coord")).otherwise("0").alias("center_lon"), F.when(c("odd"), text("y_coord")).otherwise("0").alias("center_lat"), *lineage)
    units = units.withColumn("center_lon", F.when(c("center_lon") != "0", c("center_lon"))).withColumn("center_lat", F.when(c("center_lat") != "0", c("center_lat")))
    points = u.where("not odd").select(F.lit("adminpoints").alias("_sheet"), *names, text("x_coord").alias("x_coord"), text("y_coord").alias("y_coord"), *lineage)
    frame, _ = pipelines.clean_boundaries(R.union_by_name(units, points), processed_at=PROCESSED)
    return frame.select("adm_0_name", "adm_1_name", "iso3", "p_code", "valid_on", "x_coord", "y_coord")


# ---- acquisition and versions -------------------------------------------------------------------------------
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ITEM = ("guid", "title", "description", "link", "pubDate", "source", "source_url")


@query("select " + ", ".join(f"coalesce(regexp_replace({n}, '^{_WS}+|{_WS}+$', '', 'g'), '') as {n}" for n in _ITEM) + ", 'VN' as feed, true as has_payload from news_rss")
def rss_roundtrip(spark, sf):
    path = fresh_dir(spark, "rss")
    R.write_rss(table(spark, sf, "news_rss"), path)
    got = R.read_rss(spark, path, feed=F.lit("VN"))
    return got.select(*_ITEM, "feed", F.startswith("raw_payload", F.lit("<item>")).alias("has_payload"))


@query("select REPORTING_UNIT, ISO3, YEAR, DATE_TYPE, DATE_NUM, START_DATE, CASES, 'now' as _fetched_at from who_gho")
def odata_roundtrip(spark, sf):
    path = fresh_dir(spark, "odata")
    w = table(spark, sf, "who_gho").select("REPORTING_UNIT", "ISO3", "YEAR", "DATE_TYPE", "DATE_NUM", "START_DATE", "CASES")
    R.write_wrapped(w.select(F.to_json(F.struct("*")).alias("value")), path, '{"value":[', ",", "]}")
    return R.read_odata(spark, path, fetched_at="now").select(*w.columns, "_fetched_at")


@query("select p_code as code, adm_1_name as name, '{\"type\":\"Point\",\"coordinates\":[1.5,2.5]}' as geometry, coalesce(p_code, '') as flat_code from administrative_boundaries")
def geojson_roundtrip(spark, sf):
    path = fresh_dir(spark, "geojson")
    b = table(spark, sf, "administrative_boundaries").select(c("p_code").alias("Admin Code"), "adm_1_name")
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.5), F.lit(2.5)).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("*").alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"})
    R.write_wrapped(b.select(feature.alias("value")), path, '{"type":"FeatureCollection","features":[', ",", "]}")
    named = R.read_geojson(spark, path, {"code": "Admin Code", "name": "adm_1_name"}).select("code", "name", F.regexp_replace("geometry", r'\{"coordinates":(.*),"type":"Point"\}', r'{"type":"Point","coordinates":$1}').alias("geometry"))
    flat = R.read_geojson_flat(spark, path).select(c("admin_code").alias("flat_code"))
    return named.join(flat, named.code == flat.flat_code)


@query(
    """select 'appended twice' as state, s_suppkey, 2 as copies from supplier union all select 'first version', s_suppkey, 1 from supplier union all select 'overwritten', s_suppkey, 1 from supplier where s_acctbal > 0
union all select 'renamed', s_suppkey, 1 from supplier where s_acctbal > 0"""
)
def store_versions(spark, sf):
    """One table appended to, overwritten and renamed, read as of each of its versions."""
    s = table(spark, sf, "supplier")
    store = TableStore(spark, fresh_dir(spark, "versions"))
    first, twice = store.append(s), store.append(s)
    over = store.overwrite(s.where("s_acctbal > 0").withColumn("note", F.lit("new")), replace_schema=True)
    last = store.rename_column("s_suppkey", "supplier")
    states = (("first version", first, "s_suppkey"), ("appended twice", twice, "s_suppkey"), ("overwritten", over, "s_suppkey"), ("renamed", last, "supplier"))
    parts = [store.read(version=v).groupBy(c(k).alias("s_suppkey")).agg(F.count("*").cast("int").alias("copies")).select(F.lit(n).alias("state"), "s_suppkey", "copies") for n, v, k in states]
    return R.union_by_name(*parts)


@query("select event_type, count(*) as n_rows from events where event_type in (select distinct event_type from events where event_type is not null and event_type <> 'error') group by 1")
def store_partitions(spark, sf):
    """Every partition of ``events`` written, one emptied by deletion and read partition by partition."""
    e = table(spark, sf, "events").where("event_type is not null").select("event_id", "event_type")
    store = TableStore(spark, fresh_dir(spark, "partitions"), "kind")
    for (k,) in e.select("event_type").distinct().collect():  # bounded by the event types
        store.replace_partition(e.where(c("event_type") == k), k)
    store.delete_partition("error")
    return store.read(partitions=store.partition_values()).groupBy("event_type").agg(F.count("*").alias("n_rows"))


@query("select REPORTING_UNIT, ISO3, DATE_NUM, CASES, 'gho' as _source, '2026-10-01' as day, true as has_file, 'skipped' as rerun from who_gho")
def ingest_versioned(spark, sf):
    """A landing folder of JSON lines ingested with lineage as one version of a table; the second run finds the version there."""
    root = fresh_dir(spark, "ingest")
    table(spark, sf, "who_gho").select("REPORTING_UNIT", "ISO3", "DATE_NUM", "CASES").write.json(f"{root}/landing/gho")
    source = I.Source("gho", ("gho",), "day", lambda: ("2026-10-01", "f1"), lambda s, v: {"gho": R.read_jsonl(s, f"{root}/landing/gho")})
    I.ingest(spark, source, f"{root}/tables", U.RunRecord.start("gho"))
    again = U.RunRecord.start("gho")
    I.ingest(spark, source, f"{root}/tables", again)
    got = I.stores_of(spark, source, f"{root}/tables")["gho"].read()
    return got.select("REPORTING_UNIT", "ISO3", "DATE_NUM", "CASES", "_source", "day", F.startswith("_source_file", F.lit("gho/")).alias("has_file"), F.lit(again.status).alias("rerun"))


@query("select 'events' as source, 'success' as status, (select count(*) from events) as record_count union all select 'nothing', 'failed', null union all select 'region', 'success', (select count(*) from region)")
def run_records(spark, sf):
    """Three jobs, one of which fails, and a disabled one; their records as a table."""
    with tempfile.TemporaryDirectory() as folder:  # records are small driver files
        jobs = {n: lambda record, n=n: table(spark, sf, n).count() for n in ("events", "region")} | {"nothing": lambda record: C.require_rows(table(spark, sf, "region").limit(0), "nothing")}
        U.run_batch({**jobs, "off": lambda record: 1}, folder, enabled=list(jobs))
        found = U.read_runs(spark, folder).select("source", "status", c("record_count").cast("bigint").alias("record_count")).collect()  # one row per source
    return spark.createDataFrame(found, "source string, status string, record_count bigint")
