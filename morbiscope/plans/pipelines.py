"""The surveillance pipelines as thin compositions of operators: frame in, (frame, checks) out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morbiscope.functions import expressions as X
from morbiscope.operators import mapping as M
from morbiscope.operators import periods as P
from morbiscope.operators.checks import Check, all_of, conflicting_keys, dependency_breaks, duplicate_keys, parsed, require_columns, require_schema, rules
from morbiscope.operators.latest import best_per_key, first_per_key, with_parents
from morbiscope.runtime import written

# Contracts of the typed tables.
HISTORY = {
    "adm_0_name": "string", "adm_1_name": "string", "iso3": "string", "p_code": "string", "start_date": "date", "year": "int", "dengue_total": "bigint",
    "s_res": "string", "t_res": "string", "_source": "string", "_source_file": "string", "_bronze_ingested_at": "timestamp", "_silver_ingested_at": "timestamp",
}
BOUNDARIES = {
    "adm_0_name": "string", "adm_1_name": "string", "iso3": "string", "p_code": "string", "valid_on": "date", "x_coord": "double", "y_coord": "double",
    "_source": "string", "_source_file": "string", "_bronze_ingested_at": "timestamp", "_silver_ingested_at": "timestamp",
}
NEWS = {
    "guid": "string", "title": "string", "description": "string", "iso3": "string", "feed_gl": "string", "feed_query": "string", "link": "string", "pubDate": "timestamp",
    "source_url": "string", "_source_file": "string", "_source": "string", "_bronze_ingested_at": "timestamp", "_silver_ingested_at": "timestamp",
}
GRAIN = ["adm_0_name", "adm_1_name", "iso3", "p_code", "start_date", "year", "s_res", "t_res"]
PRESENT = ["adm_0_name", "year", "dengue_total", "_source_file", "_bronze_ingested_at"]
ISO3 = "[A-Z]{3}"

Result = tuple[DataFrame, list[Check]]


def _stamp(processed_at: datetime) -> Column:
    return F.lit(processed_at).cast("timestamp").alias("_silver_ingested_at")


def _typed(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in contract.items()])


DEFINITIONS = ["total", "suspected and confirmed", "confirmed"]
COUNTS = ["adm_0_name", "adm_1_name", "ISO_A0", "RNE_iso_code", "calendar_start_date", "Year", "dengue_total", "S_res", "T_res", "case_definition_standardised", "_source", "_source_file", "_ingested_at"]


def typed_counts(raw: DataFrame, *, as_of: date, source: str = "opendengue") -> DataFrame:
    """All-string case counts of the two upper levels as typed columns, with ``valid`` and ``rank`` of the definition."""
    require_columns(raw, COUNTS, "counts")
    c = F.col
    level = F.upper(X.clean_text(c("S_res")))
    rows = parsed(
        raw.where(level.isin("ADMIN0", "ADMIN1")),
        X.hyphen_title(c("adm_0_name")).alias("adm_0_name"),
        X.compact_title(c("adm_1_name")).alias("adm_1_name"),
        F.upper(X.clean_text(c("ISO_A0"))).alias("iso3"),
        X.clean_text(c("RNE_iso_code")).alias("p_code"),
        X.day(c("calendar_start_date")).alias("start_date"),
        X.digits_as(c("Year"), "int", r"\d{4}").alias("year"),
        X.digits_as(c("dengue_total")).alias("dengue_total"),
        F.initcap(level).alias("s_res"),
        X.relabel(F.lower(X.clean_text(c("T_res"))), {"week": "epiweek"}).alias("t_res"),
        X.clean_text(c("_source")).alias("_source"),
        X.clean_text(c("_source_file")).alias("_source_file"),
        X.instant(c("_ingested_at")).alias("_bronze_ingested_at"),
        X.preference(F.lower(X.clean_text(c("case_definition_standardised"))), DEFINITIONS).alias("rank"),
    )
    named = (c("s_res") == "Admin0") | c("adm_1_name").isNotNull()
    valid = rules(c("start_date") <= F.lit(as_of), named, required=PRESENT, patterns={"iso3": ISO3}, allowed={"t_res": ["epiweek", "month", "year"], "_source": [source]})
    return rows.withColumn("valid", valid)


def best_counts(rows: DataFrame, processed_at: datetime) -> Result:
    """One case series per grain of ``typed_counts``; the order leaves no tie in what comes out."""
    c = F.col
    order = [c("_bronze_ingested_at").desc(), c("_source_file").asc(), c("dengue_total").asc()]
    best, checks = best_per_key(rows.where("valid"), GRAIN, c("rank"), ["dengue_total"], order, "counts")
    return _typed(best.withColumn("_silver_ingested_at", _stamp(processed_at)), HISTORY), checks


def clean_counts(raw: DataFrame, *, as_of: date, processed_at: datetime, source: str = "opendengue") -> Result:
    """All-string case counts as history rows: typed, valid, one case series per grain."""
    return best_counts(typed_counts(raw, as_of=as_of, source=source), processed_at)


def count_candidates(raw: DataFrame, *, as_of: date, source: str = "opendengue") -> DataFrame:
    """Per grain the best rank of its case definitions, and how many valid rows competed for it."""
    valid = typed_counts(raw, as_of=as_of, source=source).where("valid")
    return valid.groupBy(*GRAIN).agg(F.min("rank").alias("best_rank"), F.count("*").alias("candidates"))


SNAPSHOT_KEY = ["iso3", "year", "t_res", "number"]
SNAPSHOT = ["COUNTRY", "ISO3", "YEAR", "DATE_TYPE", "DATE_NUM", "START_DATE", "CASES", "_source", "_source_file", "_ingested_at"]


def typed_snapshot(raw: DataFrame, *, as_of: date, source: str = "who_gho") -> DataFrame:
    """All-string national counts as typed columns, with ``valid``, ``derived`` (a month without a date got one) and ``future``."""
    require_columns(raw, SNAPSHOT, "snapshot")
    c = F.col
    kind, number, year = F.lower(X.clean_text(c("DATE_TYPE"))), X.digits_as(c("DATE_NUM"), "int", r"\d{1,2}"), X.digits_as(c("YEAR"), "int", r"\d{4}")
    given = X.clean_text(c("START_DATE"))
    rows = parsed(
        raw,
        X.hyphen_title(c("COUNTRY")).alias("adm_0_name"),
        F.lit(None).cast("string").alias("adm_1_name"),
        F.upper(X.clean_text(c("ISO3"))).alias("iso3"),
        F.lit(None).cast("string").alias("p_code"),
        X.day(given).alias("given_date"),
        given.isNull().alias("undated"),
        year.alias("year"),
        X.digits_as(c("CASES")).alias("dengue_total"),
        F.lit("Admin0").alias("s_res"),
        kind.alias("t_res"),
        X.clean_text(c("_source")).alias("_source"),
        X.clean_text(c("_source_file")).alias("_source_file"),
        X.instant(c("_ingested_at")).alias("_bronze_ingested_at"),
        number.alias("number"),
    )
    derived = c("undated") & (c("t_res") == "month")
    rows = rows.withColumn("start_date", F.when(derived, X.month_start(c("year"), c("number"))).otherwise(c("given_date")))
    rows = rows.withColumn("derived", F.coalesce(derived & c("start_date").isNotNull(), F.lit(False)))
    rows = rows.withColumn("future", F.coalesce(c("start_date") > F.lit(as_of), F.lit(False)))
    in_year = F.when(c("t_res") == "month", c("number") <= 12).when(c("t_res").isin("isoweek", "epiweek"), c("number") <= 53)
    valid = rules(~c("future"), in_year, c("number") >= 1, required=[*PRESENT, "start_date"], patterns={"iso3": ISO3}, allowed={"_source": [source]})
    return rows.withColumn("valid", valid)


def best_snapshot(rows: DataFrame, processed_at: datetime) -> Result:
    """One row per key of ``typed_snapshot``; the order leaves no tie in what comes out."""
    c, valid = F.col, rows.where("valid")
    checks = [Check("snapshot: conflicting counts or dates within one key", conflicting_keys(valid, SNAPSHOT_KEY, ["dengue_total", "start_date"]))]
    order = [c("_bronze_ingested_at").desc(), c("_source_file").asc(), c("dengue_total").asc(), c("start_date").asc(), c("adm_0_name").asc()]
    best = first_per_key(valid, SNAPSHOT_KEY, order)
    return _typed(best.withColumn("_silver_ingested_at", _stamp(processed_at)), HISTORY), checks


def clean_snapshot(raw: DataFrame, *, as_of: date, processed_at: datetime, source: str = "who_gho") -> Result:
    """All-string national counts of one snapshot as history rows; missing month dates are derived."""
    return best_snapshot(typed_snapshot(raw, as_of=as_of, source=source), processed_at)


def snapshot_candidates(raw: DataFrame, *, as_of: date, source: str = "who_gho") -> DataFrame:
    """Per key the valid rows of a snapshot, their dates and their counts."""
    return typed_snapshot(raw, as_of=as_of, source=source).where("valid").groupBy(*SNAPSHOT_KEY).agg(
        F.count("*").alias("candidates"), F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start"), F.sum("dengue_total").alias("cases")
    )


def accounting(rows: DataFrame, grain: Sequence[str], **others: Column) -> DataFrame:
    """One row: ``typed_rows``, ``valid_rows``, ``invalid_rows``, ``output_rows`` (grains of valid rows), ``deduplicated_rows``.

    ``others`` adds the number of rows for which a condition holds. One pass, combined on the map side.
    """
    grains = F.struct(*[F.col(g) for g in grain])
    counts = rows.agg(
        F.count("*").alias("typed_rows"),
        F.count_if("valid").alias("valid_rows"),
        F.count_distinct(F.when(F.col("valid"), grains)).alias("output_rows"),
        *[F.count_if(x).alias(name) for name, x in others.items()],
    )
    return counts.select(
        "typed_rows", "valid_rows", (F.col("typed_rows") - F.col("valid_rows")).alias("invalid_rows"), "output_rows", (F.col("valid_rows") - F.col("output_rows")).alias("deduplicated_rows"), *others
    )


RESOLUTIONS = ["isoweek", "epiweek", "month", "year"]


def history_places(rows: DataFrame) -> DataFrame:
    """Eligible rows with their period, and the location that their periods must not overlap in.

    Countries and units are different locations, so a unit's periods never block its country's.
    """
    c = F.col
    local = c("s_res") == "Admin1"
    return (
        rows.withColumn("adm_1_name", X.compact_title(c("adm_1_name")))
        .withColumn("period_end", X.period_end(c("start_date"), c("t_res")))
        .withColumns({"place_name": F.when(local, c("adm_1_name")), "place_code": F.when(local, c("p_code"))})
    )


def build_history(rows: DataFrame, primary: str = "opendengue", secondary: str = "who_gho") -> Result:
    """Non-overlapping periods per location: the primary source's finest, filled from the secondary where it has none."""
    require_schema(rows, HISTORY, "history")
    c = F.col
    timed = written(history_places(rows.where(all_of((c("s_res") == "Admin0") | ((c("s_res") == "Admin1") & (c("_source") == primary))))), "history-periods")
    aligned = F.when(c("t_res") == "month", F.trunc("start_date", "month")).when(c("t_res") == "year", F.trunc("start_date", "year")).otherwise(c("start_date"))
    usable = rules((c("s_res") == "Admin0") | c("adm_1_name").isNotNull(), aligned == c("start_date"), required=["iso3", "period_end"], allowed={"t_res": RESOLUTIONS})
    own, other = c("_source") == primary, c("_source") == secondary
    weekly = c("t_res").isin("isoweek", "epiweek")
    ranking = [
        [own & weekly, own & (c("t_res") == "month"), own & (c("t_res") == "year")],
        [other & (c("t_res") == r) for r in RESOLUTIONS],
    ]
    taken, checks = P.select_periods(timed, ["s_res", "iso3", "place_name", "place_code"], ranking, "history")
    return taken.select(*HISTORY), [Check("history: invalid period", timed.where(~usable)), *checks]


def map_history(history: DataFrame, boundaries: DataFrame) -> Result:
    """History with the codes of the boundaries: by compact name (VNM provinces excepted), else by renumbered code."""
    require_schema(boundaries, BOUNDARIES, "boundaries")
    c = F.col
    lookup = boundaries.select("iso3", X.compact_key(c("adm_1_name")).alias("name_key"), c("p_code").alias("cod"))
    incomplete = Check("boundaries: null location or code", lookup.where("iso3 is null or cod is null"))
    source = history.withColumn("adm_1_name", X.compact_title(c("adm_1_name")))
    guess = F.when((c("s_res") == "Admin1") & (c("_source") == "opendengue") & c("iso3").isin("THA", "KHM"), X.padded_code(c("p_code"), ["TH", "KH"]))
    mapped, checks = M.map_codes(
        source, lookup, scope="iso3", name_key=X.compact_key(c("adm_1_name")), lookup_key="name_key", code="cod",
        code_guess=guess, name_applies=(c("s_res") == "Admin0") | ((c("s_res") == "Admin1") & (c("iso3") != "VNM")), label="codes",
    )
    return mapped.select(*[c("mapped_code").alias("p_code") if n == "p_code" else c(n) for n in HISTORY], "map_method"), [incomplete, *checks]


def check_countries(rows: DataFrame, boundaries: DataFrame, label: str) -> Result:
    """Counts of rows whose country the boundaries know, and checks that names agree with codes."""
    countries = boundaries.where("adm_1_name is null").select("iso3", X.compact_key(F.col("adm_0_name")).alias("country_key"))
    return M.name_check(rows, countries, "iso3", X.compact_key(F.col("adm_0_name")), "country_key", label)


def clean_boundaries(raw: DataFrame, *, processed_at: datetime, source: str = "hdx_cod_ab") -> Result:
    """Units with a point (their own, else the centre) and one derived row per country."""
    c = F.col
    units = parsed(
        raw.where("_sheet = 'admin1'"),
        F.upper(X.clean_text(c("iso3"))).alias("iso3"),
        X.hyphen_title(c("adm0_name")).alias("adm_0_name"),
        X.compact_title(c("adm1_name")).alias("adm_1_name"),
        X.clean_text(c("adm0_pcode")).alias("country_code"),
        X.clean_text(c("adm1_pcode")).alias("p_code"),
        X.day(F.substring(X.clean_text(c("valid_on")), 1, 10)).alias("valid_on"),
        X.real(c("center_lon")).alias("cx"),
        X.real(c("center_lat")).alias("cy"),
        X.clean_text(c("_source")).alias("_source"),
        X.clean_text(c("_source_file")).alias("_source_file"),
        X.instant(c("_ingested_at")).alias("_bronze_ingested_at"),
    )
    points = raw.where("_sheet = 'adminpoints' and admin_level = '1'").select(
        F.upper(X.clean_text(c("iso3"))).alias("iso3"), X.clean_text(c("adm1_pcode")).alias("p_code"), X.real(c("x_coord")).alias("px"), X.real(c("y_coord")).alias("py")
    )
    present = ["adm_0_name", "adm_1_name", "country_code", "p_code", "valid_on", "_source_file", "_bronze_ingested_at"]
    complete = rules(required=present, patterns={"iso3": ISO3}, allowed={"_source": [source]})
    placed = M.enrich(units, points, ["iso3", "p_code"], {"x_coord": ("px", "cx"), "y_coord": ("py", "cy")})
    on_earth = all_of(~F.isnan("x_coord"), ~F.isnan("y_coord"), c("x_coord").between(-180, 180), c("y_coord").between(-90, 90))
    checks = [
        Check("boundaries: incomplete unit", units.where(~complete)),
        Check("boundaries: unit listed twice", duplicate_keys(units, "iso3", "p_code")),
        Check("boundaries: point without key", points.where("iso3 is null or p_code is null")),
        Check("boundaries: point listed twice", duplicate_keys(points, "iso3", "p_code")),
        Check("boundaries: point without unit", M.orphans(points, units, ["iso3", "p_code"])),
        Check("boundaries: country attributes differ", dependency_breaks(units, "iso3", ["adm_0_name", "country_code", "valid_on"])),
        Check("boundaries: coordinates missing or invalid", placed.where(~on_earth)),
    ]
    nothing = F.lit(None)
    parents = {"adm_1_name": nothing, "p_code": c("country_code"), "x_coord": nothing, "y_coord": nothing}
    return _typed(with_parents(placed, "iso3", [c("p_code").asc()], parents).withColumn("_silver_ingested_at", _stamp(processed_at)), BOUNDARIES), checks


NEWS_KEY = ["guid", "iso3", "feed_gl", "feed_query"]
FEEDS = ["guid", "title", "description", "feed_country", "feed_gl", "feed_query", "link", "pubDate", "source_url", "_source_file", "_source", "_ingested_at", "_fetched_at"]


def typed_news(raw: DataFrame, *, source: str = "news_rss") -> DataFrame:
    """Articles with plain text and instants, and ``valid``."""
    require_columns(raw, FEEDS, "news")
    c = F.col
    rows = parsed(
        raw,
        X.clean_text(c("guid")).alias("guid"),
        X.plain_title(c("title")).alias("title"),
        X.html_text(c("description")).alias("description"),
        F.upper(X.clean_text(c("feed_country"))).alias("iso3"),
        F.upper(X.clean_text(c("feed_gl"))).alias("feed_gl"),
        X.clean_text(c("feed_query")).alias("feed_query"),
        X.clean_text(c("link")).alias("link"),
        X.rfc822(c("pubDate")).alias("pubDate"),
        X.web_address(c("source_url")).alias("source_url"),
        X.clean_text(c("_source_file")).alias("_source_file"),
        X.clean_text(c("_source")).alias("_source"),
        X.instant(c("_ingested_at")).alias("_bronze_ingested_at"),
        X.instant(c("_fetched_at")).alias("fetched"),
    )
    present = ["guid", "title", "feed_query", "pubDate", "_source_file", "_bronze_ingested_at", "fetched"]
    return rows.withColumn("valid", rules(required=present, patterns={"iso3": ISO3, "feed_gl": "[A-Z]{2}", "link": r"https?://\S+"}, allowed={"_source": [source]}))


def newest_news(rows: DataFrame, processed_at: datetime) -> Result:
    """The newest fetch per article and feed of ``typed_news``; the order leaves no tie in what comes out."""
    c = F.col
    order = [c("fetched").desc(), c("_bronze_ingested_at").desc(), *[c(n).asc() for n in ("_source_file", "link", "title", "pubDate", "description", "source_url")]]
    kept = first_per_key(rows.where("valid"), NEWS_KEY, order)
    return _typed(kept.withColumn("_silver_ingested_at", _stamp(processed_at)), NEWS), []


def clean_news(raw: DataFrame, *, processed_at: datetime, source: str = "news_rss") -> Result:
    """Articles with plain text and instants, the newest fetch per article and feed."""
    return newest_news(typed_news(raw, source=source), processed_at)
