"""Golden cases of the pipelines and single operators."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from morbiscope.functions import expressions as X
from morbiscope.functions import normal as N
from morbiscope.operators import checks as C
from morbiscope.operators import latest as L
from morbiscope.plans import pipelines as W

NOW, TODAY = datetime(2026, 10, 2), date(2026, 10, 2)
COUNT = {
    "adm_0_name": " VIET NAM ", "adm_1_name": "NA", "ISO_A0": "vnm", "RNE_iso_code": "VNM", "calendar_start_date": "2025-01-01", "Year": "2025", "dengue_total": "120", "S_res": "Admin0", "T_res": "Year",
    "case_definition_standardised": "Total", "_source": "opendengue", "_source_file": "opendengue/V1.3/spatial.csv", "_ingested_at": "2026-10-01T00:00:00+00:00", "release": "V1.3",
}


def frame(spark, base, *changes):
    return spark.createDataFrame([{**base, **ch} for ch in changes], ", ".join(f"`{k}` string" for k in base))


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first()[0]


def test_counts_pipeline(spark):
    raw = frame(spark, COUNT, {}, {}, {"case_definition_standardised": "Confirmed", "dengue_total": "100"}, {"S_res": "Admin1", "adm_1_name": "HAI phong", "T_res": "Month", "dengue_total": "0"},
                {"S_res": "Admin2"}, {"dengue_total": "-1"}, {"ISO_A0": None}, {"calendar_start_date": "not-a-date"}, {"dengue_total": "99999999999999999999"})
    out, checks = W.clean_counts(raw, as_of=TODAY, processed_at=NOW)
    C.enforce(*checks)
    got = {(r.s_res, r.adm_0_name, r.adm_1_name, r.iso3, r.t_res, r.dengue_total) for r in out.collect()}
    assert got == {("Admin0", "Viet Nam", None, "VNM", "year", 120), ("Admin1", "Viet Nam", "HaiPhong", "VNM", "month", 0)}
    C.require_schema(out, W.HISTORY, "history")


def test_counts_conflict(spark):
    _, checks = W.clean_counts(frame(spark, COUNT, {}, {"dengue_total": "121"}), as_of=TODAY, processed_at=NOW)
    with pytest.raises(C.ContractError, match="conflicting"):
        C.enforce(*checks)
    with pytest.raises(C.ContractError, match="missing"):
        W.clean_counts(frame(spark, COUNT, {}).drop("Year"), as_of=TODAY, processed_at=NOW)


def test_snapshot_pipeline(spark):
    base = {"COUNTRY": "LAO PDR", "ISO3": "lao", "YEAR": "2024", "DATE_TYPE": "Month", "DATE_NUM": "3", "START_DATE": None, "CASES": "7", "_source": "who_gho", "_source_file": "f", "_ingested_at": "2026-10-01T00:00:00Z"}
    raw = frame(spark, base, {}, {"DATE_TYPE": "isoweek", "DATE_NUM": "5"}, {"YEAR": "2029"}, {"CASES": "-1"}, {"DATE_NUM": "13"}, {"DATE_TYPE": "epiweek", "START_DATE": "2024-01-28"})
    out, checks = W.clean_snapshot(raw, as_of=TODAY, processed_at=NOW)
    C.enforce(*checks)
    assert {(r.t_res, r.start_date) for r in out.collect()} == {("month", date(2024, 3, 1)), ("epiweek", date(2024, 1, 28))}


def hist(spark, *rows):
    cols = ["iso3", "adm_1_name", "p_code", "start_date", "t_res", "s_res", "_source"]
    full = [dict(zip(cols, r)) for r in rows]
    data = [tuple({"adm_0_name": "X", "year": 2020, "dengue_total": 1, "_source_file": "f", "_bronze_ingested_at": NOW, "_silver_ingested_at": NOW, **r}[c] for c in W.HISTORY) for r in full]
    return spark.createDataFrame(data, ", ".join(f"{k} {t}" for k, t in W.HISTORY.items()))


def nat(d, res, src="opendengue", iso="THA"):
    return (iso, None, None, d, res, "Admin0", src)


def test_history_blocking_is_asymmetric(spark):
    d = date
    rows = hist(
        spark,
        nat(d(2020, 1, 6), "epiweek"), nat(d(2020, 1, 1), "month"),  # the month loses to its week,
        nat(d(2020, 1, 1), "year"),  # and so does the year
        nat(d(2021, 1, 4), "epiweek"), nat(d(2022, 3, 1), "month"),
        nat(d(2020, 12, 1), "month", "who_gho"),  # inside the lost primary year: still blocked
        nat(d(2021, 1, 11), "isoweek", "who_gho"), nat(d(2021, 1, 10), "epiweek", "who_gho"),  # touches the primary week; iso beats epi
        nat(d(2022, 3, 7), "isoweek", "who_gho"), nat(d(2022, 4, 1), "month", "who_gho"),
        ("THA", "Chiang Mai", "TH-1", d(2020, 1, 6), "epiweek", "Admin1", "opendengue"), ("THA", "ChiangMai", "TH-1", d(2020, 1, 1), "month", "Admin1", "opendengue"),
    )
    out, checks = W.build_history(rows)
    C.enforce(*checks)
    got = {(r._source, r.s_res, r.t_res, r.start_date) for r in out.collect()}
    assert got == {
        ("opendengue", "Admin0", "epiweek", d(2020, 1, 6)), ("opendengue", "Admin0", "epiweek", d(2021, 1, 4)), ("opendengue", "Admin0", "month", d(2022, 3, 1)),
        ("who_gho", "Admin0", "isoweek", d(2021, 1, 11)), ("who_gho", "Admin0", "month", d(2022, 4, 1)), ("opendengue", "Admin1", "epiweek", d(2020, 1, 6)),
    }


def test_history_overlapping_weeks_and_bad_periods_raise(spark):
    weeks = hist(spark, nat(date(2020, 1, 6), "epiweek"), nat(date(2020, 1, 9), "epiweek"), nat(date(2020, 5, 1), "month", "who_gho"))
    with pytest.raises(C.ContractError, match="overlapping"):
        C.enforce(*W.build_history(weeks)[1])
    with pytest.raises(C.ContractError, match="invalid period"):
        C.enforce(*W.build_history(hist(spark, nat(date(2020, 1, 6), "month")))[1])


def bounds(spark, *rows):
    data = [(a0, a1, iso, code, TODAY, 1.0, 1.0, "s", "f", NOW, NOW) for a0, a1, iso, code in rows]
    return spark.createDataFrame(data, ", ".join(f"{k} {t}" for k, t in W.BOUNDARIES.items()))


def test_code_mapping(spark):
    b = bounds(spark, ("Thailand", None, "THA", "TH"), ("Thailand", "Chiang Mai", "THA", "TH50"), ("Thailand", "Nan", "THA", "TH55"), ("Viet Nam", "Hue", "VNM", "VN46"), ("Malaysia", "Melaka", "MYS", "MY04"))
    d = date(2020, 1, 6)
    h = hist(spark, nat(d, "epiweek"), ("THA", "CHIANG mai", "x", d, "epiweek", "Admin1", "opendengue"), ("THA", "Misspelt", "TH-55", d, "epiweek", "Admin1", "opendengue"),
             ("VNM", "Hue", "VN-46", d, "epiweek", "Admin1", "opendengue"), ("MYS", "Unknown", "MY-04", d, "epiweek", "Admin1", "opendengue"))
    out, checks = W.map_history(h, b)
    C.enforce(*checks)
    assert {(r.iso3, r.adm_1_name, r.p_code, r.map_method) for r in out.collect()} == {
        ("THA", None, "TH", "compact_name"), ("THA", "ChiangMai", "TH50", "compact_name"), ("THA", "Misspelt", "TH55", "source_code"), ("VNM", "Hue", None, "unmatched"), ("MYS", "Unknown", None, "unmatched"),
    }
    clash = hist(spark, ("THA", "Chiang Mai", "TH-55", d, "epiweek", "Admin1", "opendengue"))
    with pytest.raises(C.ContractError, match="disagree"):
        C.enforce(*W.map_history(clash, b)[1])
    with pytest.raises(C.ContractError, match="ambiguous"):
        C.enforce(*W.map_history(h, b.unionAll(b))[1])


def test_country_check(spark):
    b = bounds(spark, ("Thailand", None, "THA", "TH"))
    h = hist(spark, nat(date(2020, 1, 6), "epiweek")).withColumn("adm_0_name", F.lit("THAILAND"))
    counts, checks = W.check_countries(h.unionAll(h.withColumn("iso3", F.lit("QQQ"))), b, "od")
    C.enforce(*checks)
    assert tuple(counts.first()) == (1, 1)
    with pytest.raises(C.ContractError, match="name conflicts"):
        C.enforce(*W.check_countries(h.withColumn("adm_0_name", F.lit("Laos")), b, "od")[1])


def test_boundaries_pipeline(spark):
    base = {"iso3": "tha", "_sheet": "admin1", "admin_level": "1", "adm0_name": "THAILAND", "adm0_pcode": "TH", "adm1_name": "CHIANG MAI", "adm1_pcode": "TH50", "valid_on": "2025-09-25 00:00:00", "center_lat": "18", "center_lon": "98",
            "x_coord": None, "y_coord": None, "_source": "hdx_cod_ab", "_source_file": "f", "_ingested_at": "2026-10-01T00:00:00Z"}
    point = {"_sheet": "adminpoints", "x_coord": "99.5", "y_coord": "19.5"}
    raw = frame(spark, base, {}, {"adm1_name": "Nan", "adm1_pcode": "TH55"}, point, {**point, "admin_level": "2"})
    out, checks = W.clean_boundaries(raw, processed_at=NOW)
    C.enforce(*checks)
    assert {(r.adm_1_name, r.p_code, r.x_coord, r.valid_on) for r in out.collect()} == {(None, "TH", None, date(2025, 9, 25)), ("ChiangMai", "TH50", 99.5, date(2025, 9, 25)), ("Nan", "TH55", 98.0, date(2025, 9, 25))}
    for bad, message in (([{}, {}, point], "unit listed twice"), ([{}, point, point], "point listed twice"), ([{}, {**point, "adm1_pcode": "XX"}], "point without unit"), ([{"center_lat": "NaN"}], "coordinates"), ([{}, {"adm1_pcode": "Q", "adm0_name": "Siam"}], "attributes differ")):
        with pytest.raises(C.ContractError, match=message):
            C.enforce(*W.clean_boundaries(frame(spark, base, *bad), processed_at=NOW)[1])


def test_news_pipeline(spark):
    base = {"guid": "g", "title": "A &amp;  B", "description": "<p>x<!-- no --><br>y&nbsp;&eacute;</p>", "feed_country": "vnm", "feed_gl": "vn", "feed_query": "q", "link": "https://a/b", "pubDate": "Wed, 30 Sep 2026 08:00:00 +0700", "source_url": "bad", "_source": "news_rss", "_source_file": "f",
            "_ingested_at": "2026-10-01T00:00:00Z", "_fetched_at": "2026-10-01T00:00:00Z"}
    raw = frame(spark, base, {}, {"_fetched_at": "2026-10-01T09:00:00+07:00", "title": "newer"}, {"feed_country": "THA"}, {"guid": None}, {"pubDate": "soon"}, {"title": " "})
    out, _ = W.clean_news(raw, processed_at=NOW)
    got = {r.iso3: r for r in out.collect()}
    assert set(got) == {"VNM", "THA"} and got["VNM"].title == "newer" and got["THA"].title == "A & B"
    assert got["THA"].description == "x y é" and got["THA"].source_url is None


@pytest.mark.parametrize(
    "text,want",
    [("Wed, 30 Sep 2026 08:00:00 +0700", "2026-09-30 01:00:00"), ("30 Sep 2026 08:00:00 GMT", "2026-09-30 08:00:00"), ("Wed, 30 Sep 2026 08:00 EST", "2026-09-30 13:00:00"), ("Wed, 30 Sep 2026 08:00:00 -0000", None), ("Wed, 30 Sep 2026 08:00:00", None), ("x", None), (None, None)],
)
def test_rfc822(spark, text, want):
    got = one(spark, F.date_format(X.rfc822(F.col("t")), "yyyy-MM-dd HH:mm:ss"), t=text)
    assert got == want


@pytest.mark.parametrize(
    "text,want",
    [("5 < 7 days and 9 > 8 cases", "5 < 7 days and 9 > 8 cases"), ('<a title="x>y">t</a>', "t"), ("<p>a</p><!-- <b>no</b> -->b<br/>c", "a b c"), ("&lt;b&gt; &amp; &nbsp; x", "<b> & x"), ("<script>a<b>c</script>d", "a<b>c d"),
     ("<b>bold</b>er", "bold er"), ("<font color=red face='a b'>x</font>", "x"), ("a<", "a <"), (" <br> ", None), ("", None), (None, None), ("x" * 50_000 + "<i>y</i>", "x" * 50_000 + " y")],
)
def test_text_of_html(spark, text, want):
    assert one(spark, X.html_text(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("Wed, 30 Sep 2026 08:00:00 +0700 (ICT)", "2026-09-30 01:00:00"), ("30 Sep 26 08:00 GMT", "2026-09-30 08:00:00"), ("30 Sep 69 08:00:00 +0000", "1969-09-30 08:00:00"), ("Wednesday, 30  Sep 2026 08:00:00 +0000", "2026-09-30 08:00:00"), ("Wed 30 Sep 2026 08:00:00 +0000", "2026-09-30 08:00:00"), ("30 Sep 2026 08:00:00", None), ("(x)", None)])
def test_rfc822_forms(spark, text, want):
    assert one(spark, F.date_format(X.rfc822(F.col("t")), "yyyy-MM-dd HH:mm:ss"), t=text) == want


@pytest.mark.parametrize(
    "text,want",
    [("5 < 7 days and 9 > 8 cases", "5 < 7 days and 9 > 8 cases"), ('<a title="x>y">t</a>', "t"), ("<p>a</p><!-- <b>no</b> -->b<br/>c", "a b c"), ("&lt;b&gt; &amp; &nbsp; x", "<b> & x"), ("<script>a<b>c</script>d", "a<b>c d"),
     ("<b>bold</b>er", "bold er"), ("<font color=red face='a b'>x</font>", "x"), ("a<", "a <"), (" <br> ", None), ("", None), (None, None), ("x" * 50_000 + "<i>y</i>", "x" * 50_000 + " y")],
)
def test_text_of_html(spark, text, want):
    assert one(spark, X.html_text(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("Wed, 30 Sep 2026 08:00:00 +0700 (ICT)", "2026-09-30 01:00:00"), ("30 Sep 26 08:00 GMT", "2026-09-30 08:00:00"), ("30 Sep 69 08:00:00 +0000", "1969-09-30 08:00:00"), ("Wednesday, 30  Sep 2026 08:00:00 +0000", "2026-09-30 08:00:00"), ("Wed 30 Sep 2026 08:00:00 +0000", "2026-09-30 08:00:00"), ("30 Sep 2026 08:00:00", None), ("(x)", None)])
def test_rfc822_forms(spark, text, want):
    assert one(spark, F.date_format(X.rfc822(F.col("t")), "yyyy-MM-dd HH:mm:ss"), t=text) == want


def test_text_expressions(spark):
    assert one(spark, X.clean_text(F.col("t")), t=" n/a ") is None and one(spark, X.clean_text(F.col("t")), t=" a \t b ") == "a b"
    assert one(spark, X.hyphen_title(F.col("t")), t="TIMOR-LESTE") == "Timor-Leste"
    assert one(spark, X.compact_title(F.col("t")), t="HaiPhong") == "HaiPhong" and one(spark, X.compact_key(F.col("t")), t=None) is None
    assert one(spark, X.without_suffix(F.col("t"), F.col("s")), t="A - B - C", s="C") == "A - B"
    assert one(spark, X.pattern_labels([F.col("t")], {"x": "foo", "y": "b.r"}), t="a BAR") == ["y"]
    assert one(spark, X.padded_code(F.col("t"), ["TH", "KH"]), t="KH-1") == "KH01" and one(spark, X.padded_code(F.col("t"), ["TH"]), t="MY-04") is None
    assert one(spark, X.below(F.col("t"), "landing"), t="file:/a/landing/x/y.csv") == "x/y.csv"
    assert X.snake_columns(["A b", "#c!"]) == ["a_b", "c"] and X.snake_name("!!") == "col"
    with pytest.raises(ValueError):
        X.snake_columns(["a b", "a-b"])


@pytest.mark.parametrize("text,want", [("2020-01-05", "2020-01-05"), ("2020/01/05", "2020-01-05"), ("20200105", "2020-01-05"), (" 2020-01-05T00:00:00 ", "2020-01-05"), ("2020-01-05 10:00:00", "2020-01-05"), ("2020-02-30", None), ("0000-00-00", None), ("2020", None), ("n.d.", None), ("2020-01/05", None), (None, None)])
def test_parse_day(spark, text, want):
    got = one(spark, N.parse_day(F.col("t")).cast("string"), t=text)
    assert got == want


def test_normal_forms(spark):
    assert one(spark, N.trim_all(F.col("t")), t=" 　a b\x1f\n") == "a b"
    assert one(spark, N.is_placeholder(F.col("t")), t=" None ") is True and one(spark, N.is_placeholder(F.col("t")), t=None) is True
    assert one(spark, N.parse_int(F.col("t")), t=" 07.0") == 7 and one(spark, N.parse_int(F.col("t")), t="7.5") is None
    a, b = (one(spark, N.instant_micros(F.col("t")), t=t) for t in ("2026-08-23T01:59:00+08:00", "2026-08-22T17:59:00.000000Z"))
    assert a == b and one(spark, N.instant_micros(F.col("t")), t="junk") is None


def test_versions(spark):
    df = spark.createDataFrame([("V1.9",), ("V1.10",), ("v2-beta",), (None,)], "release string")
    assert L.latest_version(df, "release").first()[0] == "V1.10"
    assert L.rows_of_latest_version(df, "release").count() == 1
    assert L.rows_of_latest_snapshot(df.limit(0), "release").count() == 0
