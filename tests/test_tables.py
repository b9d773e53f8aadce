"""Runners of the typed tables: what is refused leaves the former content, reruns are identical, rows are accounted for."""

from datetime import date, datetime

import pytest
from test_reference import COUNT, bounds, frame

from morbiscope.operators.checks import ContractError
from morbiscope.plans import pipelines as W
from morbiscope.plans import tables as T
from morbiscope.sources.store import TableStore

GHO = {"COUNTRY": "VIET NAM", "ISO3": "vnm", "YEAR": "2024", "DATE_TYPE": "Month", "DATE_NUM": "3", "START_DATE": None, "CASES": "7", "_source": "who_gho", "_source_file": "f", "_ingested_at": "2026-10-01T00:00:00Z", "ingestion_date": "2026-10-01"}
NEWS = {"guid": "g", "title": "A", "description": "5 &lt; 7", "feed_country": "vnm", "feed_gl": "vn", "feed_query": "q", "link": "https://a/b", "pubDate": "Wed, 30 Sep 26 08:00:00 +0700 (ICT)", "source_url": "x", "_source_file": "f", "_source": "news_rss", "_ingested_at": "2026-10-01T00:00:00Z", "_fetched_at": "2026-10-01T00:00:00Z"}


@pytest.fixture
def tables(spark, tmp_path):
    return T.Tables(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/typed", date(2026, 10, 2), datetime(2026, 10, 2))


def put(t, name, df):
    TableStore(t.spark, f"{t.raw}/{name}").overwrite(df)


def test_series_of_two_sources(spark, tables, rows):
    put(tables, "opendengue", frame(spark, COUNT, {}, {}, {"S_res": "Admin2"}, {"dengue_total": "-1"}, {"release": "V1.2", "dengue_total": "1"}))
    put(tables, "who_gho", frame(spark, GHO, {}, {}, {"YEAR": "2029"}, {"CASES": "x"}, {"ingestion_date": "2026-09-01", "CASES": "1"}))
    got = T.run_tables(tables, ["counts", "snapshot"])
    assert got["counts"] == {"release": "V1.3", "source_rows": 4, "excluded_rows": 1, "typed_rows": 3, "valid_rows": 2, "invalid_rows": 1, "output_rows": 1, "deduplicated_rows": 1}
    assert got["snapshot"] == {"snapshot": "2026-10-01", "source_rows": 4, "typed_rows": 4, "valid_rows": 2, "invalid_rows": 1, "output_rows": 1, "deduplicated_rows": 1, "derived_rows": 2, "future_rows": 1}
    store = tables.target("series", "_source")
    before = rows(store.read())
    assert store.partition_values() == ["opendengue", "who_gho"] and len(before) == 2
    T.run_tables(tables, ["counts"])
    assert rows(store.read()) == before  # a rerun changes nothing
    put(tables, "opendengue", frame(spark, COUNT, {}, {"dengue_total": "121"}))
    with pytest.raises(ContractError, match="conflicting"):
        T.build_counts(tables)
    put(tables, "who_gho", frame(spark, GHO, {}, {"CASES": "8"}))
    with pytest.raises(ContractError, match="conflicting"):
        T.build_snapshot(tables)
    assert rows(store.read()) == before  # what is refused leaves the former content
    put(tables, "opendengue", frame(spark, COUNT, {"dengue_total": "x"}))
    with pytest.raises(ContractError, match="no row is valid"):
        T.build_counts(tables)
    put(tables, "opendengue", frame(spark, COUNT, {"release": "draft"}))
    with pytest.raises(ContractError, match="no release"):
        T.build_counts(tables)


def test_earlier_layout_is_renamed_if_it_is_alone(spark, tables):
    put(tables, "opendengue", frame(spark, COUNT, {}))
    T.build_counts(tables)
    store = tables.target("series", "_source")
    store.rename_column("p_code", "rne_iso_code", only="opendengue")
    T.build_counts(tables)
    assert set(store.read().columns) == set(W.HISTORY) and store.read(version=0).count() == 1
    store.replace_partition(store.read().drop("_source"), "who_gho")
    store.rename_column("p_code", "rne_iso_code")
    with pytest.raises(ContractError):
        T.build_counts(tables)


def test_history_needs_boundaries_and_both_sources(spark, tables):
    put(tables, "opendengue", frame(spark, COUNT, {}))
    with pytest.raises(ContractError, match="boundaries first"):
        T.build_history(tables)
    with pytest.raises(ContractError, match="no raw table"):
        T.run_tables(tables, ["history"])
    tables.target("boundaries").overwrite(bounds(spark, ("Viet Nam", None, "VNM", "VN")))
    put(tables, "who_gho", frame(spark, GHO, {}, {"START_DATE": "2025-02-01", "YEAR": "2025", "DATE_NUM": "2"}))
    got = T.build_history(tables)
    assert {k: got[k] for k in ("counts_known_rows", "opendengue_admin0_kept", "who_gho_admin0_kept", "skipped_rows", "history_rows", "codes_compact_name")} == {
        "counts_known_rows": 1, "opendengue_admin0_kept": 1, "who_gho_admin0_kept": 1, "skipped_rows": 1, "history_rows": 2, "codes_compact_name": 2,
    }
    put(tables, "opendengue", frame(spark, COUNT, {"S_res": "Admin1", "adm_1_name": "Hue"}))
    with pytest.raises(ContractError, match="both sources"):
        T.build_history(tables)


def test_news(spark, tables):
    put(tables, "news_rss", frame(spark, NEWS, {}, {"_fetched_at": "2026-10-01T09:00:00Z", "title": "newer"}, {"pubDate": "soon"}))
    got = T.build_news(tables)
    assert got["invalid_rows"] == 1 and got["deduplicated_rows"] == 1
    (row,) = tables.target("news").read().collect()
    assert row.title == "newer" and row.description == "5 < 7" and row.pubDate.year == 2026
