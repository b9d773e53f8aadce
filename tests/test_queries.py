"""Every core query runs over whole small tables, and agrees with its SQL."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from morbiscope.plans import catalog, problems  # noqa: E402
from tools.verify import canon  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = {**catalog.queries(), **problems.queries()}
SQL = {**catalog.oracle_sql(), **problems.oracle_sql()}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)
    else:
        assert len(got)


def test_whole_tables_are_profiled(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert [r.column_name for r in catalog.profile_table(spark, SF).collect()] == documents.columns
    news = spark.read.parquet(f"{SF}/news_rss.parquet")
    assert catalog.duplicate_report(spark, SF).first().duplicate_rows == news.count() - news.distinct().count()


def test_conflicts_are_returned(spark, tmp_path):
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey = 1").limit(1)
    lineitem.unionAll(lineitem.withColumn("l_linestatus", F.lit("other"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    (got,) = catalog.keep_best_conflicts(spark, str(tmp_path)).collect()
    assert got.check == "lineitem: conflicting l_linestatus within one key" and '"l_orderkey":1,' in got.key
