"""Every query over whole small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from morbiscope.llm import queries as Q  # noqa: E402
from tools.verify import canon  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    got = Q.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        assert canon(got) == canon(con.execute(Q.oracle_sql()[name]).fetchdf())


def test_columns(spark):
    want = {"p1_found": "record_id bigint, p_code string", "p4_found": "table_name string, first_id bigint, copy_id bigint", "p9_found": "doc_id bigint, kind string, start_pos int, end_pos int", "p7_ids": "doc_id bigint, ids array<int>"}
    for name, ddl in want.items():
        assert ", ".join(f"{a} {b}" for a, b in Q.queries()[name](spark, SF).dtypes) == ddl
