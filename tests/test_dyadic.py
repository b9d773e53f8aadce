from datetime import date, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from morbiscope.operators import dyadic as D

SPANS = st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 300), st.integers(-2, 90)), max_size=40)


def brute(spans):
    out = []
    for g in sorted({g for g, _, n in spans if n > 0}):
        days = sorted({d for gg, s, n in spans if gg == g for d in range(s, s + n)})
        runs = []
        for d in days:
            if runs and runs[-1][1] == d:
                runs[-1][1] = d + 1
            else:
                runs.append([d, d + 1])
        out += [(g, False, a, b) for a, b in runs] + [(g, True, a[1], b[0]) for a, b in zip(runs, runs[1:])]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(SPANS)
def test_spans_against_days(spans):
    g, s, n = (np.array(x, np.int64) for x in (zip(*spans) if spans else ([], [], [])))
    assert sorted(zip(*(x.tolist() for x in D.spans(g, s, s + n)))) == brute(spans)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 3000))
def test_blocks_are_canonical(lo, n):
    _, start, level = D.dyadic_blocks(np.zeros(1, np.int64), np.array([lo]), np.array([lo + n]))
    size = 1 << level
    assert (start % size == 0).all() and size.sum() == n and len(start) <= 2 * (n.bit_length())
    order = np.argsort(start)
    assert (start[order][1:] == (start + size)[order][:-1]).all() and start.min() == lo


def test_siblings_merge_upward_to_one_block():
    g = np.zeros(8, np.int64)
    g, s, level = D.merge_siblings(g, np.arange(8), np.zeros(8, np.int64))
    assert (s.tolist(), level.tolist()) == ([0], [3])


def test_frame_with_nulls_repeats_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        d = date(2020, 2, 27)
        data = [("a", d, d + timedelta(days=7), 1)] * 5 + [("a", d + timedelta(days=7), d + timedelta(days=8), 2), ("a", d + timedelta(days=20), d + timedelta(days=21), 3), ("a", d, d, 4), (None, d, d + timedelta(days=1), 5), ("b", None, d, 6), ("b", d, None, 7), ("c", d + timedelta(days=3), d, 8)]
        data += [(f"k{i}", d, d + timedelta(days=i + 1), 9) for i in range(10)]
        df = spark.createDataFrame(data, "group_key string, s date, e date, span_kind int")
        out = D.periods_and_gaps(df, key="group_key", start="s", end="e").collect()
        got = sorted((r[0], r[1], (r[2] - d).days, (r[3] - d).days) for r in out if r[0] == "a")
        assert got == [("a", "gap", 8, 20), ("a", "period", 0, 8), ("a", "period", 20, 21)]
        assert len([r for r in out if r[0].startswith("k")]) == 10 and not [r for r in out if r[0] in "bc"]
        assert D.periods_and_gaps(df.limit(0), key="group_key", start="s", end="e").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_series_that_holds_a_third_of_the_rows(spark):
    rows = spark.range(30000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id) end as k", "date_add(date'2000-01-01', cast((id % 900) * 8 as int)) as s").selectExpr("k", "s", "date_add(s, 7) as e")
    out = D.periods_and_gaps(rows, key="k", start="s", end="e")
    hot = out.where("group_key = 'hot'").groupBy("span_kind").count().collect()
    assert {r[0]: r[1] for r in hot} == {"period": 300, "gap": 299} and out.count() == 20000 + 599
