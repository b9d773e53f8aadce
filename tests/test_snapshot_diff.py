from morbiscope.operators.snapshot_diff import snapshot_changes

S = "k string, v int, day string, at int, change_kind string"


def diff(spark, data):
    df = spark.createDataFrame(data, S)
    return sorted((tuple(r) for r in snapshot_changes(df, ["k"], ["v"], "day", "at").collect()), key=repr)


def test_changes(spark):
    data = [
        ("a", 1, "1", 0, ""), ("b", 1, "1", 0, ""), ("c", None, "1", 0, ""), ("d", 4, "1", 0, ""),
        ("a", 1, "2", 0, ""), ("b", 2, "2", 0, ""), ("c", 3, "2", 0, ""), ("e", 5, "2", 0, ""),
        ("e", None, "9", 0, ""), (None, 7, "9", 0, ""), ("a", 1, None, 0, ""),
    ]
    assert diff(spark, data) == sorted(
        [("b", "2", "changed"), ("c", "2", "changed"), ("d", "2", "removed"), ("e", "2", "added"), ("a", "9", "removed"), ("b", "9", "removed"), ("c", "9", "removed"), ("e", "9", "changed"), (None, "9", "added")], key=repr
    )


def test_latest_row_of_a_snapshot_holds_whatever_the_order(spark):
    data = [("a", 1, "1", 5, ""), ("a", 9, "1", 4, ""), ("a", 9, "1", None, ""), ("a", 1, "2", None, ""), ("a", 2, "2", 1, ""), ("a", 2, "2", 1, "")]
    assert diff(spark, data) == diff(spark, data[::-1]) == [("a", "2", "changed")]


def test_one_snapshot_and_none(spark):
    assert diff(spark, [("a", 1, "1", 5, "")]) == [] == diff(spark, [])


def test_record_repeated_over_a_third_of_the_table(spark):
    rows = spark.range(6000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id div 2) end as k", "cast(id % 5 as int) as v", "cast(id % 2 as string) as day", "cast(id as int) as at", "'' as change_kind")
    got = {r["k"]: r["change_kind"] for r in snapshot_changes(rows, ["k"], ["v"], "day", "at").collect()}
    last = {}
    for i in range(6000):
        last["hot" if i % 3 == 0 else f"k{i // 2}", i % 2] = i % 5
    want = {}
    for k in {k for k, _ in last}:
        a, b = last.get((k, 0)), last.get((k, 1))
        if a != b:
            want[k] = "added" if a is None else "removed" if b is None else "changed"
    assert got == want and "hot" in want
