"""Selection of periods against a brute-force statement of its rule."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from morbiscope.operators import periods as P

D0 = date(2020, 1, 1)
DDL = "id bigint, place string, kind string, start_date date, period_end date, level int"


def brute(data, sources):
    """Ids taken: compared with every other row, level by level."""
    meets = lambda x, y: x[1] == y[1] and x[3] < y[4] and y[3] < x[4]
    usable = [r for r in data if r[3] and r[4] and r[3] < r[4]]
    taken = []
    for level in range(5):
        first = max(s for s in sources if s <= level)
        taken += [r for r in usable if r[2] == str(level) and not any(meets(r, b) for b in usable if int(b[2]) < first) and not any(meets(r, b) for b in taken if first <= int(b[2]) < level)]
    return taken


def test_selection_follows_the_rule(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        level = rng.randrange(5)
        start = D0 + timedelta(days=rng.randrange(400)) if rng.random() > 0.03 else None
        end = start + timedelta(days=rng.choice([7, 30, 0, 200][: 3 + level // 2])) if start else None
        data.append((i, rng.choice(["a", "a", "a", "b", None]), str(level), start, end, 9))
    data += [(600 + i, *r[1:]) for i, r in enumerate(data[:20])]
    rows = spark.createDataFrame(data, DDL)
    got, checks = P.select_periods(rows, ["place"], [[F.col("kind") == "0", F.col("kind") == "1"], [F.col("kind") == k for k in "234"]], "x")
    want = brute(data, [0, 2])
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in want)
    clashes = {r.id for r in checks[0].violations.collect()}
    for r in want:  # every overlap has at least one of its two rows among the violations
        for b in want:
            if r[0] < b[0] and r[1] == b[1] and r[3] < b[4] and b[3] < r[4]:
                assert r[0] in clashes or b[0] in clashes


def test_disjoint_and_overlapping(spark):
    d = lambda n: D0 + timedelta(days=n)
    rows = spark.createDataFrame([(1, "a", "m", d(0), d(30), 0), (2, "a", "m", d(30), d(60), 0), (3, None, "m", d(0), d(30), 0), (4, None, "m", d(40), d(50), 0), (5, "b", "m", None, d(9), 0)], DDL)
    fence = spark.createDataFrame([("a", d(29), d(31), "x"), (None, d(30), d(40), "x"), ("a", None, d(9), "x")], "place string, start_date date, period_end date, kind string")
    assert sorted(r.id for r in P.disjoint_from(rows, fence, ["place"]).collect()) == [3, 4]
    assert P.disjoint_from(rows.limit(0), fence, ["place"]).count() == 0
    assert sorted(r.id for r in P.disjoint_from(rows, fence.limit(0), ["place"]).collect()) == [1, 2, 3, 4]
    again = spark.createDataFrame([(1, "a", "m", d(0), d(30), 0), (2, "a", "m", d(0), d(30), 0), (3, "a", "m", d(29), d(40), 0), (4, "a", "m", d(40), d(41), 0), (5, None, "m", d(29), d(40), 0)], DDL)
    assert sorted(r.id for r in P.overlapping(again, ["place"], ["id"]).collect()) == [2, 3]
