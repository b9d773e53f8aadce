import random
from datetime import date, timedelta

from morbiscope.operators.asof import as_known_join

EV, CH = "id bigint, code string, d date, known string", "code string, eff date, ann date, new string, d string"
D0 = date(2001, 1, 1)


def brute(events, changes):
    out = {}
    for i, code, d, _ in events:
        hits = [(e, a, n) for c, e, a, n, _ in changes if code is not None and c == code and d and e and a and e <= d and a <= d]
        out[i] = max(hits, key=lambda h: (h[0], h[1], h[2] is not None, h[2] or ""))[2] if hits else "NONE"
    return out


def join(spark, events, changes, days):
    out = as_known_join(spark.createDataFrame(events, EV), spark.createDataFrame(changes, CH), key="code", event_day="d", visible=["eff", "ann"], rank=["eff", "ann"], attributes=["new"], snapshot_days=days)
    got = [(r["id"], r["known_new"] if out.columns.count("known") and r[4] else "NONE") for r in out.collect()]
    return got


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    day = lambda: None if rng.random() < 0.05 else D0 + timedelta(days=rng.randrange(2000))
    changes = [(rng.choice(["A", "B", "C", None]), day(), day(), rng.choice("xyz"), "") for _ in range(80)]
    changes += changes[:10]
    events = [(i, rng.choice(["A", "A", "A", "B", "Z", None]), day(), "") for i in range(400)]
    for days in (30, 365, 5000):
        got = join(spark, events, changes, days)
        assert len(got) == len(events) and dict(got) == brute(events, changes)


def test_knowledge_is_never_from_the_future_and_corrections_win_later(spark):
    changes = [("A", D0, D0, "old", ""), ("A", D0, D0 + timedelta(days=400), "corrected", ""), ("A", D0 + timedelta(days=10), D0 - timedelta(days=90), "next", "")]
    events = [(1, "A", D0 - timedelta(days=1), ""), (2, "A", D0, ""), (3, "A", D0 + timedelta(days=10), ""), (4, "A", D0 + timedelta(days=500), "")]
    assert dict(join(spark, events, changes, 365)) == {1: "NONE", 2: "old", 3: "next", 4: "next"}


def test_empty_sides(spark):
    assert join(spark, [], [("A", D0, D0, "x", "")], 365) == []
    assert join(spark, [(1, "A", D0, "")], [], 365) == [(1, "NONE")]
