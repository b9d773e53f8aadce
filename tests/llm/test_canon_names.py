import random

import pytest

from morbiscope.llm import canon_names as C

ENTRIES = [("PHL", "Wimwim Norte", "PH01"), ("PHL", "Wimwim Sur", "PH02"), ("PHL", "Rikketsur", "PH05"), ("PHL", "Rikketsar", "PH06"), ("PHL", "Chanurloi", "PH14"), ("KHM", "Domsur Monfam", "KH05"), ("PHL", None, "PH")]


@pytest.fixture(scope="module")
def matcher():
    return C.NameMatcher(ENTRIES, ["Philippines", "Cambodia"])


@pytest.mark.parametrize(
    "typed,units",
    [
        ("RIKKETSUR", ["PH05"]), ("RikkÃ©tsur", ["PH05"]), ("rikkã©tsur", ["PH05"]), ("Rìkkètsúr", ["PH05"]), ("Region of Rikketsur", ["PH05"]), ("rikketsur (prov.)", ["PH05"]), ("1. Rikketsur", ["PH05"]), ("R1KKET5UR", ["PH05"]),
        ("Rikketsur [PHL]", ["PH05"]), ("RIK.K-ETSUR", ["PH05"]), ("Rikekstur", ["PH05"]), ("Rikkets", ["PH05", "PH06"]), ("Wimwim", ["PH01", "PH02"]), ("Wimwim N.", ["PH01"]), ("Sur, Wimwim", ["PH02"]), ("S. Wimwim", ["PH02"]),
        ("Wimwim South", ["PH02"]), ("wimwimnorte", ["PH01"]), ("Chanurioi", ["PH14"]), ("Charunloi", ["PH14"]), ("Philippines", []), ("Domsur Monfam", []), ("Kaltensam", []), ("Unknown", []), ("", []), ("-", []), ("x" * 5000, []),
    ],
)
def test_match(matcher, typed, units):
    assert sorted(u for u, _ in matcher.match("PHL", typed) if u) == units


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_finds_exactly_the_forms_within_the_distance():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
    forms = {word() for _ in range(150)}
    trie = C.Trie()
    for f in forms:
        trie.add(f)
    for _ in range(150):
        w, k = word(), rng.randrange(4)
        assert sorted(trie.within(w, k)) == sorted(f for f in forms if osa(w, f) <= k)


def test_automaton_takes_confused_groups_as_one_edit():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["rn", "m", "cl", "d", "oo", "u", "k", "r", "n", "o"]) for _ in range(rng.randrange(1, 6)))
    forms = {word() for _ in range(150)}
    trie = C.Trie()
    for f in forms:
        trie.add(f)
    for _ in range(150):
        w, k = word(), rng.randrange(4)
        assert sorted(trie.within(w, k)) == sorted(f for f in forms if C.cost(w, f) <= k)


def test_short_names_and_several_groups_are_walked():
    m = C.NameMatcher([("A", "Kolu", "1"), ("A", "Bornakarn", "2"), ("A", "Minkost", "3")], aliases=[("A", "Old Harbour", "3"), ("A", None, "1"), ("B", "x", None)])
    assert m.match("A", "Kol") == [("1", 1)] and m.match("A", "Ko") == []
    assert m.match("A", "Bomakam") == [("2", 2)] and m.match("A", "Minkk") == []
    assert m.match("A", "Mikos") == [("3", 2)]  # two letters are missing of seven
    assert m.match("A", "old harbour") == [("3", C.ALIAS)] and [u for u, _ in m.match("A", "Old Harbuor")] == ["3"]
    assert m.within("A", "Bornakar") == {"2": C.PREFIX}


def test_every_entry_within_the_distance(spark):
    names = spark.createDataFrame([("PHL", "Rikketser"), ("PHL", "Nowhere")], "country string, name string")
    ref = spark.createDataFrame([(c, n, u, "Philippines") for c, n, u in ENTRIES], "country string, name string, unit string, country_name string")
    for block in (50_000, 2):
        got = C.match_names(names, ref, block, every=True)
        assert sorted(tuple(r) for r in got.collect()) == [("PHL", "Rikketser", "PH05", 1.0), ("PHL", "Rikketser", "PH06", 1.0)]


def test_rows_codes_ties_and_blocks(spark):
    rows = spark.createDataFrame(
        [(1, "PHL", "Rikkets", "PH26", 0), (2, "PHL", "Rikkets", "PH24", 0), (3, "PHL", "Rikkets", None, 0), (4, "PHL", "Rikkets", "PH99", 0), (5, "PHL", "rikketsurr", "PH24", 0), (6, None, "Rikketsur", None, 0), (7, "PHL", None, None, 0), (8, "PHL", "Nowhere", "PH26", 0), (8, "PHL", "Nowhere", "PH26", 0)],
        "id int, country string, name string, code string, unit int",
    )
    ref = spark.createDataFrame([(c, n, u, "Philippines") for c, n, u in ENTRIES], "country string, name string, unit string, country_name string")
    sure = spark.createDataFrame([("PHL", "PH26", "PH05")] * 50 + [("PHL", "PH24", "PH05")] * 5 + [("PHL", "PH24", "PH06")] * 3 + [("PHL", None, "PH06")], "country string, code string, unit string")
    want = [(1, "PH05"), (2, "PH06"), (3, C.UNMATCHED), (4, C.UNMATCHED), (5, "PH05"), (6, C.UNMATCHED), (7, C.UNMATCHED), (8, C.UNMATCHED), (8, C.UNMATCHED)]
    for block in (50_000, 2):
        got = C.map_names(rows, ref, id_col="id", learn_from=sure, block_entries=block)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert C.map_names(rows.limit(0), ref, id_col="id", learn_from=sure).count() == 0
    assert {r[1] for r in C.map_names(rows, ref.limit(0), id_col="id").collect()} == {C.UNMATCHED}


def test_codes(spark):
    df = spark.createDataFrame([("PH-9",), (" ph09 ",), ("NA",), ("-99",), (None,)], "c string")
    assert [r[0] for r in df.select(C.normal_code(df.c)).collect()] == ["PH9", "PH9", None, None, None]
