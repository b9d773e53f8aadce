from morbiscope.llm import layout_copies as L

OD = "record_id bigint, adm_0_name string, adm_1_name string, Year string, UUID string, class_key string, _source string, _source_file string, _ingested_at string"
NEWS = "delivery_id bigint, title string, source string, guid string, first_id string"


def pairs(df):
    return sorted((r["first_id"], r["copy_id"], r["copies"]) for r in df.collect())


def od(i, a, b, year="2020", uuid="u"):
    return (i, a, b, year, uuid, "k", "s", f"f{i}", str(i))


def test_places(spark):
    rows = [
        od(5, "VIET NAM", "Hai Phong"), od(3, "viet-nam", " HAI.PHONG"), od(9, "Haiphong", "Viet  Nam"), od(1, "Viet Nam", "Hải Phong"), od(2, "VIET NAM", "Hai Phong", "2021"),
        od(20, None, "x"), od(21, "X ", None), od(22, "", "x"), od(23, None, None), od(24, None, None), od(30, "ab", "ba"), od(31, "ba", "ab"), od(32, "aab", "b"),
    ]
    rows.append((6, *od(6, "VIET NAM", "Hai Phong")[1:5], "other", "s", "f", "6"))  # a column of its own named like an internal one
    df = spark.createDataFrame(rows, OD)
    assert pairs(L.place_copies(df)) == [(3, 5, 3), (3, 9, 3), (20, 21, 2), (23, 24, 2), (30, 31, 2)]
    assert pairs(L.place_copies(df.limit(0))) == []


def test_news(spark):
    rows = [
        (1, "Big storm - The Post", "The Post", "", ""), (2, 'THE POST | "Big, storm"', "the post.", "", ""), (3, "storm Big - The Post", "The Post", "", ""), (4, "Big storm - Other", "Other", "", ""), (5, None, "The Post", "", ""), (6, None, "The Post", "", ""),
        (7, "no publisher", None, "", ""), (8, "No Publisher!", None, "", ""), (9, "no publisher", "Elsewhere", "", ""), (10, "บ้าน - ข่าว", "ข่าว", "", ""), (11, "ข่าว: บ้าน", "ข่าว", "", ""), (12, "x" * 20000 + " - P", "P", "", ""), (13, "P: " + "X" * 20000, "P", "", ""), (14, "", "", "", ""), (15, " ", "", "", ""),
    ]
    got = pairs(L.news_copies(spark.createDataFrame(rows, NEWS)))
    # Without a publisher in it the title is the headline, whatever the source says.
    assert got == [(1, 2, 2), (7, 8, 3), (7, 9, 3), (10, 11, 2), (12, 13, 2), (14, 15, 2)]


def test_hot_group_keeps_every_member(spark):
    df = spark.range(20000).selectExpr("id as delivery_id", "case when id % 3 = 0 then 'Hot  News - P' else concat('n ', id, ' - P') end as title", "'P' as source", "'g' as guid", "'' as first_id")
    out = L.news_copies(df)
    assert out.count() == 6666 and out.select("first_id").distinct().count() == 1 and out.first()["copies"] == 6667
