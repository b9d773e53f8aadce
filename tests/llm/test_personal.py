import itertools

import pytest
from pyspark.sql import functions as F

from morbiscope.llm import personal_entities as E
from morbiscope.llm import surrogates as S
from morbiscope.operators.checks import ContractError

GIVEN = [a + b for a, b in itertools.product(["ar", "be", "qui", "ta", "zo"], ["mel", "rumi", "sira", "lon"])]
FAMILY = [a + b for a, b in itertools.product(["esk", "fol", "grim", "prald", "wolt"], ["ano", "jono", "dinata", "berg"])]
# The list is incomplete: every fifth part is missing.
PARTS = [(w.capitalize(), k) for k, words in (("given", GIVEN), ("family", FAMILY)) for i, w in enumerate(words) if i % 5 != 3]


@pytest.fixture(scope="module")
def lexicon():
    return E.NameLexicon(PARTS)


def found(text, lexicon):
    return [(s.kind, text[s.start : s.end]) for s in E.find_entities(text, lexicon)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dear Armel Eskano,", [("name", "Armel Eskano")]), ("ESKANO Armel came", [("name", "ESKANO Armel")]), ("Eskano, Armel; M", [("name", "Eskano, Armel")]), ("by A. Eskano.", [("name", "A. Eskano")]), ("Armel E. Folberg", [("name", "Armel E. Folberg")]), ("see Armel B. today", [("name", "Armel B.")]),
        ("Armel binti Folberg-Grimano", [("name", "Armel binti Folberg-Grimano")]), ("Tarumi Grimberg", [("name", "Tarumi Grimberg")]), ("Zosira Woltdinata", [("name", "Zosira Woltdinata")]), ("Eskano said", []), ("Armel Eskano General Hospital", []), ("Jl. Armel Eskano", []),
        ("write a.b+c@mail-x.example.", [("email", "a.b+c@mail-x.example")]), ("<A.B(at)C(dot)example>", [("email", "A.B(at)C(dot)example")]), ("x [at] y.example", [("email", "x [at] y.example")]), ("x＠y.example", [("email", "x＠y.example")]), ("Follow @vectorwatch on", []), ("x @ y.example", [("email", "x @ y.example")]),
        ("call +210 (6) 477 433 ext. 589 now", [("phone", "+210 (6) 477 433 ext. 589")]), ("00990-66-591702", [("phone", "00990-66-591702")]), ("tel. 0552.791.961", [("phone", "0552.791.961")]), ("(091) 600-2626", [("phone", "(091) 600-2626")]), ("on 6614 9327.", [("phone", "6614 9327")]), ("0539561005", [("phone", "0539561005")]), ("+991 2 2267 0521", [("phone", "+991 2 2267 0521")]),
        ("ID no. G5354488K", [("identity_number", "G5354488K")]), ("5-9309-47382-14-2", [("identity_number", "5-9309-47382-14-2")]), ("HC-3667-76-951", [("identity_number", "HC-3667-76-951")]), ("NIK 600549761384", [("identity_number", "600549761384")]), ("8872 4345 8356", [("identity_number", "8872 4345 8356")]), ("951002-89-9167", [("identity_number", "951002-89-9167")]),
        ("batch 245533140921", []), ("Sample 331190080123 and tube 0842034767", []), ("lot 7219-45-7355", []), ("barcode 4799128921125", []), ("47P 0604924818", []), ("Reference 19-3564/25", []), ("12 500 000 (of 48 200 000)", []), ("2026-05-31", []), ("Coordinates 9.12994, 130.67957", []),
        ("at P.O. Box 177, Kamrontur;", [("address", "P.O. Box 177, Kamrontur")]), ("Blk 383 #02-169 Saltmarsh Avenue;", [("address", "Blk 383 #02-169 Saltmarsh Avenue")]), ("Flat 6A, 85 Brickyard Street, Kamrontur", [("address", "Flat 6A, 85 Brickyard Street, Kamrontur")]), ("House 101, Kapok Close, Kamrontur 5353", [("address", "House 101, Kapok Close, Kamrontur 5353")]),
        ("No. 62, Lorong Old Ferry 3, Dimsilmum", [("address", "No. 62, Lorong Old Ferry 3, Dimsilmum")]), ("số 296/4 đường Cistern, phường Lultartes có", [("address", "số 296/4 đường Cistern, phường Lultartes")]), ("tổ 1, ấp Mangrove, xã Tenronbun", [("address", "tổ 1, ấp Mangrove, xã Tenronbun")]), ("Kp. Tamarind RT 4 No. 32, Dimsekkol.", [("address", "Kp. Tamarind RT 4 No. 32, Dimsekkol")]),
        ("Jl. Heron No. 9 RT 02/RW 04, Dimsekkol", [("address", "Jl. Heron No. 9 RT 02/RW 04, Dimsekkol")]), ("M, 7, Jalan Saltmarsh 273, Moksilsen 13376", [("address", "Jalan Saltmarsh 273, Moksilsen 13376")]), ("Blk 8 Lot 379, Heron Village, Tenmultes ay", [("address", "Blk 8 Lot 379, Heron Village, Tenmultes")]), ("Purok 3, 217 Tamarind St., Brgy. Minkilmel", [("address", "Purok 3, 217 Tamarind St., Brgy. Minkilmel")]),
        ("Rua Torvel, n.º 362, Milnulmen", [("address", "Rua Torvel, n.º 362, Milnulmen")]), ("350/3 หมู่ 7 ถนน Monsoon Siltoltul 27331", [("address", "350/3 หมู่ 7 ถนน Monsoon Siltoltul 27331")]), ("Route 33 and Ward 10 were closed; Mangrove Road was fogged", []), (None, []), ("", []), (" \n", []),
    ],
)
def test_find(text, want, lexicon):
    assert found(text, lexicon) == want


@pytest.mark.parametrize("word", ["Dengue hotline: ", "helpline ", "landline no. ", "postcode "])
def test_words_that_end_like_a_thing(word, lexicon):
    assert found(f"{word}0800 123 456", lexicon) == [("phone", "0800 123 456")] and found(f"{word}0539561005", lexicon) == [("phone", "0539561005")]
    assert found("budget line: 0539561005; 47P 0604924818; เก็บตัวอย่าง 0842034767", lexicon) == []


def test_same_names_without_the_automaton(lexicon):
    text = "İ Armel Eskano, xArmel Eskanox QUIRUMI Folano " * 3
    plain = E.NameLexicon(PARTS)
    plain.automaton = None
    assert E.find_entities(text, lexicon) == E.find_entities(text, plain) != []


def test_spans_never_overlap_in_long_lists(lexicon):
    text = "\n".join(f"{i}; Armel Eskano; M; {i}; No. {i % 900}, Lorong Heron 3, Dimsilmum; 0539561{i:03d}; a{i}@b.example" for i in range(900))
    spans = E.find_entities(text, lexicon)
    assert len(spans) == 3600 and all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_surrogates_keep_type_and_stay_distinct(lexicon):
    made = S.Surrogates("key", lexicon)
    assert [len({tuple(made.permute(list(x), r, "t")) for x in itertools.product(range(r), repeat=n)}) for r, n in ((10, 3), (5, 4), (21, 2), (10, 1))] == [1000, 625, 441, 10]
    names = [f"{g.capitalize()} {f.upper()}" for g in GIVEN for f in FAMILY]
    new = [made.replace("name", n, {}) for n in names]
    assert len(set(new)) == len(names) and all(x.split()[1].isupper() and x != n for x, n in zip(new, names))
    assert all(x.split()[0].lower().endswith(n.split()[0].lower()[-3:]) for x, n in zip(new, names))  # the ending marks gender
    known = {}
    full, short = made.replace("name", "Armel Eskano", known), made.replace("name", "A. Eskano", known)
    assert short == f"{full[0]}. {full.split()[1]}"
    a, b = made.replace("phone", "+210 9 3501 4657", {}), made.replace("phone", "+21093501-4657", {})
    assert a.startswith("+210 ") and [c for c in a if c.isdigit()] == [c for c in b if c.isdigit()] and a != "+210 9 3501 4657"
    assert S.Surrogates("other", lexicon).replace("phone", "0539561005", {}) != made.replace("phone", "0539561005", {})
    e = made.replace("email", "jo.b99@Mail.example", {})
    assert e.endswith(".example") and e[2] == "." and e[7 - 1] == "@" and e.split("@")[1][0].isupper()


def test_initials_are_one_bijection_with_the_parts(lexicon):
    made = S.Surrogates("key", lexicon)
    letters = {made.replace("name", f"{x}. Eskano") for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    assert len(letters) == 26
    for given in GIVEN:  # with the full name in the document or without it
        full, short = made.replace("name", f"{given.capitalize()} Eskano"), made.replace("name", f"{given[0].upper()}. Eskano")
        assert short == f"{full[0]}. {full.split()[1]}"
    assert len(set(made.parts.values())) == len(made.parts) and all(w != x for w, x in made.parts.items())


def test_no_surrogate_of_two_people_in_a_corpus(spark):
    texts = ["Armel Eskano and A. Eskano", "A. Eskano", *[f"{x}. Eskano" for x in "BCDEFGHIJKLMNOPQRSTUVWXYZ"], "Eskberg, Q. and Quilon Eskberg, Tasira Eskano"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts = spark.createDataFrame(PARTS, "name_part string, position string")
    found = S.protect_documents(df, parts, key="k", texts=False, originals=True)
    entities = found.select(F.explode("entities").alias("e")).select("e.kind", "e.original", "e.surrogate")
    assert [tuple(r) for r in S.surrogate_accounting(entities).collect()] == [("name", entities.select("original").distinct().count(), 0, 0)]


def test_frame(spark, lexicon):
    text = "Dear Armel Eskano, call 0539561005 or a@b.example​ \U0001f600 A. Eskano"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (1, text, "y"), (5, "plain " * 50000 + "Armel Eskano", "x")], "doc_id bigint, text string, entities string")
    parts = spark.createDataFrame([*PARTS, (None, "given"), ("X", None)], "name_part string, position string")
    rows = S.protect_documents(df, parts, key="k").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 6 and by[1].redacted == "Dear [NAME], call [PHONE] or [EMAIL]​ \U0001f600 [NAME]"
    assert [text[e.start_pos : e.end_pos] for e in by[1].entities] == ["Armel Eskano", "0539561005", "a@b.example", "A. Eskano"]
    assert by[2].redacted is None and by[2].entities == [] and by[3].redacted == "" and by[4].redacted == " " and by[5].entities[0].start_pos == 300000
    assert [r.kind for r in S.protect_documents(df, parts.limit(0), key="k").where("doc_id = 5 or doc_id = 1").first().entities] == ["phone", "email"]
    assert S.protect_documents(df.limit(0), parts, key="k").count() == 0
    flat = S.protect_documents(df, parts, key="k").select("doc_id", "text_surrogate", F.explode("entities").alias("e"))
    ents = spark.createDataFrame([("phone", "1 2", "9"), ("phone", "12", "9"), ("phone", "13", "9")], "kind string, original string, surrogate string")
    assert flat.count() == 9 and [tuple(r) for r in S.surrogate_collisions(ents).collect()] == [("phone", "9", 2)]


@pytest.mark.parametrize(
    "text,kind,start,end",
    [
        ("x " + "a" * 100 + "@mail.example.org end", "email", 2, 119),
        ("Jalan Heron No. 9, K" + "a" * 170 + " next", "address", 0, 190),
        ("to a@" + ".".join(f"label{i}" for i in range(20)) + ".org now", "email", 3, 158),
        ("a.b" + " (dot) cc" * 30 + " (at) mail (dot) org.", "email", 0, 293),
        ("call 0539561005   ,   máy lẻ   12345 please", "phone", 5, 36),
        ("số 12 đường Heron" + ", phường Kestrelwingham" * 40, "address", 0, 17 + 40 * 23),
        ("w " * 20_000 + "0539561005 and " + "w " * 20_000, "phone", 40_000, 40_010),
    ],
)
def test_entities_of_any_length_are_found_whole(text, kind, start, end):
    assert [(s.kind, s.start, s.end) for s in E.find_entities(text, E.NameLexicon([]))] == [(kind, start, end)]


def test_things_are_told_from_numbers_at_any_distance():
    lexicon = E.NameLexicon([])
    assert E.find_entities("sample" + " " * 60 + "no." + " " * 60 + "0539561005", lexicon) == []
    assert [s.kind for s in E.find_entities("+84 24 1234 567, 0539561005; +84 24 1234 567", lexicon)] == ["phone"] * 3


def test_checked_protection_refuses_collisions(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a@example.org b@example.org")], "doc_id bigint, text string")
    parts = spark.createDataFrame([], "name_part string, position string")
    assert S.protect_checked(docs, parts, key="k").first().redacted == "[EMAIL] [EMAIL]"
    same = F.transform("entities", lambda e: e.withField("surrogate", F.lit("x")))
    whole = S.protect_documents
    monkeypatch.setattr(S, "protect_documents", lambda *a, **k: whole(*a, **k).withColumn("entities", same))
    with pytest.raises(ContractError, match="not distinct"):
        S.protect_checked(docs, parts, key="k")
