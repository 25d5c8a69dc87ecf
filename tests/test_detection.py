"""Detection on sentences whose spans are known."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions.text import matches
from veilspan.model import entities_of, labels_allowed
from veilspan.operators import recognizers as rec
from veilspan.operators.detection import detect, resolved
from veilspan.settings import Settings

SETTINGS = Settings(enable_krs=True)

CASES = [
    ("NIP: 1234563218 lub 123-456-32-18", [("NIP", "1234563218"), ("NIP", "123-456-32-18")]),
    ("karta 4111 1111 1111 1111", [("CARD", "4111 1111 1111 1111")]),
    ("karta 4111111111111112", []),
    ("Zadzwoń: +48601234567, dziękuję.", [("PHONE", "+48601234567")]),
    ("Zadzwoń: +48 601 234 567, dziękuję.", [("PHONE", "+48 601 234 567")]),
    ("Zadzwoń: +48 22 123 45 67, dziękuję.", [("PHONE", "+48 22 123 45 67")]),
    ("Zadzwoń: 601 234 567, dziękuję.", [("PHONE", "601 234 567")]),
    ("Zadzwoń: 22 123 45 67, dziękuję.", [("PHONE", "22 123 45 67")]),
    ("tel. 601234567", [("PHONE", "601234567")]),
    ("identyfikator 601234567", []),
    ("ó+48601234567", []),
    ("adres: 00-950 Warszawa", [("POSTAL", "00-950")]),
    ("zakres 10-100 szt.", []),
    ("tablica rejestracyjna WW 12345", [("PLATE", "WW 12345")]),
    ("tablica rejestracyjna KR 1A234", [("PLATE", "KR 1A234")]),
    ("tablica ww 12345", []),
    ("kod WW 12345", []),
    ("norma EN 16001", []),
    ("tablica REG 12345", []),
    ("spółka zarejestrowana pod KRS 0000123456", [("KRS", "0000123456")]),
    ("identyfikator wpisu 0000123456", []),
    ("wpis KRS 0000123456 w rejestrze", [("KRS", "0000123456")]),
    ("REGON 12345678512347", [("REGON", "12345678512347")]),
    ("numer 123456785", []),
    ("mieszka przy ul. Marszałkowska 1/5 w Warszawie", [("ADDRESS", "ul. Marszałkowska 1/5")]),
    ("Jan, ur. 01.02.1990, Warszawa", [("DOB", "01.02.1990")]),
    ("urodzoną: 1990-02-01", [("DOB", "1990-02-01")]),
    ("spotkanie odbyło się 01.02.1990", []),
    ("paszport AA1234567", [("PASSPORT", "AA1234567")]),
    ("Sprzedawca: Sigma Consulting Sp. z o.o.", [("ORG", "Sigma Consulting Sp. z o.o.")]),
    ("Nabywca: Beta S.A. z siedzibą w Warszawie", [("ORG", "Beta S.A.")]),
    ("PL61109010140000071219812874 konto", [("IBAN", "PL61109010140000071219812874")]),
    ("konto PL61109010140000071219812875", []),
    ("dowód ABA300000 i ABA123456", [("DOWOD", "ABA300000")]),
    ("mail jan@example.pl", [("EMAIL", "jan@example.pl")]),
    ("", []),
    (None, []),
]


def test_known_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    found = {r["id"]: r for r in detect(df, settings=SETTINGS).collect()}
    for i, (text, expected) in enumerate(CASES):
        spans = found[i]["spans"]
        assert [(s["label"], s["text"]) for s in spans] == expected, text
        for s in spans:
            assert text[s["start"] : s["end"]] == s["text"]


def test_spans_are_sorted_and_disjoint(spark):
    text = "NIP 1234563218 tel 601 234 567, ul. Długa 5, 00-950 Warszawa, PESEL 44051401359, a😀b jan@example.pl"
    spans = detect(spark.createDataFrame([(text,)], "text string"), settings=SETTINGS).first()["spans"]
    assert len(spans) == 6
    assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:], strict=False))
    assert spans[-1]["text"] == "jan@example.pl" == text[spans[-1]["start"] : spans[-1]["end"]]


def test_threshold_after_boosts_and_as_column(spark):
    df = spark.createDataFrame([("tel. 601234567", 0.6), ("tel. 601234567", 0.7), ("numer 601234567", 0.0)], "text string, least double")
    sizes = [len(r["spans"]) for r in detect(df, settings=SETTINGS, labels=["PHONE"], threshold=F.col("least")).collect()]
    assert sizes == [1, 0, 1]


def test_label_allow_list():
    assert labels_allowed(None) is None and labels_allowed([]) is None
    assert labels_allowed(["US_SSN"]) == []
    assert labels_allowed(["PL_NIP", "EMAIL", "NIP"]) == ["NIP", "EMAIL"]
    with pytest.raises(ValueError):
        entities_of(["NOPE"])


def test_krs_is_off_by_default():
    assert "krs" not in {r.name for r in rec.registry(Settings())}
    assert "krs" in {r.name for r in rec.registry(SETTINGS)}


def test_pruning_leaves_the_other_patterns_out():
    assert rec.pruned(rec.STANDARD, {"PL_NIP"}) == (rec.NIP,)


def test_extension_and_strict_company(spark):
    own = rec.Recogniser("badge", "PL_PASSPORT", ((r"\bB#\d{4}\b", 0.5),), keep=lambda t: t != "B#0000")
    df = spark.createDataFrame([("B#1234 B#0000",), ("Alpha spjaw",), ("Firma Alfa Spółka z o.o. jest",)], "text string")
    rows = [r["spans"] for r in detect(df, recognisers=[own, rec.ORG_STRICT]).collect()]
    assert [[s["text"] for s in r] for r in rows] == [["B#1234"], [], ["Firma Alfa Spółka z o.o."]]
    loose = detect(df, recognisers=[rec.ORG]).collect()
    assert [[s["text"] for s in r["spans"]] for r in loose] == [[], ["Alpha spj"], []]


def test_ner_plug_in(spark):
    def model(text):
        made = [(0, 4, "ORGANIZATION"), (5, 16, "PERSON"), (17, 20, "PERSON"), (21, 31, "DATE_TIME"), (0, 3, "NO_SUCH")]
        return F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(e).alias("entity"), F.lit(0.8).alias("score")) for a, b, e in made))

    df = spark.createDataFrame([("KRS: 44051401359 Jan 01.02.1990",)], "text string")
    spans = detect(df, settings=SETTINGS, ner=model).first()["spans"]
    assert [(s["label"], s["text"], s["source"]) for s in spans] == [("PESEL", "44051401359", "pattern"), ("PERSON", "Jan", "ner")]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a1 @.\u0001ż😀", max_size=25), min_size=1, max_size=20))
def test_positions_agree_with_python(spark, texts):
    import regex

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in df.select("id", "text", matches(F.col("text"), r"\d+|@\w?").alias("m")).collect():
        assert [(m["start"], m["end"]) for m in r["m"]] == [m.span() for m in regex.finditer(r"\d+|@\w?", r["text"])]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6), st.sampled_from("ABC"), st.sampled_from((0.25, 0.5, 1.0)), st.booleans()), max_size=7), min_size=1, max_size=10))
def test_greedy_choice_agrees_with_brute_force(spark, rows):
    spans = [[(a, a + n, label, score, "", "ner" if ner else "pattern") for a, n, label, score, ner in row] for row in rows]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "id int, spans array<struct<start:int,end:int,label:string,score:double,text:string,source:string>>")
    for r in df.select("id", resolved(F.col("spans")).alias("out")).collect():
        kept = []
        for s in sorted(spans[r["id"]], key=lambda s: (s[5] == "ner", -s[3], s[0] - s[1], s[0], s[2])):
            if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
                kept.append(s)
        assert [tuple(x) for x in r["out"]] == sorted(kept)
