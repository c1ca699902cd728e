"""Normalisation: exact vectors, and the column and Python readings against each other."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lynceus.functions import normalize as N
from lynceus.functions import similarity as S
from lynceus.functions.script import same_look

PLAIN = [
    ("AEROCARIBBEAN AIRLINES", "aerocaribbean airlines"), ("ANGLO-CARIBBEAN CO., LTD.", "anglo caribbean co ltd"), ("  BANCO   NACIONAL  DE   CUBA  ", "banco nacional de cuba"),
    ("Banco.Nacional_de@Cuba", "banco nacional de cuba"), ("11,420.2-1 CORP.", "11 420 2 1 corp"), ("Delcy Rodríguez", "delcy rodriguez"), ("Straße Łódź Ærø", "strasse lodz aero"),
    ("a b", "ab"), ("a　b", "a b"), ("x\U0001d400y", "xy"), ("!!!", ""), ("", ""), (None, ""),
]


def test_plain_vectors(spark):
    got = [r[0] for r in spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PLAIN)], "i int, a string").orderBy("i").select(N.plain(F.col("a"))).collect()]
    assert got == [b for _, b in PLAIN]
    assert [S.plain(a) for a, _ in PLAIN] == [b for _, b in PLAIN]


def test_plain_column_is_the_python_reading(spark):
    import random

    rng = random.Random(5)
    pool = "abcXYZ  .,-_'/&éÉøßжЙчñ漢字\t\n  　٣5́​$€"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", N.plain(F.col("a")).alias("p")).collect()
    assert [(r.a, r.p) for r in rows if r.p != S.plain(r.a)] == []


@pytest.mark.parametrize("word,key", [("Robert", "R163"), ("Rupert", "R163"), ("John", "J500"), ("Jon", "J500"), ("Smith", "S530"), ("Smythe", "S530"), ("Pfister", "P236"), ("Ashcraft", "A226"), ("Tymczak", "T522"), ("Honeyman", "H555"), ("1abc", "1120"), ("", "")])
def test_sound_key(spark, word, key):
    assert S.sound_key(word) == key
    assert spark.createDataFrame([(word,)], "w string").select(N.sound_key(F.col("w"))).first()[0] == key


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_scalars(spark):
    assert one(spark, N.phone, "+1 (555) 123-4567") == "15551234567"
    assert one(spark, N.phone, "+44 (0)20 7946 x890") == "44207946x890"
    assert one(spark, N.phone, "+- ") is None
    assert one(spark, N.bare_id, "AB-12 34/x") == "ab1234x"
    assert one(spark, N.gender, " Guy ") == "male" and one(spark, N.gender, None) == "unknown"
    assert one(spark, N.reordered, "SMITH, John Michael") == "John Michael SMITH"
    assert one(spark, N.reordered, "ACME CO., LTD") == "LTD ACME CO."
    assert one(spark, N.without_company_titles, "acme trading company ltd") == "acme trading"
    assert one(spark, N.particle_forms, "jean de la cruz") == ["jean de la cruz", "jean dela cruz", "jean delacruz"]
    assert one(spark, N.particle_forms, "john smith") == ["john smith"]
    assert one(spark, N.title, "Sr. Vice-President, Operations") == "sr vice-president operations"
    assert one(spark, N.expanded_title, "sr vp ops") == "senior vice president ops"
    assert one(spark, N.affiliation_name, "Microsoft Corporation") == "microsoft"
    assert one(spark, N.affiliation_name, "Acme Co Inc") == "acme co"
    assert one(spark, N.without_stopwords, "the bank of america") == "bank america"
    assert one(spark, lambda c: N.language_guess(c)["language"], "Владимир") == "ru"
    assert one(spark, lambda c: N.language_guess(c)["language"], "casa de la moneda") == "es"
    assert one(spark, N.country_aware_language, "nothing special here at all, friends of all", "Spain") == "es"


def test_country_names(spark):
    rows = spark.createDataFrame([("IR",), ("deu",), ("France",), ("UK",), ("Narnia",), ("",), (None,)], "c string")
    got = {r.c: r.n for r in N.with_country_name(rows, "c", "n").collect()}
    assert got == {"IR": "Iran", "deu": "Germany", "France": "France", "UK": "United Kingdom", "Narnia": "Narnia", "": "", None: ""}


LETTERS = "aekoprBHÉéüñłаеорВНкдяοΑΝΣ ｒＡ.,-'\u200b\u00ad\u00a0\u3000"


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=30))
def test_same_look_ignores_spacing(text):
    once = same_look(text)
    assert same_look(text.replace(" ", "  ")) == same_look(f" {text}\u200b ") == once


def test_same_look():
    assert same_look("Klededеs Gebrogre") == same_look("KLEDEDES  gebrogre") == same_look("Ｋlede\u200bdes Gebrogre")
    assert same_look("ВАСЯ") == same_look("вася") != same_look("BACR") and same_look("Mér") != same_look("Mer") and same_look(None) == ""
