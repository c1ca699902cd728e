"""Comparers: exact vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lynceus.functions import compare as C
from lynceus.functions import normalize as N

DATES = [("1970-01-01", "1970-01-01", 1.0), ("1970-01-01", "1970-01-03", 0.975), ("1970-01-05", "1970-12-05", 0.91), ("1970-06-12", "1970-06-21", 0.91), ("1970-01-01", "1970-02-11", 0.88), ("1970-06-01", "1980-06-01", 0.68), ("1970-06-15", "1973-08-15", 0.67)]


def test_dates(spark):
    rows = spark.createDataFrame([(i, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for i, (a, b, _) in enumerate(DATES)], "i int, a date, b date")
    got = [r[0] for r in rows.orderBy("i").select(C.date_score(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([s for *_, s in DATES], abs=1e-9)
    days = spark.createDataFrame([(1, 11), (2, 22), (12, 21), (24, 42), (1, 15)], "a int, b int").select(C.days_alike(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in days] == [True, True, True, True, False]
    d = lambda x: F.to_date(F.lit(x))
    r = spark.range(1).select(C.person_dates(d("1950-01-01"), d("2000-01-01"), d("1950-01-01"), d("1960-01-01")), C.date_score(F.lit(None).cast("date"), d("2000-01-01")), C.asset_dates(F.lit("1999"), F.lit("1999-01-01"))).first()
    assert r[0]["score"] == pytest.approx((1.0 + (0.4 * 0.2 + 0.6)) / 2 * 0.5) and not r[0]["matched"]
    assert r[1] == 0.0 and r[2]["score"] == 1.0


IDS = "array<struct<id_type:string,identifier:string,country:string>>"


def ids(*rows):
    return [dict(zip(("id_type", "identifier", "country"), r, strict=True)) for r in rows]


def test_identifiers(spark):
    cases = [
        (ids(("PASSPORT", "AB-12", "Iran")), ids(("PASSPORT", "ab12", "Iran")), 1.0, 1.0, 0.0), (ids(("PASSPORT", "AB12", None)), ids(("PASSPORT", "AB12", "Iran")), 0.0, 1.0, 0.9), (ids((None, "X1", None)), ids(("TAX", "x1", None)), 0.0, 1.0, 1.0),
        (ids(("T", "X1", "A")), ids(("T", "X1", "B")), 0.0, 1.0, 0.7), (None, ids(("T", "X1", "B")), 0.0, 0.0, 0.0), ([], [], 0.0, 0.0, 0.0),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], f"i int, a {IDS}, b {IDS}").orderBy("i")
    got = [tuple(r) for r in rows.select(C.exact_ids(F.col("a"), F.col("b")), C.live_gov_id(F.col("a"), F.col("b")), C.gov_ids_with_country(F.col("a"), F.col("b"))).collect()]
    assert got == [tuple(c[2:]) for c in cases]


def test_totals(spark):
    f = lambda **k: {x: F.lit(float(k.get(x, 0))) for x in ("name", "alt_names", "address", "gov_id", "crypto", "contact", "date")}
    r = spark.range(1).select(C.factor_total(f(name=1.0), source_id_differs=F.lit(True)), C.factor_total(f(name=0.5, gov_id=1.0)), C.factor_total(f(name=0.8, address=0.5, date=1.0)), C.affiliations_score(F.array(F.lit(1.0), F.lit(0.5)))).first()
    assert list(r) == pytest.approx([35 / 85, 0.85, (0.8 * 35 + 0.5 * 25 + 15) / 75, (1 + 0.125) / 1.25])


def test_addresses_and_titles(spark):
    a = "struct<line1:string,line2:string,city:string,state:string,postal_code:string,country:string>"
    row = ("12 Main St.", None, "Havana", "", "10", "Cuba")
    rows = spark.createDataFrame([([row], [row]), ([row], []), (None, None)], f"q array<{a}>, i array<{a}>")
    s = lambda c: F.transform(c, N.scored_address)
    assert [r[0] for r in rows.select(C.address_list_score(s("q"), s("i"))).collect()] == [1.0, 0.0, 0.0]
    assert rows.select(C.live_address_column("q", "i")).first()[0] == 1.0
    assert C.title_pair_score("chief officer", "chief officer") == 1.0 and C.title_pair_score("", "x") == 0.0
    kinds = spark.createDataFrame([("Owned by", "owner"), ("owned by", "OWNED BY"), ("led by", "owner"), (None, "x")], "a string, b string")
    assert [r[0] for r in kinds.select(C.affiliation_kind_score(F.col("a"), F.col("b"))).collect()] == [0.8, 1.0, 0.0, 0.0]
