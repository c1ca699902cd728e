"""Comparisons of whole entities as pieces, coverage, importance, reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lynceus.functions import compare as C
from lynceus.operators import report as R
from lynceus.operators import scoring
from lynceus.operators.prepare import with_prepared
from lynceus.schema import as_entities, part


def pair(spark):
    df = spark.createDataFrame([(0, "john smith", dt.date(1970, 1, 1)), (1, "John Smith", dt.date(1970, 1, 3))], "pos long, n string, born date")
    ids = F.array(F.struct(F.lit("PASSPORT").alias("id_type"), F.lit("A-1").alias("identifier"), F.lit("Cuba").alias("country")))
    e = as_entities(
        df, index_pos=F.col("pos"), id=F.col("pos"), name=F.col("n"), entity_type=F.lit("PERSON"), source=F.lit("US_OFAC"), alt_names=F.array(F.lit("jack smith")), addresses=F.array(), crypto_addresses=F.array(), government_ids=F.array(),
        person=part("person", name=F.col("n"), birth_date=F.col("born"), titles=F.array(F.lit("chief officer")), government_ids=ids), contact=F.struct(F.lit("A@b.c").alias("email"), F.lit("").alias("phone"), F.lit(None).cast("string").alias("fax"), F.lit(None).cast("string").alias("website")),
        sanctions=F.struct(F.array(F.lit("SDGT"), F.lit("X")).alias("programs"), (F.col("pos") == 1).alias("secondary"), F.lit(None).cast("string").alias("description")), historical=F.array(F.struct(F.lit("Former Name").alias("type"), F.lit("john smyth").alias("value"), F.lit(None).cast("date").alias("date"))),
    )
    wide = with_prepared(e).select(F.struct(*e.columns).alias("e"))
    return wide.where("e.index_pos = 0").select(F.col("e").alias("q"), F.lit(1).alias("k")).join(wide.where("e.index_pos = 1").select(F.col("e").alias("i"), F.lit(1).alias("k")), "k")


def test_pieces(spark):
    r = scoring.with_pieces(pair(spark)).first()
    p = {x.kind: x for x in r.pieces}
    assert p["name"].score == 1.0 and p["name"].fields == 2
    assert p["identifiers"].exact and p["gov-ids-exact"].score == 1.0
    assert p["contact-exact"].score == 1.0 and p["contact-exact"].fields == 1
    assert p["dates"].score == pytest.approx(0.4 + 0.3 + 0.3 * (0.95 - 0.05 * 2 / 3)) and p["dates"].matched
    assert p["address"].fields == 0 and p["title-fuzzy"].score == 1.0 and p["crypto-exact"].score == 0.0
    assert p["supporting"].score == pytest.approx((0.8 + 1.0) / 2) and p["source"].matched
    # birth date, titles, ids | name, source, e-mail, alternative names
    assert r.coverage.ratio == pytest.approx(sum(x.fields for x in r.pieces) / 7) and r.coverage.critical_ratio == 1.0
    assert r.importance.has_name and r.importance.has_id and r.importance.has_critical and not r.importance.has_address and r.importance.required == 4


def test_affiliations(spark):
    t = "array<struct<entity_name:string,type:string>>"
    df = spark.createDataFrame([([("Acme Corporation", "owned by")], [("acme inc", "subsidiary of"), ("Other", "owned by")]), ([], [("a", "b")]), (None, None)], f"q {t}, i {t}")
    rows = [r[0] for r in df.select(scoring.affiliation_piece(F.col("q"), F.col("i"))).collect()]
    assert rows[0].score == pytest.approx(1.0) and rows[0].matched and rows[1].score == 0.0 and rows[2].score == 0.0 and rows[1].fields == 0
    assert C.best_title(["a b", "vice president"], ["vice president"]) == 1.0 and C.best_title(None, []) == 0.0


def test_reports(spark):
    b = scoring.breakdown(pair(spark)).withColumn("text", R.short_explained(F.col("breakdown"))).withColumn("debug", R.debug_text(F.col("q"), F.col("i"), F.col("breakdown")))
    r = b.first()
    assert r.text.startswith("Strong match: Name 100%") or r.text.startswith("Good match: Name 100%")
    assert "  Name Score:       1.0000\n" in r.debug and "Query: john smith (PERSON)" in r.debug
    events = spark.createDataFrame([("s", "AGGREGATION", 5), ("s", "NAME_COMPARISON", 20), ("s", "AGGREGATION", 7), ("t", "NORMALIZATION", 1)], "session_id string, phase string, duration_ms long")
    out = {x.session_id: x for x in R.report_summary(events, b.select(F.lit("s").alias("session_id"), "breakdown")).collect()}
    assert out["s"].entities_scored == 2 and out["s"].slowest_phase == "NAME_COMPARISON" and out["s"].phase_ms == {"AGGREGATION": 12, "NAME_COMPARISON": 20} and out["s"].average_score == r.breakdown.total
    assert out["t"].average_score == 0.0 and out["t"].contributions is None or out["t"].contributions == {}
    s = {x.session_id: x for x in R.trace_summary(events).collect()}
    assert s["s"].slowest_phase == "NAME_COMPARISON" and s["t"].slowest_phase is None
    traces = R.Traces(events)
    traces.put(events.where("session_id = 't'"))
    traces.delete("s")
    assert traces.get("t").count() == 2 and traces.get("s").count() == 0
    hits = b.select(F.col("q.id").alias("id"), F.col("breakdown.total").alias("score"))
    assert '"requestID":"r1"' in R.as_json(hits, "r1").first()[0]
