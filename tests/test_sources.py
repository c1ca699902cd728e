"""Readers on inline files, from parse to search."""

import pytest

from lynceus.operators import index as I
from lynceus.operators import search
from lynceus.operators.merge import merge_entities
from lynceus.operators.prepare import with_prepared
from lynceus.session import written
from lynceus.sources import feeds

SDN = """Ent_num,SDN_Name,SDN_Type,Program,Title,Call_Sign,Vess_type,Tonnage,GRT,Vess_flag,Vess_owner,Remarks
36,"AEROCARIBBEAN AIRLINES","Entity"," CUBA",,,,,,,,"-0- Calle 23 No 64, Vedado, Havana, Cuba."
7140,"MADURO MOROS, Nicolas","individual"," VENEZUELA; X Y",,,,,,,,
15036,"PEGAS","vessel"," RUSSIA-EO14024","","UBKQ9","Crude Oil Tanker","","106413","Russia","PAO SOVCOMFLOT","IMO 9333756"
40,"QUOTED ""NAME""
OVER LINES","-",x,,,,,,,,
41,"MARKED","-0-",x,,,,,,,,
77,"SHORT ROW"
"""


@pytest.fixture(scope="module")
def ofac(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("ofac")
    (d / "sdn.csv").write_text(SDN)
    (d / "add.csv").write_text('36,1,"Calle 23 No 64, Vedado","Havana, HA","Cuba",""\n36,2,"five columns","Havana","Cuba"\n')
    (d / "alt.csv").write_text('7140,1,"a.k.a.","Nicolas MADURO",""\n7140,2,"a.k.a.","N. MADURO",""\n')
    return written(feeds.read_ofac(spark, *[str(d / f"{x}.csv") for x in ("sdn", "add", "alt")]))


def test_ofac(ofac):
    rows = {r.id: r for r in ofac.collect()}
    assert {k: r.entity_type for k, r in rows.items()} == {"36": "BUSINESS", "7140": "PERSON", "15036": "VESSEL", "40": "UNKNOWN", "41": "BUSINESS"}
    assert rows["15036"].vessel.call_sign == "UBKQ9" and rows["15036"].vessel.flag == "Russia"
    assert rows["7140"].alt_names == ["Nicolas MADURO", "N. MADURO"] and rows["7140"].sanctions.programs == ["VENEZUELA", "X", "Y"]
    a = rows["36"].addresses[0]
    assert len(rows["36"].addresses) == 1
    assert (a.line1, a.line2, a.city, a.state, a.postal_code, a.country) == ("Calle 23 No 64, Vedado", None, "Havana", "HA", "", "Cuba")
    assert rows["36"].remarks.startswith("Calle 23") and rows["40"].name == 'QUOTED "NAME"\nOVER LINES'
    pos = [r.id for r in sorted(rows.values(), key=lambda r: r.index_pos)]
    assert pos == ["36", "7140", "15036", "40", "41"]


def test_csl(spark, tmp_path):
    row = lambda i, kind, source, name: ",".join([i, source, "1", kind, "SDGT; X", f'"{name}"', "", '"1 Road, Minsk, BY, extra; 2 Way"', *[""] * 6, "CALL", "Tanker", "9", "", "Iran", "Owner", "rem", "", "a; b ;", *[""] * 6])
    (tmp_path / "csl.csv").write_text("\n".join(["_id" + "," * 28, row("1", "individual", "s", "A"), row("2", "entity", "Chinese Military-Industrial", "B"), row("3", "", "s", "Golden Trading"), row("4", "other", "s", "Someone"), row("5", "Vessel", "s", "Ship"), "6,short"]))
    rows = {r.id: r for r in feeds.read_csl(spark, str(tmp_path / "csl.csv")).collect()}
    assert {k: r.entity_type for k, r in rows.items()} == {"1": "PERSON", "2": "ORGANIZATION", "3": "BUSINESS", "4": "UNKNOWN", "5": "VESSEL"}
    assert rows["1"].alt_names == ["a", "b"] and [x.city for x in rows["1"].addresses] == ["Minsk", ""] and rows["1"].addresses[0].country == "BY"
    assert rows["5"].vessel.call_sign == "CALL" and rows["2"].organization.name == "B"


def test_eu_and_uk_fold_rows(spark, tmp_path):
    def eu(i, name="", remark="", kind="P", city="", street="", country="", place=""):
        c = [""] * 90
        c[1], c[6], c[8], c[19], c[34], c[35], c[43], c[65] = i, remark, kind, name, city, street, country, place
        return ";".join(c)

    (tmp_path / "eu.csv").write_text("\n".join([eu("EntityLogicalId", "NameAlias_WholeName"), eu("13", "First", "r1", "person"), eu("13", "Second", "", "x", "Kabul", "", "AF", "Herat"), eu("13", "First", "r2"), eu("14", ""), eu("15", "Firm", kind="enterprise"), "1;2"]))
    rows = {r.id: r for r in feeds.read_eu(spark, str(tmp_path / "eu.csv")).collect()}
    assert set(rows) == {"13", "15"}
    assert (rows["13"].name, rows["13"].alt_names, rows["13"].remarks, rows["13"].entity_type, rows["13"].person.place_of_birth) == ("First", ["Second"], "r2", "PERSON", "Herat")
    assert rows["15"].entity_type == "UNKNOWN" and rows["13"].sanctions.programs == ["EU"]

    def uk(i, names=("",), kind="Individual", addr=(), post="", country="", info=""):
        c = [""] * 30
        c[: len(names)] = names
        c[15 : 15 + len(addr)] = addr
        c[21], c[22], c[23], c[24], c[29] = post, country, info, kind, i
        return ",".join(c)

    (tmp_path / "uk.csv").write_text("\n".join([uk("Group ID", kind="Group Type"), uk("7", ("AL", "", "John"), addr=("1 Road", "", "Town"), post="X1", country="UK", info="i1"), uk("7", ("Johnny",), info="i2"), uk("8", ("Boat",), "Ship"), uk("9", ("Firm",), "Entity"), uk("10")]))
    rows = {r.id: r for r in feeds.read_uk(spark, str(tmp_path / "uk.csv")).collect()}
    assert {k: r.entity_type for k, r in rows.items()} == {"7": "PERSON", "8": "VESSEL", "9": "BUSINESS"}
    assert (rows["7"].name, rows["7"].alt_names, rows["7"].remarks, rows["7"].addresses[0].line1) == ("AL John", ["Johnny"], "i2", "1 Road, Town")
    both = feeds.read_lists(spark, {"EU_CSL": str(tmp_path / "eu.csv"), "UK_CSL": str(tmp_path / "uk.csv"), "NOWHERE": "x"})
    assert both.count() == 5 and feeds.read_lists(spark, {}).count() == 0


def test_search_and_batch(spark, ofac):
    top = search.name_search(ofac, "Nicolas Maduro", 0.8).collect()
    assert [r.id for r in top] == ["7140"] and top[0].score == 1.0
    assert search.name_search(ofac, "pegas", 0.9, source="nonsense").count() == 1
    assert search.name_search(ofac, "pegas", 0.9, entity_type="person").count() == 0
    with pytest.raises(search.BadRequest):
        search.name_search(ofac, "  ", 0.5)
    req = spark.createDataFrame([(0, "r", "Nicolas Maduro", None, None), (1, "r", " ", None, None), (2, "r", None, None, None), (3, "r", "PEGAS", "vessel", "us_ofac"), (4, "r", "PEGAS", "PERSON", None)], "item_pos long, request_id string, name string, entity_type string, source string")
    out = {r.item_pos: r for r in search.batch(req, ofac).collect()}
    assert [out[k].status for k in range(5)] == ["SUCCESS", "NO_MATCHES", "NO_MATCHES", "SUCCESS", "NO_MATCHES"]
    with pytest.raises(search.BadRequest):
        search.batch(req.limit(0), ofac)
    with pytest.raises(search.BadRequest):
        search.batch(req, ofac, most=3)
    prepared = with_prepared(ofac)
    assert search.name_search(prepared, "aerocaribbean airlines", 0.9, mode="prepared").first().id == "36"
    assert with_prepared(prepared).select("prepared").collect() == prepared.select("prepared").collect()


def test_index(spark, ofac):
    ix = I.Index(spark)
    assert ix.size() == 0
    ix.replace(ofac)
    ix.add(None)
    ix.add(ofac)
    assert ix.size() == 10 and I.by_id(ix.table, "36").count() == 1
    assert ix.remove("36") and not ix.remove("36") and ix.size() == 8
    assert I.by_source(ix.table, None).count() == 0 and I.by_type(ix.table, "VESSEL").count() == 2
    assert {r.source: r.n for r in I.list_info(ix.table).collect()} == {"US_OFAC": 8, "US_CSL": 0, "US_NON_SDN": 0, "EU_CSL": 0, "UK_CSL": 0}
    ix.clear()
    assert ix.size() == 0


def test_merge(spark, ofac):
    from pyspark.sql import functions as F

    more = ofac.withColumn("name", F.concat("name", F.lit(" II"))).withColumn("index_pos", F.col("index_pos") + 100).withColumn("remarks", F.lit("later"))
    rows = {r.id: r for r in merge_entities(ofac.unionByName(more)).collect()}
    assert len(rows) == 5
    assert rows["7140"].name == "MADURO MOROS, Nicolas" and rows["7140"].person.alt_names == ["MADURO MOROS, Nicolas II"] and rows["7140"].remarks == "later"
    assert rows["36"].remarks.startswith("Calle") and len(rows["36"].addresses) == 1 and rows["7140"].prepared.name == "nicolas maduro moros"
    assert merge_entities(ofac.limit(0)).count() == 0


def test_records_are_read_in_splits(spark, tmp_path):
    """One large file in several tasks, quoted line breaks across their borders; files in order of their names, wherever the folder lies."""
    import csv
    import io
    import random

    rng = random.Random(1)
    rows = [[str(i), *["".join(rng.choice('ab,"\n \u00e9\r\n') for _ in range(rng.randint(0, 30))) for _ in range(3)]] for i in range(1200)]
    rows[600][1] = "long\n" * 3000

    def dump(folder, name, some, end):
        b = io.StringIO(newline="")
        csv.writer(b, lineterminator=end).writerows(some)
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(("\ufeff" + b.getvalue()).encode())

    for folder in ("one", "two"):
        dump(tmp_path / folder, "part-0.csv", rows[:800], "\r\n")
        dump(tmp_path / folder, "part-1.csv", rows[800:], "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "one")).rdd.getNumPartitions() > 8
        got = [[(r.pos, list(r.c)) for r in feeds.fields_of(spark, str(tmp_path / f)).orderBy("pos").collect()] for f in ("one", "two")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [c for _, c in got[0]] == rows and got[0] == got[1]
    (tmp_path / "empty.csv").write_text("")
    assert feeds.fields_of(spark, str(tmp_path / "empty.csv")).count() == 0


def test_traces(spark, ofac):
    """A trace scores the winners again; a single search keeps its order, a batch filters and ranks anew; a failing name has its own row."""
    from lynceus.config import Weights
    from lynceus.functions import similarity as S
    from lynceus.operators import trace

    results, events = trace.traced_search(ofac, "nicolas maduro", 0.8)
    r = results.first()
    assert r.id == "7140" and r.score == r.breakdown.total == 1.0 and events.count() == 9 * results.count()
    off, fewer = trace.traced_search(ofac, "nicolas maduro", 0.8, weights=Weights(use_alt_names=False))
    assert off.first().score < 0.9 and fewer.count() == 8
    req = spark.createDataFrame([(0, "r", "Nicolas Maduro", None, None), (1, "r", "PEGAS", None, None), (2, "r", "PEGAS X", None, None), (3, "r", None, None, None)], "item_pos long, request_id string, name string, entity_type string, source string")

    def scorer(a, b, config):
        if a == "pegas x":
            raise ValueError("no score")
        return S.read_name_score(a, b, config)

    out, _ = trace.traced_batch(req, ofac, weights=Weights(use_alt_names=False), scorer=scorer)
    got = {x.item_pos: (x.status, x.error) for x in out.collect()}
    assert got == {0: ("NO_MATCHES", None), 1: ("SUCCESS", None), 2: ("ERROR", "no score"), 3: ("NO_MATCHES", None)}
    asked = req.selectExpr("item_pos", "name", "CASE WHEN item_pos = 1 THEN 'Calle 23 No 64' ELSE 'Havana' END AS address", "CAST(NULL AS string) AS source_f", "CAST(NULL AS string) AS type_f")
    found = {(x.item_pos, x.index_pos) for x in trace.address_screen(asked, ofac, 0.55).collect()}
    assert any(p == 1 for p, _ in found) and trace.address_screen(asked.limit(0), ofac).count() == 0
