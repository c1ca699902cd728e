"""Readers of the four list feeds and of customer requests.

Delimited files are read in splits, as RFC 4180 records: a first pass counts the quotes of every split, so the second knows whether a
split starts inside a quoted field. Every row keeps its place in the file, ``pos``: merged records are folded in that order and it breaks ties of
scores. Rows with too few columns are told by counting the fields of the parsed record, not by null columns, since short rows and
empty fields differ.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..schema import as_entities, part
from ..session import written

BLOCK = 1 << 40


def record_of(text: str, sep: str) -> list[str]:
    """The fields of one record; of a record that a stray quote runs together, those of its first row."""
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])


def fields_of(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(pos, c): the fields of every record.

    pos is ordered by file name, then by place in the file, wherever the folder lies. Splits are read by different tasks. A record that
    ends in a later split is put together from the piece that starts it and the pieces that go on with it, at most two pieces a split;
    all other records are parsed where they are read. Line breaks inside quotes are kept; blank lines are no records.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select(F.make_valid_utf8("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    quotes = lines.select("file", "at", (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).alias("n")).groupBy("file", "at").agg(F.sum("n").alias("n"))
    before = F.expr("sum(n) OVER (PARTITION BY file ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    # one row a split: a file's splits are as many as its bytes over the split size
    splits = quotes.select("file", "at", F.pmod(F.coalesce(before, F.lit(0)), F.lit(2)).cast("int").alias("inside"))
    files = quotes.select("file").distinct().select("file", (F.dense_rank().over(_by_name(F.element_at(F.split("file", "/"), -1), F.col("file"))) - 1).cast("long").alias("no"))
    splits = written(splits.join(files, "file"))
    marked = lines.join(F.broadcast(splits), ["file", "at"]).select("no", "at", "inside", "line")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["no", "pos", "kind", "c", "piece"]
        now, held, first, number, odd = None, [], None, 0, False
        out: list[tuple] = []

        def close(whole: bool) -> None:
            """What is held: a record, the end of an earlier split's record (kind 0), or the start of one that goes on (kind 2)."""
            if not held:
                return
            text = "\n".join(held)
            if first is None:
                out.append((now[0], now[1], 0, None, ("+" if whole else "-") + text))
            elif whole:
                text = text.removesuffix("\r")
                if text:
                    out.append((now[0], first, 1, record_of(text, sep), None))
            else:
                out.append((now[0], first, 2, None, text))
            held.clear()

        for pdf in batches:
            for no, at, inside, line in zip(pdf["no"], pdf["at"], pdf["inside"], pdf["line"], strict=True):
                if (no, at) != now:
                    close(False)
                    now, number, odd, first = (no, at), 0, bool(inside), None
                    if at == 0:
                        line = line.removeprefix("\ufeff")
                if not held:
                    first = None if odd and number == 0 else at + number
                held.append(line)
                number += 1
                odd ^= line.count('"') % 2 == 1
                if not odd:
                    close(True)
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=columns)
                out = []
        close(False)
        yield pd.DataFrame(out, columns=columns)

    read = written(marked.mapInPandas(parse, "no long, pos long, kind int, c array<string>, piece string"))
    whole = read.where("kind = 1").select((F.col("no") * F.lit(BLOCK) + F.col("pos")).alias("pos"), "c")

    def mend(pdf: pd.DataFrame) -> pd.DataFrame:
        out, start, text = [], None, []
        for pos, kind, piece in zip(*[x.tolist() for _, x in pdf.sort_values(["pos", "kind"])[["pos", "kind", "piece"]].items()], strict=True):
            if kind == 2:
                if start is not None:
                    out.append((start, "\n".join(text)))
                start, text = pos, [piece]
            elif start is not None:
                text.append(piece[1:])
                if piece[0] == "+":
                    out.append((start, "\n".join(text)))
                    start, text = None, []
        if start is not None:
            out.append((start, "\n".join(text)))
        base = int(pdf["no"].iloc[0]) * BLOCK
        return pd.DataFrame([(base + p, record_of(t.removesuffix("\r"), sep)) for p, t in out], columns=["pos", "c"])

    # at most two pieces a split, so a file's pieces are few
    return whole.union(read.where("kind <> 1").groupBy("no").applyInPandas(mend, "pos long, c array<string>"))


def _by_name(*order: Column):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(*order)  # one row a file


def cell(k: int) -> Column:
    return F.coalesce(F.trim(F.get("c", F.lit(k))), F.lit(""))


def unmarked(c: Column) -> Column:
    """"" for markers of null; a leading marker is dropped."""
    t = F.coalesce(F.trim(c), F.lit(""))
    return F.when(F.lower(t).isin("-0-", "null"), "").otherwise(F.trim(F.regexp_replace(t, "^-0-\\s*", "")))


def split_clean(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def ofac_type(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return (
        F.when(c.isNull(), "UNKNOWN").when(low == "", "BUSINESS").when(low == "individual", "PERSON").when(low == "entity", "BUSINESS")
        .when(low == "vessel", "VESSEL").when(low == "aircraft", "AIRCRAFT").otherwise("UNKNOWN")
    )


def numbered(df: DataFrame) -> DataFrame:
    """index_pos in file order. Numbers need not be dense, so no global window is needed."""
    return df.withColumn("index_pos", F.col("pos"))


def read_ofac(spark: SparkSession, sdn: str, addresses: str | None = None, alt_names: str | None = None) -> DataFrame:
    """Entities of the three-file feed; without side files they have no addresses and alternative names."""
    ident = unmarked(F.get("c", F.lit(0)))
    main = fields_of(spark, sdn).where(F.size("c") >= 12).withColumn("key", ident).withColumn("name", unmarked(F.get("c", F.lit(1))))
    main = main.where((F.col("key") != "") & (F.col("name") != "") & ~F.lower("key").contains("ent_num") & ~F.col("key").rlike("[_ ]"))
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x["v"])
    if addresses:
        side = fields_of(spark, addresses).where(F.size("c") >= 6).withColumn("key", ident).where((F.col("key") != "") & ~F.col("key").rlike("[_ ]"))
        place = F.split(unmarked(F.get("c", F.lit(3))), ",")
        bit = lambda k: F.trim(F.coalesce(F.get(place, F.lit(k)), F.lit("")))
        one = F.struct(unmarked(F.get("c", F.lit(2))).alias("line1"), F.lit(None).cast("string").alias("line2"), bit(0).alias("city"), bit(1).alias("state"), F.lit("").alias("postal_code"), unmarked(F.get("c", F.lit(4))).alias("country"))
        main = main.join(side.groupBy("key").agg(ordered(one.alias("v")).alias("addresses")), "key", "left")
    if alt_names:
        side = fields_of(spark, alt_names).where(F.size("c") >= 5).withColumn("key", ident).withColumn("v", unmarked(F.get("c", F.lit(3)))).where((F.col("key") != "") & (F.col("v") != "") & ~F.col("key").rlike("[_ ]"))
        main = main.join(side.groupBy("key").agg(ordered("v").alias("alt_names")), "key", "left")
    none = F.array().cast("array<string>")
    alts = F.coalesce("alt_names", none) if alt_names else none
    addrs = F.coalesce(F.col("addresses"), F.array().cast("array<struct<line1:string,line2:string,city:string,state:string,postal_code:string,country:string>>")) if addresses else F.array()
    c = lambda k: unmarked(F.get("c", F.lit(k)))
    kind = ofac_type(c(2))
    return as_entities(
        numbered(main), index_pos=F.col("index_pos"), id=F.col("key"), name=F.col("name"), entity_type=kind, source=F.lit("US_OFAC"), source_id=F.col("key"), alt_names=alts, addresses=addrs, remarks=c(11),
        person=F.when(kind == "PERSON", part("person", name=F.col("name"), alt_names=none, titles=none, government_ids=F.array())), business=F.when(kind == "BUSINESS", part("business", name=F.col("name"), alt_names=none, government_ids=F.array())),
        vessel=F.when(kind == "VESSEL", part("vessel", name=F.col("name"), alt_names=alts, call_sign=c(5), type=c(6), tonnage=c(7), flag=c(9), owner=c(10))),
        aircraft=F.when(kind == "AIRCRAFT", part("aircraft", name=F.col("name"), alt_names=alts, type=c(6), flag=c(9), icao_code=c(5))),
        sanctions=F.struct(split_clean(c(3), "[;\\s]+").alias("programs"), F.lit(False).alias("secondary"), F.lit(None).cast("string").alias("description")),
        crypto_addresses=F.array(), government_ids=F.array(), historical=F.array(),
    )


def csl_type(kind: Column, source: Column, name: Column) -> Column:
    low, where = F.lower(kind), F.lower(source)
    business = F.exists(F.array(*[F.lit(x) for x in W.COMPANY_NEEDLES]), lambda x: F.contains(F.lower(name), x))
    return (
        F.when(low == "individual", "PERSON").when(low == "vessel", "VESSEL").when(low == "aircraft", "AIRCRAFT")
        .when(low == "entity", F.when(where.contains("military-industrial") | where.contains("cmic"), "ORGANIZATION").otherwise("BUSINESS"))
        .when(business, "BUSINESS").otherwise("UNKNOWN")
    )


def read_csl(spark: SparkSession, path: str) -> DataFrame:
    """Entities of the combined list of at least 29 columns."""
    rows = numbered(fields_of(spark, path).where((F.size("c") >= 29) & (F.lower(cell(0)) != "_id") & (cell(5) != "")))
    kind, name = csl_type(cell(3), cell(1), cell(5)), cell(5)
    alts, programs = split_clean(cell(22), ";"), split_clean(cell(4), ";")
    bit = lambda x, k: F.trim(F.coalesce(F.get(F.split(x, ","), F.lit(k)), F.lit("")))
    none = F.lit(None).cast("string")
    addrs = F.transform(split_clean(cell(7), ";"), lambda x: F.struct(bit(x, 0).alias("line1"), none.alias("line2"), bit(x, 1).alias("city"), none.alias("state"), none.alias("postal_code"), bit(x, 2).alias("country")))
    return as_entities(
        rows, index_pos=F.col("index_pos"), id=cell(0), name=name, entity_type=kind, source=F.lit("US_CSL"), source_id=cell(0), alt_names=alts, addresses=addrs, remarks=cell(20),
        person=F.when(kind == "PERSON", part("person", name=name, alt_names=alts, titles=F.array(), government_ids=F.array())), business=F.when(kind == "BUSINESS", part("business", name=name, alt_names=alts)),
        organization=F.when(kind == "ORGANIZATION", part("organization", name=name, alt_names=alts, government_ids=F.array())),
        vessel=F.when(kind == "VESSEL", part("vessel", name=name, alt_names=alts, type=cell(15), flag=cell(18), call_sign=cell(14), tonnage=cell(16), owner=cell(19))),
        aircraft=F.when(kind == "AIRCRAFT", part("aircraft", name=name, alt_names=alts, type=cell(15), flag=cell(18), icao_code=cell(14))),
        sanctions=F.struct(programs.alias("programs"), F.lit(False).alias("secondary"), none.alias("description")), crypto_addresses=F.array(), government_ids=F.array(), historical=F.array(),
    )


def folded(rows: DataFrame) -> DataFrame:
    """One row a key: distinct names and addresses in order of first sight, the last remark and place of birth that aren't empty, the first kind.

    rows: (key, pos, name, address, remark, kind, place). Repeats are dropped map-side before a key's rows meet.
    """
    names = rows.where("name <> ''").groupBy("key", "name").agg(F.min("pos").alias("p")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "name"))), lambda x: x["name"]).alias("names"))
    places = rows.where("address IS NOT NULL").groupBy("key", "address").agg(F.min("pos").alias("p")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "address"))), lambda x: x["address"]).alias("addresses"))
    rest = rows.groupBy("key").agg(F.min("pos").alias("index_pos"), *[F.max_by(x, F.when(F.col(x) != "", F.col("pos"))).alias(x) for x in ("remark", "place")], F.min_by("kind", "pos").alias("kind"))
    return rest.join(names, "key").join(places, "key", "left")


def _grouped_entities(df: DataFrame, kind: Column, source: str, program: str) -> DataFrame:
    name = F.get("names", F.lit(0))
    alts = F.slice("names", 2, 1 << 30)
    address = "array<struct<line1:string,line2:string,city:string,state:string,postal_code:string,country:string>>"
    return as_entities(
        df, index_pos=F.col("index_pos"), id=F.col("key"), name=name, entity_type=kind, source=F.lit(source), source_id=F.col("key"), alt_names=alts, addresses=F.coalesce("addresses", F.array().cast(address)), remarks=F.coalesce("remark", F.lit("")),
        person=F.when(kind == "PERSON", part("person", name=name, alt_names=alts, place_of_birth=F.col("place"), titles=F.array(), government_ids=F.array())), business=F.when(kind == "BUSINESS", part("business", name=name, alt_names=alts)),
        vessel=F.when(kind == "VESSEL", part("vessel", name=name, alt_names=alts)), sanctions=F.struct(F.array(F.lit(program)).alias("programs"), F.lit(False).alias("secondary"), F.lit(None).cast("string").alias("description")),
        crypto_addresses=F.array(), government_ids=F.array(), historical=F.array(),
    )


def _address(line1: Column, city: Column, postal: Column, country: Column) -> Column:
    none = F.lit(None).cast("string")
    there = (line1 != "") | (city != "") | (country != "")
    return F.when(there, F.struct(line1.alias("line1"), none.alias("line2"), city.alias("city"), none.alias("state"), postal.alias("postal_code"), country.alias("country")))


def read_eu(spark: SparkSession, path: str) -> DataFrame:
    """Entities of the semicolon list of at least 68 columns, one for each numeric id that has a name."""
    rows = fields_of(spark, path, ";").where((F.size("c") >= 68) & cell(1).rlike("^[0-9]+$"))
    rows = rows.select(cell(1).alias("key"), "pos", cell(19).alias("name"), _address(cell(35), cell(34), cell(37), cell(43)).alias("address"), cell(6).alias("remark"), cell(8).alias("kind"), cell(65).alias("place"))
    kind = F.when(F.lower("kind") == "person", "PERSON").otherwise("UNKNOWN")
    return _grouped_entities(folded(rows), kind, "EU_CSL", "EU")


def read_uk(spark: SparkSession, path: str) -> DataFrame:
    """Entities of the list of at least 30 columns, one for each group id that has a name."""
    rows = fields_of(spark, path).where((F.size("c") >= 30) & (cell(29) != "") & (F.lower(cell(29)) != "group id") & (F.lower(cell(24)) != "group type"))
    joined = lambda sep, ks: F.concat_ws(sep, *[F.nullif(cell(k), F.lit("")) for k in ks])
    line = joined(", ", range(15, 21))
    none = F.lit(None).cast("string")
    there = (line != "") | (cell(21) != "") | (cell(22) != "")
    address = F.when(there, F.struct(line.alias("line1"), none.alias("line2"), none.alias("city"), none.alias("state"), cell(21).alias("postal_code"), cell(22).alias("country")))
    rows = rows.select(cell(29).alias("key"), "pos", joined(" ", range(6)).alias("name"), address.alias("address"), cell(23).alias("remark"), cell(24).alias("kind"), cell(9).alias("place"))
    low = F.lower("kind")
    kind = F.when(low == "individual", "PERSON").when(low == "ship", "VESSEL").when(low == "entity", "BUSINESS").otherwise("UNKNOWN")
    return _grouped_entities(folded(rows), kind, "UK_CSL", "UK")


def read_lists(spark: SparkSession, paths: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """All lists of the mapping from source to file (three files for US_OFAC); other sources have no entities."""
    readers = {"US_OFAC": lambda p: read_ofac(spark, *((p,) if isinstance(p, str) else p)), "US_CSL": lambda p: read_csl(spark, p), "EU_CSL": lambda p: read_eu(spark, p), "UK_CSL": lambda p: read_uk(spark, p)}
    out = None
    for k, (source, p) in enumerate(paths.items()):
        if source in readers:
            one = readers[source](p).withColumn("index_pos", F.col("index_pos") + F.lit(k) * F.lit(BLOCK) * F.lit(1 << 20))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], as_entities(spark.range(0)).schema)


def read_requests(spark: SparkSession, path: str, chunk: int = 1000) -> DataFrame:
    """Customer requests, one JSON object a line, spread over as many partitions as there are chunks of the given size."""
    rows = spark.read.schema("request_id string, name string, entity_type string, source string").json(path)
    return rows.repartition(max(1, -(-rows.count() // chunk)))
