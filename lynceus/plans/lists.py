"""Queries that run the readers, the index and the merge over whole tables: records are written in each feed's format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import index as I
from ..operators.merge import merge_entities
from ..schema import as_entities, part
from ..session import table, written, written_lines
from ..sources import feeds


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def _file(rows: DataFrame, width: int, cells: dict[int, Column], order: list[str], sep: str = ",") -> str:
    """Rows as lines of a delimited feed, sorted, so that files in order of their names are in that order."""
    line = F.concat_ws(sep, *[_quoted(cells[k]) if k in cells else F.lit("") for k in range(width)])
    return written_lines(rows.orderBy(*order).select(line.alias("value")))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select("record_id", "name", "alt_names", "entity_type", "source_list", "source_id", "birth_date", "government_ids", "addresses", "programs", "remarks")


def ofac_files(e: DataFrame) -> tuple[str, str, str]:
    main = _file(e, 12, {0: F.col("record_id"), 1: F.col("name"), 2: F.col("entity_type"), 3: F.col("programs"), 11: F.col("remarks")}, ["record_id"])
    a = e.select("record_id", F.posexplode("addresses").alias("k", "a"))
    side = _file(a, 6, {0: F.col("record_id"), 1: F.col("k"), 2: F.col("a.line1"), 3: F.concat_ws(", ", "a.city", "a.state", "a.postal_code"), 4: F.col("a.country")}, ["record_id", "k"])
    n = e.select("record_id", F.posexplode("alt_names").alias("k", "n"))
    return main, side, _file(n, 5, {0: F.col("record_id"), 1: F.col("k"), 2: F.lit("a.k.a."), 3: F.col("n")}, ["record_id", "k"])


def _told(e: DataFrame) -> DataFrame:
    """What a reader made of each record, one row a record."""
    address = F.transform("addresses", lambda a: F.concat_ws("/", *[F.coalesce(a[f], F.lit("~")) for f in ("line1", "line2", "city", "state", "postal_code", "country")]))
    kind = F.concat_ws("+", *[F.when(F.col(k).isNotNull(), F.lit(k)) for k in ("person", "business", "organization", "vessel", "aircraft")])
    return e.select(
        F.col("id").cast("long").alias("record_id"), "name", "entity_type", "source", kind.alias("kind"), F.array_join("alt_names", "|").alias("alt_names"), F.array_join(address, "|").alias("addresses"),
        F.array_join("sanctions.programs", "|").alias("programs"), "remarks",
    )


def ofac_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Every record written as the three-file feed and read back."""
    return _told(feeds.read_ofac(spark, *ofac_files(_entities(spark, folder))))


def ofac_alone(spark: SparkSession, folder: str) -> DataFrame:
    """The same of the main file alone."""
    return _told(feeds.read_ofac(spark, ofac_files(_entities(spark, folder))[0]))


def csl_file(e: DataFrame) -> str:
    address = F.array_join(F.transform("addresses", lambda a: F.concat_ws(", ", a["line1"], a["city"], a["country"])), "; ")
    cells = {0: "record_id", 1: "source_list", 3: "entity_type", 4: "programs", 5: "name", 20: "remarks"}
    return _file(e, 29, {k: F.col(c) for k, c in cells.items()} | {7: address, 14: F.lit("CALL"), 18: F.lit("Flag"), 22: F.array_join("alt_names", "; ")}, ["record_id"])


def csl_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Every record written as a row of the combined list and read back."""
    return _told(feeds.read_csl(spark, csl_file(_entities(spark, folder))))


def _spread_rows(e: DataFrame) -> DataFrame:
    """A row for each name of a record, then one for each address, as grouped lists deliver them."""
    names = e.select("record_id", "entity_type", "remarks", F.posexplode(F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>")))).alias("k", "n")).withColumn("a", F.lit(None).cast(e.schema["addresses"].dataType.elementType))
    places = e.select("record_id", "entity_type", "remarks", F.posexplode("addresses").alias("k", "a")).select("record_id", "entity_type", "remarks", (F.col("k") + 1_000_000).alias("k"), F.lit("").alias("n"), "a")
    return names.unionByName(places)


def eu_file(e: DataFrame) -> str:
    rows = _spread_rows(e)
    remark = F.when(F.trim("remarks") != "", F.concat(F.col("k").cast("string"), F.lit(" "), F.col("remarks")))
    return _file(rows, 68, {1: F.col("record_id"), 6: remark, 8: F.col("entity_type"), 19: F.col("n"), 34: F.col("a.city"), 35: F.col("a.line1"), 37: F.col("a.postal_code"), 43: F.col("a.country"), 65: F.col("a.city")}, ["record_id", "k"], ";")


def eu_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Every record written as rows of the semicolon list, one a name or address, and read back."""
    e = feeds.read_eu(spark, eu_file(_entities(spark, folder)))
    return _told(e).join(e.select(F.col("id").cast("long").alias("record_id"), F.coalesce("person.place_of_birth", F.lit("~")).alias("place")), "record_id")


def uk_file(e: DataFrame) -> str:
    rows = _spread_rows(e)
    head, rest = F.substring_index("n", " ", 1), F.when(F.instr("n", " ") > 0, F.regexp_replace("n", "^[^ ]* ", ""))
    return _file(
        rows, 30, {0: head, 5: rest, 15: F.col("a.line1"), 16: F.col("a.line2"), 20: F.col("a.city"), 21: F.col("a.postal_code"), 22: F.col("a.country"), 23: F.col("remarks"), 24: F.col("entity_type"), 29: F.col("record_id")}, ["record_id", "k"]
    )


def uk_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Every record written as rows of the grouped list and read back."""
    return _told(feeds.read_uk(spark, uk_file(_entities(spark, folder))))


def lists_read(spark: SparkSession, folder: str) -> DataFrame:
    """All lists read by their sources, a source without a reader among them, and counted, noughts included."""
    e = _entities(spark, folder)
    all_ = feeds.read_lists(spark, {"US_OFAC": ofac_files(e), "EU_CSL": eu_file(e), "UK_CSL": uk_file(e), "US_NON_SDN": "nowhere"})
    return I.list_info(all_)


def request_feed(spark: SparkSession, folder: str) -> DataFrame:
    """All search items written as customer requests, one JSON object a line, and read back in chunks."""
    x = table(spark, folder, "search_items").select(F.to_json(F.struct(F.concat_ws("/", "request_id", F.col("item_id").cast("string")).alias("request_id"), "name", "entity_type", F.col("source_list").alias("source"))).alias("value"))
    return feeds.read_requests(spark, written_lines(x))


def _index_rows(e: DataFrame) -> DataFrame:
    """Records as entities of the index, each with the part of its kind."""
    kind = F.upper(F.trim("entity_type"))
    ids = F.coalesce("government_ids", F.array().cast(e.schema["government_ids"].dataType))
    alts = F.coalesce("alt_names", F.array().cast("array<string>"))
    some = lambda k, **v: F.when(kind == k.upper(), part(k, name=F.col("name"), alt_names=alts, **v))
    return as_entities(
        e, index_pos=F.col("record_id"), id=F.col("record_id").cast("string"), name=F.col("name"), entity_type=kind, source=F.col("source_list"), source_id=F.col("source_id"), alt_names=F.col("alt_names"), addresses=F.col("addresses"),
        government_ids=F.col("government_ids"), remarks=F.col("remarks"), person=some("person", birth_date=F.col("birth_date"), titles=F.array(F.col("programs")), government_ids=ids), business=some("business", created=F.col("birth_date"), government_ids=ids),
        organization=some("organization", government_ids=ids), vessel=some("vessel", flag=F.get("addresses", F.lit(0))["country"]), aircraft=some("aircraft", flag=F.get("addresses", F.lit(0))["country"]),
        sanctions=F.when(F.col("programs").isNotNull(), F.struct(F.split("programs", "[;,|]").alias("programs"), F.lit(False).alias("secondary"), F.lit(None).cast("string").alias("description"))),
    )


def index_operations(spark: SparkSession, folder: str) -> DataFrame:
    """What is in an index after each operation: replace, add, add nothing, find, remove, refresh, clear."""
    e = _entities(spark, folder)
    ix = I.Index(spark)
    out: list[tuple[str, int]] = [("empty", ix.size())]
    ix.replace(_index_rows(e))
    out.append(("replaced", ix.size()))
    ix.add(None)
    ix.add(ix.table)  # double ids are kept
    out += [("added", ix.size()), ("distinct ids", ix.table.select("id").distinct().count()), ("distinct places", ix.table.select("index_pos").distinct().count())]
    first = ix.table.orderBy("index_pos").first().id
    out += [("of one source", I.by_source(ix.table, "EU_CSL").count()), ("of no source", I.by_source(ix.table, None).count()), ("of one type", I.by_type(ix.table, "PERSON").count()), ("of one id", I.by_id(ix.table, first).count()), ("of no id", I.by_id(ix.table, None).count())]
    out += [("removed", int(ix.remove(first))), ("removed again", int(ix.remove(first))), ("left", ix.size())]
    out += [("refreshed", int(ix.refresh({"US_OFAC": ofac_files(e)[0]}))), ("after refresh", ix.size())]
    ix.clear()
    return spark.createDataFrame([*out, ("cleared", ix.size())], "operation string, n long")


def merge_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records merged by list, id and kind."""
    m = merge_entities(written(_index_rows(_entities(spark, folder))), prepare=False)
    part_of = lambda f: F.coalesce(*[F.col(f"{k}.{f}") for k in ("person", "business", "organization", "vessel", "aircraft") if f not in ("government_ids", "birth_date") or k in ("person", "business", "organization")])
    address = F.transform("addresses", lambda a: F.concat_ws("/", *[F.coalesce(a[f], F.lit("~")) for f in ("line1", "line2", "city", "state", "postal_code", "country")]))
    return m.select(
        F.col("index_pos").alias("record_id"), "name", "entity_type", "source", "remarks", F.array_join("alt_names", "|").alias("alt_names"), F.array_join(address, "|").alias("addresses"),
        F.array_join(F.transform("government_ids", lambda g: F.concat_ws("/", g["id_type"], g["identifier"], g["country"])), "|").alias("government_ids"), F.array_join("sanctions.programs", "|").alias("programs"),
        F.array_join(part_of("alt_names"), "|").alias("part_alt_names"), F.col("person.birth_date").alias("birth_date"), F.array_join("person.titles", "|").alias("titles"),
    )


QUERIES = {
    "ofac_feed": ofac_feed, "ofac_alone": ofac_alone, "csl_feed": csl_feed, "eu_feed": eu_feed, "uk_feed": uk_feed, "lists_read": lists_read, "request_feed": request_feed, "index_operations": index_operations, "merge_records": merge_records,
}


# ---- SQL


def _unmarked(c: str) -> str:
    return f"CASE WHEN lower(trim(coalesce({c}, ''))) IN ('-0-', 'null') THEN '' ELSE trim(regexp_replace(trim(coalesce({c}, '')), '^-0-\\s*', '')) END"


def _split(c: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '{pattern}'), lambda x: trim(x)), lambda x: x <> '')"


def _address(line1: str, line2: str, city: str, state: str, postal: str, country: str) -> str:
    return "concat_ws('/', " + ", ".join(f"coalesce({x}, '~')" for x in (line1, line2, city, state, postal, country)) + ")"


_OFAC_KIND = "CASE WHEN t = '' THEN 'BUSINESS' WHEN t = 'individual' THEN 'PERSON' WHEN t = 'entity' THEN 'BUSINESS' WHEN t = 'vessel' THEN 'VESSEL' WHEN t = 'aircraft' THEN 'AIRCRAFT' ELSE 'UNKNOWN' END"


def _ofac_sql(sides: bool) -> str:
    place = "string_split(" + _unmarked("concat_ws(', ', a.city, a.state, a.postal_code)") + ", ',')"
    one = _address(_unmarked("a.line1"), "NULL", f"trim(coalesce(({place})[1], ''))", f"trim(coalesce(({place})[2], ''))", "''", _unmarked("a.country"))
    alts = f"array_to_string(list_filter(list_transform(coalesce(alt_names, []), lambda n: {_unmarked('n')}), lambda n: n <> ''), '|')" if sides else "''"
    addresses = f"array_to_string(list_transform(coalesce(addresses, []), lambda a: {one}), '|')" if sides else "''"
    return f"""SELECT record_id, n AS name, k AS entity_type, 'US_OFAC' AS source, CASE WHEN k = 'UNKNOWN' THEN '' ELSE lower(k) END AS kind, {alts} AS alt_names, {addresses} AS addresses,
      array_to_string({_split('p', '[;\\s]+')}, '|') AS programs, {_unmarked('remarks')} AS remarks FROM (SELECT *, {_OFAC_KIND} AS k FROM (SELECT *, {_unmarked('name')} AS n, {_unmarked('programs')} AS p, lower({_unmarked('entity_type')}) AS t FROM entities)) WHERE n <> ''"""


_NEEDLES = "[" + ", ".join(f"'{x}'" for x in W.COMPANY_NEEDLES) + "]"
_CSL = f"""CASE WHEN t = 'individual' THEN 'PERSON' WHEN t = 'vessel' THEN 'VESSEL' WHEN t = 'aircraft' THEN 'AIRCRAFT' WHEN t = 'entity' THEN CASE WHEN contains(s, 'military-industrial') OR contains(s, 'cmic') THEN 'ORGANIZATION' ELSE 'BUSINESS' END
      WHEN len(list_filter({_NEEDLES}, lambda x: contains(lower(n), x))) > 0 THEN 'BUSINESS' ELSE 'UNKNOWN' END"""
_CSL_ADDRESS = _address("trim(x[1])", "NULL", "trim(coalesce(x[2], ''))", "NULL", "NULL", "trim(coalesce(x[3], ''))")
_NAMES = "list_filter(list_transform(list_concat([name], coalesce(alt_names, [])), lambda x: trim(coalesce(x, ''))), lambda x: x <> '')"
_FIRST_SEEN = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def _grouped_sql(names: str, address: str, there: str, kind: str, source: str, program: str, remark: str, more: str = "") -> str:
    place = f"list_filter(list_transform(coalesce(addresses, []), lambda a: CASE WHEN {there} THEN {address} END), lambda x: x IS NOT NULL)"
    return f"""SELECT record_id, ns[1] AS name, k AS entity_type, '{source}' AS source, CASE WHEN k = 'UNKNOWN' THEN '' ELSE lower(k) END AS kind, array_to_string(ns[2:], '|') AS alt_names, array_to_string({_FIRST_SEEN.format(l='ps')}, '|') AS addresses, '{program}' AS programs, {remark} AS remarks{more}
      FROM (SELECT *, {_FIRST_SEEN.format(l='all_names')} AS ns FROM (SELECT *, {names} AS all_names, {place} AS ps, {kind} AS k FROM (SELECT *, lower(trim(coalesce(entity_type, ''))) AS t FROM entities))) WHERE len(ns) > 0"""


_T = "trim(coalesce(a.{}, ''))"
_EU_ADDRESS = _address(_T.format("line1"), "NULL", _T.format("city"), "NULL", _T.format("postal_code"), _T.format("country"))
_UK_LINE = "array_to_string(list_filter([" + ", ".join(_T.format(f) for f in ("line1", "line2", "city")) + "], lambda x: x <> ''), ', ')"
_UK_NAMES = "list_filter(list_transform(list_concat([name], coalesce(alt_names, [])), lambda x: array_to_string(list_filter([trim(split_part(coalesce(x, ''), ' ', 1)), CASE WHEN contains(coalesce(x, ''), ' ') THEN trim(regexp_replace(x, '^[^ ]* ', '')) ELSE '' END], lambda y: y <> ''), ' ')), lambda x: x <> '')"
_EU_LAST = "CASE WHEN len(coalesce(addresses, [])) > 0 THEN 1000000 + len(addresses) - 1 ELSE len(coalesce(alt_names, [])) END"
_GROUP_KEY = "lower(coalesce(source_list, '') || '/' || coalesce(source_id, '') || '/' || coalesce(upper(trim(entity_type)), ''))"


def _merged_list(values: str, same: str, shown: str, alias: str) -> str:
    """(key, list) of the first of the elements that are the same, in order; values: a select of (key, record_id, i, x)."""
    return f"{alias} AS (SELECT key, string_agg(v, '|' ORDER BY record_id, i) AS {alias}_text FROM (SELECT key, arg_min({shown}, [record_id, i]) AS v, min([record_id, i])[1] AS record_id, min([record_id, i])[2] AS i FROM ({values}) WHERE x IS NOT NULL GROUP BY key, {same}) GROUP BY key)"


def _each(column: str, where: str = "true") -> str:
    return f"SELECT key, record_id, unnest(range(1, len({column}) + 1)) AS i, unnest({column}) AS x FROM r WHERE {where}"


_FILLED = "arg_min({c}, record_id) FILTER ({c} IS NOT NULL AND {c} <> '')"
_PART = "lower(upper(trim(entity_type)))"
_ADDRESSES = f"""adr AS (SELECT key, string_agg({_address('line1', 'line2', 'city', 'state', 'postal_code', 'country')}, '|' ORDER BY o) AS adr_text FROM (SELECT key, min([record_id, i]) AS o, {', '.join(f"arg_min(x.{f}, [record_id, i]) FILTER (x.{f} IS NOT NULL AND x.{f} <> '') AS {f}" for f in ('line1', 'line2', 'city', 'state', 'postal_code', 'country'))}
      FROM ({_each('addresses')}) WHERE x IS NOT NULL GROUP BY key, lower(coalesce(x.line1, '') || '/' || coalesce(x.line2, ''))) GROUP BY key)"""
_ID_KEY = "lower(coalesce(x.country, 'null') || '/' || coalesce(x.id_type, 'null') || '/' || regexp_replace(coalesce(x.identifier, ''), '[ -]', '', 'g'))"
_KINDS = "upper(trim(entity_type)) IN ('PERSON', 'BUSINESS', 'ORGANIZATION', 'VESSEL', 'AIRCRAFT')"
_LATER = "SELECT key, 0 AS g, -record_id AS a, 0 AS b, name AS x FROM r WHERE record_id > fp AND name <> merged"

SQL = {
    "ofac_feed": _ofac_sql(True),
    "ofac_alone": _ofac_sql(False),
    "csl_feed": f"""SELECT record_id, n AS name, k AS entity_type, 'US_CSL' AS source, CASE WHEN k = 'UNKNOWN' THEN '' ELSE lower(k) END AS kind, array_to_string({_split("array_to_string(coalesce(alt_names, []), '; ')", ';')}, '|') AS alt_names,
      array_to_string(list_transform({_split("array_to_string(list_transform(coalesce(addresses, []), lambda a: concat_ws(', ', a.line1, a.city, a.country)), '; ')", ';')}, lambda y: list_transform([string_split(y, ',')], lambda x: {_CSL_ADDRESS})[1]), '|') AS addresses,
      array_to_string({_split('programs', ';')}, '|') AS programs, trim(coalesce(remarks, '')) AS remarks FROM (SELECT *, {_CSL} AS k FROM (SELECT *, trim(coalesce(name, '')) AS n, lower(trim(coalesce(entity_type, ''))) AS t, lower(trim(coalesce(source_list, ''))) AS s FROM entities)) WHERE n <> ''""",
    "eu_feed": _grouped_sql(_NAMES, _EU_ADDRESS, " OR ".join(f"{_T.format(f)} <> ''" for f in ("line1", "city", "country")), "CASE WHEN t = 'person' THEN 'PERSON' ELSE 'UNKNOWN' END", "EU_CSL", "EU", f"CASE WHEN trim(coalesce(remarks, '')) = '' THEN '' ELSE trim(({_EU_LAST})::varchar || ' ' || remarks) END",
        ", CASE WHEN k = 'PERSON' THEN coalesce(list_filter(list_transform(coalesce(addresses, []), lambda a: trim(coalesce(a.city, ''))), lambda x: x <> '')[-1], '~') ELSE '~' END AS place"),
    "uk_feed": _grouped_sql(_UK_NAMES, _address(_UK_LINE, "NULL", "NULL", "NULL", _T.format("postal_code"), _T.format("country")), f"{_UK_LINE} <> '' OR {_T.format('postal_code')} <> '' OR {_T.format('country')} <> ''",
        "CASE WHEN t = 'individual' THEN 'PERSON' WHEN t = 'ship' THEN 'VESSEL' WHEN t = 'entity' THEN 'BUSINESS' ELSE 'UNKNOWN' END", "UK_CSL", "UK", "trim(coalesce(remarks, ''))"),
    "lists_read": f"""SELECT s AS source, CASE s WHEN 'US_OFAC' THEN (SELECT count(*) FROM entities WHERE {_unmarked('name')} <> '') WHEN 'EU_CSL' THEN (SELECT count(*) FROM entities WHERE len({_NAMES}) > 0) WHEN 'UK_CSL' THEN (SELECT count(*) FROM entities WHERE len({_NAMES}) > 0) ELSE 0 END AS n
      FROM (SELECT unnest(['US_OFAC', 'US_CSL', 'US_NON_SDN', 'EU_CSL', 'UK_CSL']) AS s)""",
    "request_feed": "SELECT concat_ws('/', request_id, item_id::varchar) AS request_id, name, entity_type, source_list AS source FROM search_items",
    "index_operations": f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (source_list = 'EU_CSL') AS s, count(*) FILTER (upper(trim(entity_type)) = 'PERSON') AS t, count(*) FILTER ({_unmarked('name')} <> '') AS f FROM entities)
      SELECT o.operation, CASE o.operation WHEN 'replaced' THEN n WHEN 'added' THEN 2 * n WHEN 'distinct ids' THEN n WHEN 'distinct places' THEN 2 * n WHEN 'of one source' THEN 2 * s WHEN 'of one type' THEN 2 * t WHEN 'of one id' THEN 1 WHEN 'removed' THEN 1 WHEN 'left' THEN 2 * n - 2
      WHEN 'refreshed' THEN 1 WHEN 'after refresh' THEN f ELSE 0 END AS n FROM n, (SELECT unnest(['empty', 'replaced', 'added', 'distinct ids', 'distinct places', 'of one source', 'of no source', 'of one type', 'of one id', 'of no id', 'removed', 'removed again', 'left', 'refreshed', 'after refresh', 'cleared']) AS operation) o""",
    "merge_records": f"""WITH b AS (SELECT *, {_GROUP_KEY} AS key, min(record_id) OVER (PARTITION BY {_GROUP_KEY}) AS fp FROM entities), r0 AS (SELECT * FROM b WHERE record_id = fp OR (name IS NOT NULL AND name <> '')),
      r AS (SELECT *, first_value(CASE WHEN name <> '' THEN name END IGNORE NULLS) OVER (PARTITION BY key ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS merged, count(*) OVER (PARTITION BY key) AS m FROM r0),
      one AS (SELECT key, min(record_id) AS record_id, max(m) AS m, any_value(merged) AS name, {_FILLED.format(c='upper(trim(entity_type))')} AS entity_type, {_FILLED.format(c='source_list')} AS source, {_FILLED.format(c='remarks')} AS remarks, arg_min(birth_date, record_id) FILTER (birth_date IS NOT NULL) AS birth_date FROM r GROUP BY key),
      {_merged_list(_each('alt_names'), 'lower(x)', 'x', 'alts')}, {_ADDRESSES}, {_merged_list(_each('government_ids'), _ID_KEY, "concat_ws('/', x.id_type, x.identifier, x.country)", 'ids')}, {_merged_list(_each("string_split_regex(programs, '[;,|]')", 'programs IS NOT NULL'), 'lower(x)', 'x', 'prog')},
      {_merged_list(_each('[programs]', "upper(trim(entity_type)) = 'PERSON'"), 'lower(x)', 'x', 'tit')},
      pa AS (SELECT key, string_agg(v, '|' ORDER BY o) AS pa_text FROM (SELECT key, arg_min(x, [g, a, b]) AS v, min([g, a, b]) AS o FROM ({_LATER} UNION ALL SELECT key, 1, record_id, i, x FROM ({_each("coalesce(alt_names, [])", _KINDS)})) WHERE x IS NOT NULL GROUP BY key, lower(x)) GROUP BY key)
      SELECT o.record_id, CASE WHEN o.m = 1 THEN f.name ELSE o.name END AS name, CASE WHEN o.m = 1 THEN upper(trim(f.entity_type)) ELSE o.entity_type END AS entity_type, CASE WHEN o.m = 1 THEN f.source_list ELSE o.source END AS source, CASE WHEN o.m = 1 THEN f.remarks ELSE o.remarks END AS remarks,
      CASE WHEN o.m = 1 THEN array_to_string(f.alt_names, '|') ELSE coalesce(alts_text, '') END AS alt_names, CASE WHEN o.m = 1 THEN array_to_string(list_transform(f.addresses, lambda a: {_address('a.line1', 'a.line2', 'a.city', 'a.state', 'a.postal_code', 'a.country')}), '|') ELSE coalesce(adr_text, '') END AS addresses,
      CASE WHEN o.m = 1 THEN array_to_string(list_transform(f.government_ids, lambda g: concat_ws('/', g.id_type, g.identifier, g.country)), '|') ELSE coalesce(ids_text, '') END AS government_ids,
      CASE WHEN o.m = 1 THEN array_to_string(string_split_regex(f.programs, '[;,|]'), '|') WHEN prog_text IS NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.key = o.key AND r.programs IS NOT NULL) THEN NULL ELSE coalesce(prog_text, '') END AS programs,
      CASE WHEN NOT (upper(trim(f.entity_type)) IN ('PERSON', 'BUSINESS', 'ORGANIZATION', 'VESSEL', 'AIRCRAFT')) OR f.entity_type IS NULL THEN NULL WHEN o.m = 1 THEN array_to_string(coalesce(f.alt_names, []), '|') ELSE coalesce(pa_text, '') END AS part_alt_names,
      CASE WHEN upper(trim(f.entity_type)) = 'PERSON' THEN CASE WHEN o.m = 1 THEN f.birth_date ELSE o.birth_date END END AS birth_date, CASE WHEN upper(trim(f.entity_type)) = 'PERSON' THEN CASE WHEN o.m = 1 THEN coalesce(f.programs, '') ELSE coalesce(tit_text, '') END END AS titles
      FROM one o JOIN entities f ON f.record_id = o.record_id LEFT JOIN alts USING (key) LEFT JOIN adr USING (key) LEFT JOIN ids USING (key) LEFT JOIN prog USING (key) LEFT JOIN tit USING (key) LEFT JOIN pa USING (key)""",
}
