"""Queries that run each operator over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import normalize as N
from ..functions import similarity as S
from ..functions import words as W
from ..operators import index as I
from ..operators import report as R
from ..operators import scoring, search
from ..operators.prepare import prepared
from ..schema import as_entities
from ..session import table, written
from .scores_sql import plain as plain_sql
from .text_sql import SQL as TEXT_SQL
from ..sources.feeds import csl_type, ofac_type, split_clean, unmarked


def _r(c: Column) -> Column:
    return F.round(c, 6)


# ---- text


def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(N.plain(F.col("text"))).alias("plain_md5"), F.length(N.plain(F.col("text"))).cast("long").alias("plain_chars"))


def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = N.tokens(N.plain(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct_words"))


def remove_stopwords(lang: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        kept = N.without_stopwords(N.plain(F.col("text")), lang)
        return table(spark, folder, "documents").select("doc_id", F.md5(kept).alias("kept_md5"), F.length(kept).cast("long").alias("kept_chars"))

    return query


def _stop_sql(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in W.STOPWORDS[lang].split())
    kept = f"array_to_string(list_filter(string_split({plain_sql('text')}, ' '), lambda w: w <> '' AND NOT list_contains([{words}], lower(w))), ' ')"
    return f"SELECT doc_id, md5(k) AS kept_md5, length(k) AS kept_chars FROM (SELECT doc_id, {kept} AS k FROM documents)"


def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    g = N.language_guess(F.col("name"))
    return table(spark, folder, "search_items").select("item_id", g["language"].alias("language"), g["confidence"].alias("confidence"))


def reorder_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select("record_id", N.reordered(F.col("name")).alias("name"))


def company_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select("record_id", N.without_company_titles(N.plain(F.col("name"))).alias("name"))


def particle_forms(spark: SparkSession, folder: str) -> DataFrame:
    forms = N.particle_forms(N.plain(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", F.size(forms).cast("long").alias("forms"), F.md5(F.array_join(forms, "|")).alias("forms_md5"))


def normalize_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", N.bare_id(F.col("c_name")).alias("bare"), N.digits(F.col("c_name")).alias("digits"), F.replace("c_name", F.lit("-"), F.lit("")).alias("no_hyphens"))


def phones(spark: SparkSession, folder: str) -> DataFrame:
    written_ = F.concat(F.lit("+1 (0)"), F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_custkey").cast("string"), F.lit(" x"))
    return table(spark, folder, "orders").select("o_orderkey", N.phone(written_).alias("phone"))


def address_fields(spark: SparkSession, folder: str) -> DataFrame:
    a = F.struct("line1", "line2", "city", "state", "postal_code", "country")
    s = N.scored_address(a)
    return table(spark, folder, "prepared_addresses").select("address_id", N.address_field(F.col("line1")).alias("line1"), F.array_join(s["line1"], " ").alias("line1_words"), s["state"].alias("state"), s["country"].alias("country"), N.full_address(a).alias("full_address"))


def genders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select("record_id", N.gender(F.col("gender")).alias("gender"))


def country_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "prepared_addresses").select("address_id", "country")
    return N.with_country_name(rows, "country", "country_name")


def country_languages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "prepared_addresses").select("address_id", N.country_language(F.col("country")).alias("language"), N.country_aware_language(F.col("line1"), F.col("country")).alias("chosen"))
    return rows


def titles(spark: SparkSession, folder: str) -> DataFrame:
    t = N.title(F.concat(F.lit("Sr. "), F.col("p_type"), F.lit(" & Eng., VP")))
    return table(spark, folder, "part").select("p_partkey", t.alias("title"), N.expanded_title(t).alias("expanded"))


def affiliation_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select("record_id", N.affiliation_name(F.col("name")).alias("name"))


def sound_keys(spark: SparkSession, folder: str) -> DataFrame:
    word = F.explode(F.split("p_name", " ")).alias("word")
    return table(spark, folder, "part").select(word).distinct().select("word", N.sound_key(F.col("word")).alias("sound_key"))


def _sound_sql(w: str) -> str:
    codes = {ch: d for d, ls in W.SOUND_CODES.items() for ch in ls}
    alphabet = "".join(sorted(codes))
    x = f"translate({w}, '{alphabet}', '{''.join(codes[c] for c in alphabet)}')"
    x = f"regexp_replace({x}, '[^1-6]', '0', 'g')"
    for d in W.SOUND_CODES:
        x = f"regexp_replace({x}, '{d}+', '{d}', 'g')"
    return f"rpad(upper(substr({w}, 1, 1)) || replace(substr({x}, 2), '0', ''), 4, '0')"


def first_letter_fit(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.split("p_name", " ")[0], F.split("p_type", " ")[0]
    return table(spark, folder, "part").select("p_partkey", N.first_letters_fit(a, b).alias("fits"))


# ---- sources and types


def source_and_type_filters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_items").select(
        "item_id", search.source_filter(F.col("source_list")).alias("source"), search.type_filter(F.col("entity_type")).alias("entity_type"),
        search.strict(F.col("source_list"), W.SOURCES).alias("batch_source"), search.strict(F.col("entity_type"), W.ENTITY_TYPES).alias("batch_type"),
    )


def feed_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select("record_id", ofac_type(F.col("entity_type")).alias("ofac_type"), csl_type(F.coalesce("entity_type", F.lit("")), F.coalesce("remarks", F.lit("")), F.coalesce("name", F.lit(""))).alias("csl_type"))


def program_lists(spark: SparkSession, folder: str) -> DataFrame:
    p = split_clean(unmarked(F.col("programs")), "[;\\s]+")
    return table(spark, folder, "entities").select("record_id", F.size(p).cast("long").alias("n"), F.array_join(p, "|").alias("programs"))


def list_info(spark: SparkSession, folder: str) -> DataFrame:
    return I.counts(table(spark, folder, "customer"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"], "segment")


def source_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").rollup("source_list", "entity_type").agg(F.count("*").alias("n"))


# ---- comparers


def date_scores(spark: SparkSession, folder: str) -> DataFrame:
    o, l = table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    both = l.join(o, l.l_orderkey == o.o_orderkey)
    a, b = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    life = C.person_dates(a, F.date_add(a, 20000), b, F.date_add(b, 25000))
    return both.select("l_orderkey", "l_linenumber", _r(C.date_score(a, b)).alias("score"), C.days_alike(F.dayofmonth(a), F.dayofmonth(b)).alias("days_alike"), _r(life["score"]).alias("life_score"), life["matched"].alias("life_matched"))


def _date_sql(a: str, b: str) -> str:
    return f"""(0.4::double * CASE WHEN abs(year({a}) - year({b})) <= 5 THEN 1.0::double - 0.1::double * abs(year({a}) - year({b})) ELSE 0.2::double END
      + 0.3::double * CASE WHEN abs(month({a}) - month({b})) = 0 THEN 1.0::double WHEN abs(month({a}) - month({b})) = 1 THEN 0.9::double WHEN least(month({a}), month({b})) = 1 AND greatest(month({a}), month({b})) >= 10 THEN 0.7::double ELSE 0.3::double END
      + 0.3::double * CASE WHEN abs(day({a}) - day({b})) = 0 THEN 1.0::double WHEN abs(day({a}) - day({b})) <= 3 THEN 0.95::double - 0.05::double * abs(day({a}) - day({b})) / 3.0::double WHEN {_days_sql(a, b)} THEN 0.7::double ELSE 0.3::double END)"""


def _days_sql(a: str, b: str) -> str:
    x, y = f"day({a})::varchar", f"day({b})::varchar"
    return f"({x} = {y} OR {x} || {x} = {y} OR {y} || {y} = {x} OR (length({x}) = 2 AND length({y}) = 2 AND reverse({x}) = {y}))"


def exact_id_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers are the digits of names: an equi-join finds the pairs, a comparer scores them."""
    c = table(spark, folder, "customer").select("c_custkey", N.digits(F.col("c_name")).alias("cid"), F.col("c_nationkey").cast("string").alias("cc"))
    s = table(spark, folder, "supplier").select("s_suppkey", N.digits(F.col("s_name")).alias("sid"), F.col("s_nationkey").cast("string").alias("sc"))
    both = c.join(s, c.cid == s.sid)
    a, b = F.array(F.struct(F.lit("ID").alias("id_type"), F.col("cid").alias("identifier"), F.col("cc").alias("country"))), F.array(F.struct(F.lit("ID").alias("id_type"), F.col("sid").alias("identifier"), F.col("sc").alias("country")))
    return both.select("c_custkey", "s_suppkey", C.exact_ids(a, b).alias("exact"), C.live_gov_id(a, b).alias("live"), C.gov_ids_with_country(a, b).alias("with_country"))


def asset_ids(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    q = F.struct(F.col("p_brand").alias("imo_number"), F.nullif(F.substring("p_type", 1, 0), F.lit("")).alias("call_sign"), F.col("p_size").cast("string").alias("mmsi"))
    i = F.struct(F.lower("p_brand").alias("imo_number"), F.col("p_type").alias("call_sign"), (F.col("p_size") % 7).cast("string").alias("mmsi"))
    a, b = F.struct(F.col("p_brand").alias("serial_number"), F.col("p_type").alias("icao_code")), F.struct(F.col("p_name").alias("serial_number"), F.upper("p_type").alias("icao_code"))
    return p.select("p_partkey", _r(C.vessel_ids(q, i)).alias("vessel"), _r(C.aircraft_ids(a, b)).alias("aircraft"))


def weighted_totals(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "lineitem")
    exact = F.when(F.col("l_quantity") >= 49, 1.0).otherwise(0.0)
    f = {"name": F.col("l_discount") * 10, "alt_names": F.col("l_tax") * 10, "address": F.col("l_quantity") / 100, "gov_id": exact, "crypto": F.lit(0.0), "contact": F.lit(0.0), "date": F.when(F.col("l_linenumber") == 1, 1.0).otherwise(0.0)}
    total = C.factor_total(f, source_id_differs=F.col("l_returnflag") == "R")
    return x.select("l_orderkey", "l_linenumber", _r(total).alias("total"), _r(C.name_address_total(f["name"], f["address"])).alias("name_address"))


def score_adjustments(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "lineitem")
    score, words = F.col("l_discount") * 10, F.col("l_linenumber")
    adjusted = C.quality_adjusted(score, words, F.col("l_linenumber") % 3, F.col("l_returnflag") == "A", F.lit(False))
    final = C.penalised(adjusted, F.col("l_quantity") / 50, F.col("l_tax") * 10, F.col("l_linenumber"), F.col("l_linestatus") == "O", F.col("l_quantity") > 45)
    return x.select("l_orderkey", "l_linenumber", _r(adjusted).alias("adjusted"), _r(final).alias("final"), C.high_confidence(words, score).alias("high"), C.close_enough(score).alias("close"), R.quality(final).alias("quality"))


def mean_scores(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "lineitem")
    a, b = F.col("l_discount") * 10, F.col("l_tax") * 10
    parts = F.create_map(F.lit("name"), a, F.lit("gov_id"), b, F.lit("other"), F.lit(1.0))
    return x.select("l_orderkey", "l_linenumber", _r(C.affiliations_score(F.array(a, b))).alias("affiliations"), _r(C.supporting_score(a, b)).alias("supporting"), _r(C.positive_mean(parts)).alias("positive"), _r(C.affiliation_score(a, b)).alias("affiliation"))


def program_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Programmes of a record against those of the record before it on its list."""
    own = split_clean(F.col("programs"), "[;,|]+")
    e = table(spark, folder, "entities").select("record_id", "source_list", F.struct(own.alias("programs"), (F.col("record_id") % 2 == 0).alias("secondary")).alias("s"))
    prev = e.select((F.col("record_id") + 1).alias("record_id"), F.col("s").alias("t"))
    return e.join(prev, "record_id").select("record_id", _r(C.programs_score(F.col("s"), F.col("t"))).alias("score"))


# ---- aggregations and orders


def batch_statistics(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "customer")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000))
    rows = x.select(F.when(score > 0, "SUCCESS").when(F.col("c_custkey") % 10 == 0, "ERROR").otherwise("NO_MATCHES").alias("status"), F.when(score > 0, F.array(score, score / 2)).alias("scores"))
    s = search.statistics(rows)
    return s.select(*[_r(F.col(c)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in s.dtypes])


def merge_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered unions without regard to case, and the first value, of each customer's orders."""
    from ..operators.merge import first_filled, ordered_union

    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    union = ordered_union(o, "o_custkey", F.col("o_orderpriority"), F.lower("o_orderpriority"), F.col("o_orderkey"), "priorities")
    first = o.groupBy("o_custkey").agg(first_filled(F.col("o_orderstatus"), F.col("o_orderkey")).alias("first_status"), F.count("*").alias("n"))
    return first.join(union, "o_custkey").select("o_custkey", "first_status", "n", F.array_join("priorities", "|").alias("priorities"))


def stable_topk(spark: SparkSession, folder: str) -> DataFrame:
    best = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), "l_linenumber")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.row_number().over(best).cast("long").alias("rank")).where("rank <= 3")


def trace_summaries(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "click", "AGGREGATION").otherwise(F.col("event_type")).alias("phase"), F.floor(F.abs("value")).cast("long").alias("duration_ms"))
    s = R.trace_summary(e)
    return s.select("session_id", F.col("entities_scored").cast("long").alias("entities_scored"), "slowest_phase", F.col("total_ms").cast("long").alias("total_ms"), "longest_phase")


def top_phases(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("phase"), F.floor(F.abs("value")).cast("long").alias("duration_ms"))
    return R.phase_counts(e).select("session_id", "phase", F.col("n").cast("long").alias("n"), F.col("rank").cast("long").alias("rank"))


# ---- screening


def screen_items(spark: SparkSession, folder: str) -> DataFrame:
    """All search items screened against all entities, ten matches each from 0.88 on."""
    e = table(spark, folder, "entities")
    index = written(as_entities(e, index_pos=F.col("record_id"), id=F.col("record_id").cast("string"), name=F.col("name"), entity_type=F.upper("entity_type"), source=F.col("source_list"), alt_names=F.col("alt_names"), remarks=F.col("remarks")))
    req = table(spark, folder, "search_items").select(F.col("item_id").alias("item_pos"), "request_id", "name", "entity_type", F.col("source_list").alias("source"))
    out = search.batch(req, index, most=None)
    return out.select(F.col("item_pos").alias("item_id"), "status", F.explode_outer("matches").alias("m")).select("item_id", "status", F.col("m.rank").alias("rank"), F.col("m.entity_id").alias("entity_id"), _r(F.col("m.score")).alias("score"))


def same_sound_names(spark: SparkSession, folder: str) -> DataFrame:
    """Part names that score one by sound alone: as many words, the same set of keys, an equi-join."""
    p = table(spark, folder, "part").select("p_name").distinct().select("p_name", F.size(N.tokens(N.plain(F.col("p_name")))).alias("n"), N.sound_set(N.plain(F.col("p_name"))).alias("k"))
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.k") == F.col("b.k"))).where("a.p_name <= b.p_name").select(F.col("a.p_name").alias("name_a"), F.col("b.p_name").alias("name_b"))


def jaro_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Jaro of each part's name with its type and brand."""
    p = table(spark, folder, "part").select("p_name", F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("other")).distinct()
    return p.select("p_name", "other", _r(S.jaro_column("p_name", "other")).alias("jaro"))


def prepared_fields(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entities")
    p = prepared(F.col("name"), F.col("alt_names"), F.col("addresses"))
    return e.select("record_id", p["name"].alias("name"), F.array_join(p["alt_names"], "|").alias("alt_names"), F.array_join(p["word_forms"], "|").alias("word_forms"), F.array_join(p["without_company_titles"], "|").alias("without_company_titles"), F.array_join(p["addresses"], "|").alias("addresses"), p["language"].alias("language"))


_TOK = "list_filter(string_split({x}, ' '), lambda w: w <> '')"
_TITLES = "|".join(t.replace(" ", "\\s") for t in W.COMPANY_TITLES)
_EXP = {w: full for w, full in W.TITLE_WORDS.items()}

QUERIES = {
    "normalize_text": normalize_text, "tokenize_counts": tokenize_counts, **{f"remove_stopwords_{k}": remove_stopwords(k) for k in W.STOPWORDS}, "detect_language": detect_language, "reorder_names": reorder_names,
    "company_titles": company_titles, "particle_forms": particle_forms, "normalize_ids": normalize_ids, "phones": phones, "address_fields": address_fields, "genders": genders, "country_names": country_names,
    "country_languages": country_languages, "titles": titles, "affiliation_names": affiliation_names, "sound_keys": sound_keys, "first_letter_fit": first_letter_fit, "source_and_type_filters": source_and_type_filters,
    "feed_types": feed_types, "program_lists": program_lists, "list_info": list_info, "source_rollup": source_rollup, "date_scores": date_scores, "exact_id_matches": exact_id_matches, "asset_ids": asset_ids,
    "weighted_totals": weighted_totals, "score_adjustments": score_adjustments, "mean_scores": mean_scores, "program_scores": program_scores, "batch_statistics": batch_statistics, "merge_groups": merge_groups,
    "stable_topk": stable_topk, "trace_summaries": trace_summaries, "top_phases": top_phases, "screen_items": screen_items, "same_sound_names": same_sound_names,
    "jaro_scores": jaro_scores, "prepared_fields": prepared_fields,
}

_L = "length(name) < 30"
SQL = {
    "normalize_text": f"SELECT doc_id, md5(p) AS plain_md5, length(p) AS plain_chars FROM (SELECT doc_id, {plain_sql('text')} AS p FROM documents)",
    "tokenize_counts": f"SELECT doc_id, len(t) AS words, len(list_distinct(t)) AS distinct_words FROM (SELECT doc_id, {_TOK.format(x=plain_sql('text'))} AS t FROM documents)",
    **{f"remove_stopwords_{k}": _stop_sql(k) for k in W.STOPWORDS},
    "detect_language": f"""SELECT item_id, split_part(g, '|', 1) AS language, split_part(g, '|', 2)::double AS confidence FROM (SELECT item_id, CASE WHEN name IS NULL OR trim(name) = '' THEN 'en|0'
      WHEN regexp_matches(name, '[\\x{{0400}}-\\x{{052f}}]') THEN 'ru|0.9' WHEN regexp_matches(name, '[\\x{{0600}}-\\x{{06ff}}\\x{{0750}}-\\x{{077f}}\\x{{08a0}}-\\x{{08ff}}]') THEN 'ar|0.9'
      WHEN regexp_matches(name, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]') THEN 'zh|0.9' WHEN length(name) < 3 THEN 'en|0.5'
      WHEN {_L} AND regexp_matches(lower(name), '(^| )(the|a|of)( |$)') THEN 'en|0.8' WHEN {_L} AND regexp_matches(lower(name), '(^| )(el|la|de|del)( |$)') THEN 'es|0.8' ELSE 'en|0.5' END AS g FROM search_items)""",
    "reorder_names": "SELECT record_id, CASE WHEN contains(name, ',') THEN trim(regexp_replace(name, '^[^,]*,', '')) || ' ' || trim(split_part(name, ',', 1)) ELSE name END AS name FROM entities",
    "company_titles": f"SELECT record_id, regexp_replace({plain_sql('name')}, '(?:(?:{_TITLES})\\s*)+$', '') AS name FROM entities",
    "normalize_ids": "SELECT c_custkey, lower(regexp_replace(c_name, '[^a-zA-Z0-9]', '', 'g')) AS bare, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, replace(c_name, '-', '') AS no_hyphens FROM customer",
    "phones": "SELECT o_orderkey, '1' || o_orderkey || o_custkey || 'x' AS phone FROM orders",
    "address_fields": """SELECT address_id, CASE WHEN line1 <> '' THEN lower(translate(line1, ',.', '')) END AS line1, array_to_string(list_filter(string_split_regex(trim(lower(translate(coalesce(line1, ''), ',.#', ''))), '\\s+'), lambda w: w <> ''), ' ') AS line1_words,
      trim(lower(translate(coalesce(state, ''), ',.#', ''))) AS state, trim(lower(translate(coalesce(country, ''), '.', ''))) AS country, trim(concat_ws(' ', line1, line2, city, state, postal_code, country)) AS full_address FROM prepared_addresses""",
    "genders": "SELECT record_id, CASE WHEN lower(trim(gender)) IN ('m', 'male', 'man', 'guy') THEN 'male' WHEN lower(trim(gender)) IN ('f', 'female', 'woman', 'gal', 'girl') THEN 'female' ELSE 'unknown' END AS gender FROM entities",
    "titles": """SELECT p_partkey, t AS title, array_to_string(list_transform(string_split(t, ' '), lambda w: CASE w """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _EXP.items()) + """ ELSE w END), ' ') AS expanded FROM
      (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower('Sr. ' || p_type || ' & Eng., VP'), '[^\\w\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM part)""",
    "affiliation_names": "SELECT record_id, coalesce(CASE " + " ".join(f"WHEN suffix(x, '{s}') THEN trim(substr(x, 1, length(x) - {len(s)}))" for s in W.AFFILIATION_SUFFIXES) + " ELSE x END, '') AS name FROM (SELECT record_id, trim(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS x FROM entities)",
    "sound_keys": f"SELECT DISTINCT word, {_sound_sql('lower(word)')} AS sound_key FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)",
    "first_letter_fit": """SELECT p_partkey, (a = b OR a || b IN (""" + ", ".join(f"'{x}{y}', '{y}{x}'" for x, y in W.FIRST_LETTERS) + """)) AS fits FROM (SELECT p_partkey, lower(substr(p_name, 1, 1)) AS a, lower(substr(p_type, 1, 1)) AS b FROM part)""",
    "source_and_type_filters": """SELECT item_id, CASE WHEN s IN ('OFAC', 'US_OFAC') THEN 'US_OFAC' WHEN s IN ('CSL', 'US_CSL') THEN 'US_CSL' WHEN s IN ('EU_CSL', 'UK_CSL') THEN s END AS source,
      CASE WHEN t IN ('person', 'individual') THEN 'PERSON' WHEN t IN ('business', 'entity') THEN 'BUSINESS' WHEN t IN ('organization', 'vessel', 'aircraft') THEN upper(t) END AS entity_type,
      CASE WHEN upper(source_list) IN ('US_OFAC', 'US_CSL', 'US_NON_SDN', 'EU_CSL', 'UK_CSL') THEN upper(source_list) END AS batch_source,
      CASE WHEN upper(entity_type) IN ('PERSON', 'BUSINESS', 'ORGANIZATION', 'AIRCRAFT', 'VESSEL', 'UNKNOWN') THEN upper(entity_type) END AS batch_type
      FROM (SELECT *, upper(trim(source_list)) AS s, lower(trim(entity_type)) AS t FROM search_items)""",
    "feed_types": """SELECT record_id, CASE WHEN entity_type IS NULL THEN 'UNKNOWN' WHEN t = '' THEN 'BUSINESS' WHEN t = 'individual' THEN 'PERSON' WHEN t = 'entity' THEN 'BUSINESS' WHEN t = 'vessel' THEN 'VESSEL' WHEN t = 'aircraft' THEN 'AIRCRAFT' ELSE 'UNKNOWN' END AS ofac_type,
      CASE WHEN k = 'individual' THEN 'PERSON' WHEN k = 'vessel' THEN 'VESSEL' WHEN k = 'aircraft' THEN 'AIRCRAFT' WHEN k = 'entity' THEN CASE WHEN contains(r, 'military-industrial') OR contains(r, 'cmic') THEN 'ORGANIZATION' ELSE 'BUSINESS' END
      WHEN len(list_filter([""" + ", ".join(f"'{x}'" for x in W.COMPANY_NEEDLES) + """], lambda x: contains(n, x))) > 0 THEN 'BUSINESS' ELSE 'UNKNOWN' END AS csl_type
      FROM (SELECT record_id, entity_type, lower(trim(entity_type)) AS t, lower(coalesce(entity_type, '')) AS k, lower(coalesce(remarks, '')) AS r, lower(coalesce(name, '')) AS n FROM entities)""",
    "program_lists": """SELECT record_id, len(p) AS n, array_to_string(p, '|') AS programs FROM (SELECT record_id, list_filter(string_split_regex(CASE WHEN lower(trim(programs)) IN ('-0-', 'null') THEN '' ELSE trim(regexp_replace(trim(coalesce(programs, '')), '^-0-\\s*', '')) END, '[;\\s]+'), lambda x: x <> '') AS p FROM entities)""",
    "list_info": "SELECT d.segment, count(c_custkey) AS n FROM (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) AS segment) d LEFT JOIN customer ON c_mktsegment = d.segment GROUP BY 1",
    "source_rollup": "SELECT source_list, entity_type, count(*) AS n FROM entities GROUP BY ROLLUP (source_list, entity_type)",
    "date_scores": f"""SELECT l_orderkey, l_linenumber, round({_date_sql('a', 'b')}, 6) AS score, {_days_sql('a', 'b')} AS days_alike, round(life, 6) AS life_score, life > 0.7 AS life_matched FROM
      (SELECT *, ({_date_sql('a', 'b')} + {_date_sql('a2', 'b2')}) / 2 * 0.5 AS life FROM (SELECT l_orderkey, l_linenumber, o_orderdate::date AS a, l_shipdate::date AS b, o_orderdate::date + 20000 AS a2, l_shipdate::date + 25000 AS b2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
    "exact_id_matches": """SELECT c_custkey, s_suppkey, CASE WHEN c_nationkey = s_nationkey THEN 1.0::double ELSE 0.0::double END AS exact, 1.0::double AS live, CASE WHEN c_nationkey = s_nationkey THEN 1.0::double ELSE 0.7::double END AS with_country
      FROM customer JOIN supplier ON regexp_replace(c_name, '[^0-9]', '', 'g') = regexp_replace(s_name, '[^0-9]', '', 'g')""",
    "asset_ids": """SELECT p_partkey, round((15.0::double + CASE WHEN p_size = p_size % 7 THEN 12.0::double ELSE 0.0::double END) / 27.0::double, 6) AS vessel, round((CASE WHEN lower(p_brand) = lower(p_name) THEN 15.0::double ELSE 0.0::double END + 12.0::double) / 27.0::double, 6) AS aircraft FROM part""",
    "weighted_totals": """SELECT l_orderkey, l_linenumber, round(CASE WHEN e >= 0.99 THEN 0.7::double + 0.3::double * b ELSE (b * 35 + a * 25 + d * 15) / (35 + CASE WHEN a > 0 THEN 25 ELSE 0 END + CASE WHEN d > 0 THEN 15 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 50 ELSE 0 END) END, 6) AS total,
      round((n * 35 + a * 25) / 60, 6) AS name_address FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_discount * 10 AS n, greatest(l_discount * 10, l_tax * 10) AS b, l_quantity / 100 AS a, CASE WHEN l_quantity >= 49 THEN 1.0::double ELSE 0.0::double END AS e, CASE WHEN l_linenumber = 1 THEN 1.0::double ELSE 0.0::double END AS d FROM lineitem)""",
    "score_adjustments": """SELECT l_orderkey, l_linenumber, round(adj, 6) AS adjusted, round(f, 6) AS final, l_linenumber >= 2 AND s > 0.85::double AS high, s >= 0.4::double AS close, CASE WHEN f >= 0.9::double THEN 'Strong' WHEN f >= 0.75::double THEN 'Good' WHEN f >= 0.6::double THEN 'Moderate' ELSE 'Weak' END AS quality FROM
      (SELECT *, least(1.0::double, CASE WHEN q > 45 THEN x4 * 1.15::double ELSE x4 END) AS f FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN x3 * 0.95::double ELSE x3 END AS x4 FROM (SELECT *, CASE WHEN l_linenumber < 2 THEN x2 * 0.9::double ELSE x2 END AS x3 FROM
      (SELECT *, CASE WHEN l_tax * 10 < 0.7::double THEN x1 * 0.9::double ELSE x1 END AS x2 FROM (SELECT *, CASE WHEN q / 50 < 0.35::double THEN adj * 0.95::double ELSE adj END AS x1 FROM
      (SELECT *, l_quantity AS q, CASE WHEN l_linenumber >= 2 AND l_linenumber % 3 < 2 AND l_returnflag <> 'A' THEN s * 0.8::double ELSE s END AS adj FROM (SELECT *, l_discount * 10 AS s FROM lineitem)))))))""",
    "mean_scores": """SELECT l_orderkey, l_linenumber, round(coalesce((a * a * a + b * b * b) / nullif(a * a + b * b, 0), 0), 6) AS affiliations, round(coalesce((a + b) / nullif((a > 0)::int + (b > 0)::int, 0), 0), 6) AS supporting,
      round(coalesce((a * 40 + b * 15) / nullif((a > 0)::int * 40 + (b > 0)::int * 15, 0), 0), 6) AS positive, round(greatest(0.0::double, least(1.0::double, a + CASE WHEN b > 0.9::double THEN 0.15::double WHEN b > 0.7::double THEN 0.08::double ELSE -0.15::double END)), 6) AS affiliation
      FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b FROM lineitem)""",
    "program_scores": """SELECT e.record_id, round(coalesce(len(list_filter(e.p, lambda x: list_contains(list_transform(f.p, lambda y: lower(y)), lower(x)))) / nullif(len(e.p), 0), 0)::double * CASE WHEN e.record_id % 2 = f.record_id % 2 THEN 1.0::double ELSE 0.8::double END, 6) AS score
      FROM (SELECT record_id, list_filter(list_transform(string_split_regex(coalesce(programs, ''), '[;,|]+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM entities) e JOIN (SELECT record_id, list_filter(list_transform(string_split_regex(coalesce(programs, ''), '[;,|]+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM entities) f ON e.record_id = f.record_id + 1""",
    "batch_statistics": """WITH x AS (SELECT c_custkey, least(1.0::double, greatest(0.0::double, c_acctbal / 10000)) AS s FROM customer), y AS (SELECT s AS v FROM x WHERE s > 0 UNION ALL SELECT s / 2 FROM x WHERE s > 0), t AS (SELECT count(*) AS n, count(*) FILTER (s > 0) AS w, count(*) FILTER (s <= 0 AND c_custkey % 10 = 0) AS e FROM x)
      SELECT n AS total_items, 2 * w AS total_matches, w AS items_with_matches, n - w - e AS items_without_matches, e AS items_with_errors, (SELECT round(coalesce(avg(v), 0), 6) FROM y) AS average_score, (SELECT count(*) FROM y WHERE v >= 0.9) AS high, (SELECT count(*) FROM y WHERE v >= 0.75 AND v < 0.9) AS medium, (SELECT count(*) FROM y WHERE v < 0.75) AS low,
      round((n - e) / n::double * 100, 6) AS success_rate, round(w / n::double * 100, 6) AS match_rate FROM t""",
    "merge_groups": """SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status, count(*) AS n, (SELECT string_agg(v, '|' ORDER BY m) FROM (SELECT arg_min(o_orderpriority, o_orderkey) AS v, min(o_orderkey) AS m FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY lower(o_orderpriority))) AS priorities FROM orders o GROUP BY o_custkey""",
    "stable_topk": "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3",
    "trace_summaries": """WITH e AS (SELECT user_id AS session_id, CASE WHEN event_type = 'click' THEN 'AGGREGATION' ELSE event_type END AS phase, floor(abs(value))::bigint AS d FROM events), p AS (SELECT session_id, phase, count(*) AS n, floor(avg(d)) AS m, sum(d) AS t FROM e GROUP BY ALL)
      SELECT session_id, sum(CASE WHEN phase = 'AGGREGATION' THEN n ELSE 0 END)::bigint AS entities_scored, CASE WHEN max(m) > 10 THEN arg_max(phase, row(m, phase)) END AS slowest_phase, sum(t)::bigint AS total_ms, arg_max(phase, row(t, phase)) AS longest_phase FROM p GROUP BY session_id""",
    "top_phases": "SELECT * FROM (SELECT user_id AS session_id, event_type AS phase, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY user_id, event_type) WHERE rank <= 3",
    "jaro_scores": """WITH p AS (SELECT DISTINCT p_name, lower(p_type || ' ' || p_brand) AS other FROM part), w AS (SELECT *, length(p_name) AS n, length(other) AS m, greatest(greatest(length(p_name), length(other)) // 2 - 1, 0) AS r FROM p),
      s AS (SELECT *, list_reduce(list_transform(range(1, n + 1), lambda i: i::varchar), lambda s, i: coalesce((list_transform(list_filter(range(greatest(1, i::bigint - r), least(m, i::bigint + r) + 1), lambda j: substr(other, j, 1) = substr(p_name, i::bigint, 1) AND substr(s, j, 1) = '0'),
        lambda j: substr(s, 1, j - 1) || '1' || substr(s, j + 1) || substr(p_name, i::bigint, 1)))[1], s), repeat('0', m)) AS s FROM w),
      k AS (SELECT *, substr(s, m + 1) AS mine, array_to_string(list_transform(list_filter(range(1, m + 1), lambda j: substr(s, j, 1) = '1'), lambda j: substr(other, j, 1)), '') AS theirs FROM s)
      SELECT p_name, other, round(CASE WHEN mine = '' THEN 0.0::double ELSE (length(mine) / n::double + length(mine) / m::double + (length(mine) - len(list_filter(range(1, length(mine) + 1), lambda j: substr(mine, j, 1) <> substr(theirs, j, 1))) / 2.0::double) / length(mine)) / 3.0::double END, 6) AS jaro FROM k""",
    "same_sound_names": f"""WITH p AS (SELECT p_name, len(string_split(p_name, ' ')) AS n, list_sort(list_distinct(list_transform(string_split(lower(p_name), ' '), lambda w: {_sound_sql('w')}))) AS k FROM (SELECT DISTINCT p_name FROM part))
      SELECT a.p_name AS name_a, b.p_name AS name_b FROM p a JOIN p b ON a.n = b.n AND a.k = b.k AND a.p_name <= b.p_name""",
    **TEXT_SQL,
}
