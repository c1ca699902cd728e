"""Queries that run the searches, the comparers and the traces over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ZERO, Weights
from ..functions import compare as C
from ..functions import normalize as N
from ..functions import similarity as S
from ..functions import words as W
from ..operators import report as R
from ..operators import scoring, search, trace
from ..session import table, written
from . import scores_sql as Q
from .lists import _entities, _index_rows

LEAST = 0.8


def _r(c: Column) -> Column:
    return F.round(c, 6)


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return written(_index_rows(_entities(spark, folder)))


def _first_name(index: DataFrame) -> str:
    """The stated query of the single searches: the name of the first record that has one."""
    row = index.where("trim(name) <> ''").orderBy("index_pos").select("name").first()
    return row[0] if row else "nobody"


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set of the batches: every item whose id is divisible by 100, against all entities."""
    x = table(spark, folder, "search_items").where("item_id % 100 = 0")
    return x.select(F.col("item_id").alias("item_pos"), "request_id", "name", "entity_type", F.col("source_list").alias("source"))


# ---- searches


def name_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten entities nearest to one name, the limit clamped."""
    index = _index(spark, folder)
    return search.name_search(index, _first_name(index), LEAST, 10).select("rank", F.col("index_pos").alias("record_id"), "name", _r(F.col("score")).alias("score"))


def filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same among one list and one type, with a threshold and a limit outside their bounds."""
    index = _index(spark, folder)
    return search.name_search(index, _first_name(index), 1.5, 0, source="ofac", entity_type="entity").select("rank", F.col("index_pos").alias("record_id"), _r(F.col("score")).alias("score"))


def batch_screen(spark: SparkSession, folder: str) -> DataFrame:
    """A batch against all entities, five matches each."""
    out = search.batch(_asked(spark, folder), _index(spark, folder), LEAST, 5, most=None)
    return _matches(out)


def _matches(out: DataFrame, more: list[Column] | None = None) -> DataFrame:
    m = out.select(F.col("item_pos").alias("item_id"), "status", F.explode_outer("matches").alias("m"))
    return m.select("item_id", "status", F.col("m.rank").cast("long").alias("rank"), F.col("m.entity_id").alias("entity_id"), F.col("m.source").alias("source"), _r(F.col("m.score")).alias("score"), *(more or []))


def guarded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What is refused: empty and too large batches, a blank name, values out of bounds; and what bounds do."""
    from ..config import BATCH_LEAST_MATCH, BATCH_LIMIT, BATCH_MOST, DEFAULT, WEIGHTS, BadRequest, updated

    asked, index = _asked(spark, folder), _index(spark, folder)
    tries = {
        "empty batch": lambda: search.batch(asked.limit(0), index), "large batch": lambda: search.batch(asked, index, most=1), "blank name": lambda: search.name_search(index, " ", 0.9), "no such mode": lambda: search.index_names(index, "other"),
        "threshold": lambda: updated(WEIGHTS, min_match=1.5), "prefix": lambda: updated(DEFAULT, prefix=-1), "unknown knob": lambda: updated(DEFAULT, other=1), "allowed": lambda: updated(WEIGHTS, min_match=0.5),
    }
    out = []
    for k, f in tries.items():
        try:
            f()
            out.append((k, "accepted"))
        except BadRequest:
            out.append((k, "refused"))
    out += [("most", str(BATCH_MOST)), ("least match", str(BATCH_LEAST_MATCH)), ("limit", str(BATCH_LIMIT)), ("clamped", "{} {}".format(*search.clamped(1000, -1.0)))]
    return spark.createDataFrame(out, "request string, answer string")


def failing_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch some of whose names can't be scored: they have a row with the error, the others are answered."""

    def ready(a: str, config) -> None:
        if len(a.split()) == 2:
            raise ValueError("two words")

    def scorer(a: str, b: str, config) -> float:
        ready(a, config)
        return 1.0

    scorer.ready, scorer.top = ready, 1.0
    out = search.batch(_asked(spark, folder), _index(spark, folder), 0.0, 1, most=None, scorer=scorer)
    return out.select(F.col("item_pos").alias("item_id"), "status", "error", F.size(F.coalesce("matches", F.array())).cast("long").alias("n"))


def address_search(spark: SparkSession, folder: str) -> DataFrame:
    """Names asked with an address: the batch's names, each with the city of the first record that has an address."""
    index = _index(spark, folder)
    first = index.where("size(addresses) > 0").orderBy("index_pos").select(F.get("addresses", F.lit(0))["city"].alias("a")).first()
    asked = _asked(spark, folder).select("item_pos", "name", F.lit(first[0] if first else "").alias("address"), F.lit(None).cast("string").alias("source_f"), F.lit(None).cast("string").alias("type_f"))
    return trace.address_screen(asked, index, LEAST, 5).select(F.col("item_pos").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("index_pos").alias("record_id"), _r(F.col("score")).alias("score"))


def traced_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search with a trace keeps its order; each result has its eight scores."""
    index = _index(spark, folder)
    results, _ = trace.traced_search(index, _first_name(index), LEAST, 10)
    return results.select(F.col("rank").cast("long").alias("rank"), F.col("index_pos").alias("record_id"), *[_r(F.col(f"breakdown.{f}")).alias(f) for f in [*scoring.FACTORS, "total"]], _r(F.col("score")).alias("score"))


NAMES_OFF = Weights(use_alt_names=False)


def traced_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch with a trace, alternative names switched off in the second scoring: it is filtered and ranked again."""
    out, _ = trace.traced_batch(_asked(spark, folder), _index(spark, folder), LEAST, 5, most=None, weights=NAMES_OFF)
    return _matches(out, [_r(F.col("m.breakdown.name")).alias("name_score"), _r(F.col("m.breakdown.alt_names")).alias("alt_score")])


def scoring_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of that batch, as their summary tells them: phases by number, entities scored."""
    _, events = trace.traced_batch(_asked(spark, folder), _index(spark, folder), LEAST, 5, most=None, weights=NAMES_OFF)
    s = events.withColumn("duration_ms", F.lit(1))
    return R.phase_counts(s, 12).select("session_id", "phase", "n").join(R.trace_summary(s).select("session_id", "entities_scored", "slowest_phase"), "session_id")


def search_json(spark: SparkSession, folder: str) -> DataFrame:
    """The answer to a search as one JSON text, read back."""
    index = _index(spark, folder)
    results, _ = trace.traced_search(index, _first_name(index), LEAST, 10)
    one = R.as_json(R.search_hits(results, True), "request-1", trace_id="session-1")
    x = F.from_json("response", "results array<struct<id: string, score: double, breakdown: struct<total: double>>>, total long, requestID string, trace string, reportUrl string")
    return one.select(x.alias("x")).select(F.explode("x.results").alias("r"), F.col("x.total").alias("total"), F.col("x.requestID").alias("request"), F.col("x.reportUrl").alias("report")).select(F.col("r.id").alias("id"), _r(F.col("r.score")).alias("score"), _r(F.col("r.breakdown.total")).alias("breakdown_total"), "total", "request", "report")


# ---- names


def word_jaro(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles of the name score of each part's name against its type."""
    p = table(spark, folder, "part").select("p_name", F.concat(F.lower("p_type"), F.lit(" co")).alias("other")).distinct()
    return p.select("p_name", "other", _r(S.name_score_column("p_name", "other")).alias("score"), _r(S.text_score_column("p_name", "other")).alias("text_score"), _r(S.words_score_zero("p_name", "other")).alias("zero_score"))


def favoured_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score that favours perfect words, of all pairs of part names."""
    p = table(spark, folder, "part").select("p_name").distinct()
    both = p.crossJoin(F.broadcast(p.select(F.col("p_name").alias("other"))))  # 64 names whatever the size
    return both.select("p_name", "other", _r(S.favoured_column("p_name", "other")).alias("favoured"))


def joined_words(spark: SparkSession, folder: str) -> DataFrame:
    """Every name with its short words joined to the next, and to the one before."""
    return table(spark, folder, "entities").select("record_id", S.merged_words_column(N.plain(F.col("name"))).alias("forms"))


def sound_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Words of names that sound alike, and the test of first letters, of each record and the one before it."""
    e = table(spark, folder, "entities").select("record_id", N.plain(F.col("name")).alias("a"))
    both = e.join(e.select((F.col("record_id") + 1).alias("record_id"), F.col("a").alias("b")), "record_id")
    x, y = N.tokens(F.col("a")), N.tokens(F.col("b"))
    return both.select("record_id", N.any_sounds_match(x, y).alias("any"), N.sounds_match(F.coalesce(F.get(x, F.lit(0)), F.lit("")), F.coalesce(F.get(y, F.lit(0)), F.lit(""))).alias("first"), N.filtered_out(F.col("a"), F.col("b")).alias("filtered"), N.is_language(F.col("a"), "en").alias("english"))


def name_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared names of both sides, primary and alternative, of each record and the one before it."""
    e = table(spark, folder, "entities").select("record_id", N.plain(F.col("name")).alias("name"), F.transform("alt_names", N.plain).alias("alts"))
    both = e.join(e.select((F.col("record_id") + 1).alias("record_id"), F.col("name").alias("other"), F.col("alts").alias("others")), "record_id")
    r = scoring.prepared_name_scores("name", "alts", "other", "others")
    return both.select("record_id", _r(r["score"]).alias("score"), r["fields"].cast("long").alias("fields"))


# ---- comparers


def contact_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts of orders against contacts written another way."""
    o = table(spark, folder, "orders")
    none = F.lit(None).cast("string")
    q = F.struct(F.col("o_orderpriority").alias("email"), F.concat(F.lit("+"), F.col("o_custkey").cast("string")).alias("phone"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("fax"), none.alias("website"))
    i = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority"))).otherwise(F.lit("")).alias("email"), (F.col("o_custkey") % 500).cast("string").alias("phone"), F.lower("o_orderstatus").alias("fax"), none.alias("website"))
    lists = C.contact_field_score(F.array("o_orderstatus", "o_orderpriority"), F.array(F.lower("o_orderstatus"), F.lit("o"), F.lit("F")))
    return o.select("o_orderkey", C.live_contact(q, i).alias("live"), _r(C.contact_score(q, i)).alias("score"), _r(lists).alias("field"))


def wallet_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Wallets of line items: addresses to the letter, and without case but with currencies."""
    x = table(spark, folder, "lineitem")
    one = lambda c, a: F.struct(c.alias("currency"), a.alias("address"))
    key = lambda k: F.concat(F.lit("Ab"), F.col(k).cast("string"))
    q = F.array(one(F.col("l_returnflag"), key("l_suppkey")), one(F.lit(""), key("l_linenumber")))
    i = F.array(one(F.col("l_linestatus"), F.upper(key("l_suppkey"))), one(F.lower("l_returnflag"), F.lower(F.concat(F.lit("Ab"), (F.col("l_partkey") % 40).cast("string")))), one(F.lit(None).cast("string"), F.concat(F.lit("Ab"), (F.col("l_orderkey") % 20).cast("string"))))
    return x.select("l_orderkey", "l_linenumber", C.wallets(q, i).alias("score"), C.wallets(q, i, live=True).alias("live"))


def life_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Births and deaths of two persons, years and dates of two ships."""
    o = table(spark, folder, "orders")
    a = F.to_date("o_orderdate")
    k = F.col("o_custkey").cast("int")
    birth, death, born, died = a, F.when(k % 5 > 0, F.date_add(a, 20000 + k % 900)), F.date_add(a, k % 4), F.when(k % 7 > 0, F.date_add(a, 20000 + k % 9000 - F.when(k % 11 == 0, 29000).otherwise(0)))
    p = C.person_dates(birth, death, born, died)
    c = C.company_dates(birth, death, born, died)
    s = C.asset_dates(F.year(a).cast("string"), F.when(k % 2 == 0, F.date_format(a, "yyyy-MM-dd")).otherwise(F.concat(F.lit("about "), F.year(a))))
    return o.select("o_orderkey", _r(p["score"]).alias("person"), p["matched"].alias("matched"), p["fields"].cast("long").alias("fields"), C.lives_logical(birth, death, born, died).alias("logical"), _r(c["score"]).alias("company"), _r(s["score"]).alias("ship"))


def id_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Government ids of each record against those of the record before it, and against its own written another way."""
    e = table(spark, folder, "entities").select("record_id", "government_ids")
    g = lambda f: F.transform("government_ids", f)
    other = g(lambda x: F.struct(F.when(F.length(x["identifier"]) % 3 > 0, x["id_type"]).alias("id_type"), F.concat(F.substring(x["identifier"], 1, 2), F.lit("-"), F.lower(F.substring(x["identifier"], 3, 1000))).alias("identifier"), F.when(F.length(x["identifier"]) % 2 == 0, F.upper(x["country"])).alias("country")))
    prev = e.select((F.col("record_id") + 1).alias("record_id"), F.col("government_ids").alias("prev"))
    x = e.join(prev, "record_id", "left").withColumn("other", other)
    q = F.col("government_ids")
    return x.select("record_id", C.live_gov_id(q, F.col("other")).alias("live"), C.exact_ids(q, F.col("other")).alias("exact"), C.live_gov_id(q, F.col("prev")).alias("live_prev"), C.gov_ids_with_country(q, F.transform("other", lambda y: F.struct(y["id_type"], F.replace(y["identifier"], F.lit("-"), F.lit("")).alias("identifier"), y["country"]))).alias("with_country"))


def _near_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of addresses of one postal code and house number."""
    fields = ("line1", "line2", "city", "state", "postal_code", "country")
    x = table(spark, folder, "prepared_addresses").where("trim(postal_code) <> ''").select("address_id", "postal_code", F.regexp_extract("line1", "[0-9]+", 0).alias("no"), F.struct(*fields).alias("a")).where("no <> ''")
    return x.select(F.col("address_id").alias("x"), "postal_code", "no", F.col("a").alias("q")).join(x.select(F.col("address_id").alias("y"), "postal_code", "no", F.col("a").alias("i")), ["postal_code", "no"]).where("x < y")


def address_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of addresses as lists of one are compared, field by field, and as searches compare them."""
    x = _near_addresses(spark, folder)
    score = C.address_list_score(F.array(N.scored_address(F.col("q"))), F.array(N.scored_address(F.col("i"))))
    return x.select(F.col("x").alias("address_id_a"), F.col("y").alias("address_id_b"), _r(score).alias("score"), _r(C.live_address_column(F.array("q"), F.array("i"))).alias("live"))


def title_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Titles made of part types: the best pair, and the first good one."""
    p = table(spark, folder, "part").select("p_name", F.lower("p_type").alias("t")).distinct()
    title = lambda *cs: N.expanded_title(N.title(F.concat_ws(" ", *cs)))
    q, i = F.array(title("p_name"), title(F.lit("VP,"), "t")), F.array(title(F.lit("chief"), "p_name"), title("p_name", F.lit("a")), title(F.lit("vice president"), "t"))
    return p.select("p_name", "t", _r(C.title_list_score(q, i)).alias("best"), _r(C.first_good_title(q, i)).alias("first_good"))


def affiliation_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Affiliations of each record against those of the next: names of companies, kinds of ties."""
    kinds = F.array(*[F.lit(x) for x in ("owned by", "subsidiary of", "led by", "neighbour")])
    e = table(spark, folder, "entities").select("record_id", "name", F.get(kinds, (F.col("record_id") % 4).cast("int")).alias("kind"))
    one = lambda n, k: F.struct(n.alias("entity_name"), k.alias("type"))
    nxt = e.select((F.col("record_id") - 1).alias("record_id"), F.col("name").alias("name2"), F.col("kind").alias("kind2"))
    x = e.join(nxt, "record_id")
    q = F.array(one(F.col("name"), F.col("kind")), one(F.concat_ws(" ", "name", F.lit("holdings")), F.lit("owned by")))
    i = F.array(one(F.concat_ws(" ", "name", F.lit("ltd")), F.col("kind2")), one(F.col("name2"), F.col("kind")))
    p = scoring.affiliation_piece(q, i)
    return x.select("record_id", _r(p["score"]).alias("score"), p["matched"].alias("matched"), p["exact"].alias("exact"), _r(C.affiliation_kind_score(F.col("kind"), F.col("kind2"))).alias("kind_score"))


def history_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Former names of each record against those of the next."""
    e = table(spark, folder, "entities").select("record_id", "name")
    x = e.join(e.select((F.col("record_id") - 1).alias("record_id"), F.col("name").alias("other")), "record_id")
    one = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    q, i = F.array(one("Former Name", F.col("name"))), F.array(one("former name", F.col("other")), one("Flag", F.col("name")))
    return x.select("record_id", _r(C.history_score(q, i)).alias("score"))


# ---- whole entities


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of one list under one id without its letter case and separators: the keys are joined first, the wide records to the pairs."""
    e = _entities(spark, folder)
    key = e.where("source_id IS NOT NULL").select("record_id", "source_list", F.regexp_replace(F.lower("source_id"), "[^a-z0-9]", "").alias("k")).where("k <> ''")
    two = key.select("source_list", "k", F.col("record_id").alias("x")).join(key.select("source_list", "k", F.col("record_id").alias("y")), ["source_list", "k"]).where("x < y").select("x", "y")
    i = _index_rows(e)
    wide = written(i.select("index_pos", F.struct(*[F.lit(None).cast("string").alias(c) if c == "source_id" else F.col(c) for c in i.columns]).alias("e")))
    return two.join(wide.select(F.col("index_pos").alias("x"), F.col("e").alias("q")), "x").join(wide.select(F.col("index_pos").alias("y"), F.col("e").alias("i")), "y")


def entity_breakdowns(spark: SparkSession, folder: str) -> DataFrame:
    """The eight scores of pairs of records."""
    out = scoring.breakdown(_pairs(spark, folder))
    return out.select(F.col("x").alias("record_id_a"), F.col("y").alias("record_id_b"), *[_r(F.col(f"breakdown.{f}")).alias(f) for f in [*scoring.FACTORS, "total"]])


def entity_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The comparisons of pairs of records as pieces, with coverage and importance."""
    out = scoring.with_pieces(_pairs(spark, folder))
    flat = out.select("x", "y", F.explode("pieces").alias("p"), F.col("coverage.ratio").alias("coverage"), "importance").where("p.kind NOT IN ('name', 'address')")
    return flat.select(F.col("x").alias("record_id_a"), F.col("y").alias("record_id_b"), "p.kind", _r(F.col("p.score")).alias("score"), F.col("p.fields").cast("long").alias("fields"), "p.matched", "p.exact")


def field_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many fields each record has, by the part of its kind, and the coverage of two compared fields."""
    i = _index_rows(_entities(spark, folder)).alias("i")
    n = scoring.available_fields("i")
    two = F.array(F.struct(F.lit(2).alias("fields")))
    return i.select(F.col("i.index_pos").alias("record_id"), n.cast("long").alias("fields"), _r(C.coverage(two, n)["ratio"]).alias("coverage"))


def score_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Breakdowns in words: explanation, short line, lines of the debug text, insights and bands."""
    x = table(spark, folder, "lineitem")
    zero = F.lit(0.0)
    b = F.struct(F.round(F.col("l_quantity") / 50, 4).alias("name"), F.round(F.col("l_discount") * 10, 4).alias("alt_names"), zero.alias("address"), F.round(F.col("l_tax") * 10, 4).alias("gov_id"), zero.alias("crypto"), zero.alias("contact"), zero.alias("date"), F.round(F.col("l_quantity") / 60, 4).alias("total"))
    rows = x.select("l_orderkey", "l_linenumber", b.alias("b"), F.struct(F.col("l_returnflag").alias("name"), F.lit("PERSON").alias("entity_type")).alias("e"))
    c = F.col("b")
    return rows.select(
        "l_orderkey", "l_linenumber", R.explained(c).alias("text"), R.short_explained(c).alias("short"), F.md5(R.debug_text(F.col("e"), F.col("e"), c)).alias("debug_md5"), F.array_join(R.insights(c, F.col("l_linenumber") * 40), "; ").alias("insights"), R.band(c["total"]).alias("band"),
        R.name_text(c["name"]).alias("name_text"), R.total_text(c["total"]).alias("total_text"),
    )


def report_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of sessions for reports: one session a user, the phases of its events, its last breakdown."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "click", "AGGREGATION").otherwise(F.upper("event_type")).alias("phase"), F.floor(F.abs("value")).cast("long").alias("duration_ms"))
    n = lambda k: (F.col("session_id") % k) / k
    zero = F.lit(0.0)
    b = e.select("session_id").distinct().select("session_id", F.struct(n(10).alias("name"), n(7).alias("alt_names"), zero.alias("address"), n(2).alias("gov_id"), zero.alias("crypto"), zero.alias("contact"), zero.alias("date"), n(9).alias("total")).alias("breakdown"))
    s = R.report_summary(e, b)
    entry = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.4f", x["value"].cast("double")))), " ")
    return s.select("session_id", F.col("entities_scored").cast("long").alias("entities_scored"), _r(F.col("average_score")).alias("average"), _r(F.col("highest_score")).alias("highest"), entry(F.col("contributions")).alias("contributions"), entry(F.col("phase_ms")).alias("phase_ms"), "slowest_phase")


def trace_store(spark: SparkSession, folder: str) -> DataFrame:
    """A store of traces after two puts and a delete: rows left by session."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("phase"))
    t = R.Traces(e)
    t.put(e.where("phase = 'error'"))
    t.delete("1")
    return t.table.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("of_two", F.lit(t.get("2").count()).cast("long"))


QUERIES = {
    "name_search": name_search, "filtered_search": filtered_search, "batch_screen": batch_screen, "guarded_batches": guarded_batches, "failing_batch": failing_batch, "address_search": address_search, "traced_search": traced_search, "traced_batch": traced_batch,
    "scoring_events": scoring_events, "search_json": search_json, "word_jaro": word_jaro, "favoured_scores": favoured_scores, "joined_words": joined_words, "sound_matches": sound_matches, "name_sides": name_sides, "contact_scores": contact_scores,
    "wallet_scores": wallet_scores, "life_scores": life_scores, "id_scores": id_scores, "address_scores": address_scores, "title_scores": title_scores, "affiliation_scores": affiliation_scores, "history_scores": history_scores, "entity_breakdowns": entity_breakdowns,
    "entity_pieces": entity_pieces, "field_counts": field_counts, "score_texts": score_texts, "report_summaries": report_summaries, "trace_store": trace_store,
}


# ---- SQL


def _screen_sql(asked: str, least: float) -> str:
    """Tables up to best (k, record_id, score): every name of asked (k, x, sf, tf) against every name of every record."""
    return f"""a AS MATERIALIZED ({asked}), h AS MATERIALIZED (SELECT DISTINCT record_id, source_list AS s, upper(trim(entity_type)) AS t, {Q.plain('n')} AS y FROM (SELECT record_id, source_list, entity_type, unnest(list_concat([name], coalesce(alt_names, []))) AS n FROM entities)),
      ax AS MATERIALIZED (SELECT x, tx, {Q.sounds('tx')} AS kx FROM (SELECT x, {Q.tokens('x')} AS tx FROM (SELECT DISTINCT x FROM a WHERE x <> ''))), hy AS MATERIALIZED (SELECT y, ty, {Q.sounds('ty')} AS ky FROM (SELECT y, {Q.tokens('y')} AS ty FROM (SELECT DISTINCT y FROM h WHERE y <> ''))),
      f AS MATERIALIZED (SELECT x, y, tx, ty, len(tx) = len(ty) AND kx = ky AS same, {Q.jaro('x', 'y')} AS f FROM ax, hy),
      g AS MATERIALIZED (SELECT x, y, CASE WHEN same THEN 1.0::double ELSE {Q.words_score('tx', 'ty')} END AS score FROM f WHERE same OR (len(tx) = 1 AND len(ty) = 1) OR 0.6 + 0.4 * f >= {least} - 1e-9),
      best AS MATERIALIZED (SELECT k, record_id, max(score) AS score FROM a JOIN g USING (x) JOIN h USING (y) WHERE score >= {least} AND (sf IS NULL OR sf = s) AND (tf IS NULL OR tf = t) GROUP BY k, record_id),
      ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, record_id) AS rank FROM best)"""


_ONE = f"SELECT 0 AS k, {Q.plain('name')} AS x, NULL::varchar AS sf, NULL::varchar AS tf FROM (SELECT name FROM entities WHERE trim(name) <> '' ORDER BY record_id LIMIT 1)"
_ITEMS = f"SELECT item_id AS k, {Q.plain('name')} AS x, CASE WHEN upper(source_list) IN ({Q.quoted(W.SOURCES)}) THEN upper(source_list) END AS sf, CASE WHEN upper(entity_type) IN ({Q.quoted(W.ENTITY_TYPES)}) THEN upper(entity_type) END AS tf FROM search_items WHERE item_id % 100 = 0"
# the names of the winners, each with its own score
_WON = f"""w AS MATERIALIZED (SELECT k, rank, record_id, first, tx, {Q.tokens('y')} AS ty FROM (SELECT r.k, r.rank, r.record_id, {Q.tokens('a.x')} AS tx, o.first, {Q.plain('o.n')} AS y FROM ranked r JOIN a USING (k) JOIN (SELECT record_id, true AS first, name AS n FROM entities UNION ALL SELECT record_id, false, unnest(alt_names) FROM entities) o USING (record_id) WHERE r.rank <= LIMIT_OF)),
      v AS MATERIALIZED (SELECT k, rank, record_id, coalesce(max(s) FILTER (first), 0) AS name, coalesce(max(s) FILTER (NOT first), 0) AS alt FROM (SELECT *, CASE WHEN len(ty) = 0 THEN 0.0::double ELSE {Q.read_words_score('tx', 'ty')} END AS s FROM w) GROUP BY k, rank, record_id)"""
_SPLIT = "list_filter(string_split_regex(coalesce({x}, ''), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> '')"


def _fit(a: str, b: str) -> str:
    swaps = Q.quoted([x + y for x, y in W.FIRST_LETTERS] + [y + x for x, y in W.FIRST_LETTERS])
    f, g = f"substr({a}, 1, 1)", f"substr({b}, 1, 1)"
    return f"({a} = '' OR {b} = '' OR {f} = {g} OR {f} || {g} IN ({swaps}) OR (regexp_matches({f}, '\\p{{Nd}}') AND regexp_matches({g}, '\\p{{Nd}}')))"


def _text_sql(a: str, b: str, fit: str, c) -> str:
    """text_score of two plain columns whose test of first letters is a column."""
    p, q = Q.name(), Q.name()
    all_ = f"list_max(flatten(list_transform({Q.merged_words(Q.tokens(a))}, lambda {p}: list_transform({Q.merged_words(Q.tokens(b))}, lambda {q}: {Q.words_score(p, q, c)}))))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::double WHEN {a} = {b} THEN 1.0::double WHEN NOT {fit} THEN 0.0::double ELSE least(1.0::double, greatest(0.0::double, {all_})) END"


def _merged_sql(a: str, b: str) -> str:
    """merged_score of two token columns, all nought."""
    p, q = Q.name(), Q.name()
    return f"list_max(flatten(list_transform({Q.merged_words(a)}, lambda {p}: list_transform({Q.merged_words(b)}, lambda {q}: {Q.words_score(p, q, ZERO)}))))"


def _title_sql(columns: str) -> str:
    """title_pair_score of the columns ta, tb (word lists of more than a letter), a, b and pa, pb, the plain texts of the word lists."""
    return f"CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0.0::double WHEN a = b THEN 1.0::double WHEN len(ta) = 0 OR len(tb) = 0 OR pa = '' OR pb = '' THEN 0.0::double ELSE ({Q.read_words_score('wa', 'wb', ZERO)}) * (1.0::double - 0.1::double * abs(len(ta) - len(tb))) END"


def _titles_sql(pairs: str, key: str) -> str:
    """From pairs ({key}, o, a, b) a table s with the score of each."""
    return f"""p AS MATERIALIZED ({pairs}), d0 AS MATERIALIZED (SELECT a, b, list_filter({_SPLIT.format(x='a')}, lambda w: length(w) > 1) AS ta, list_filter({_SPLIT.format(x='b')}, lambda w: length(w) > 1) AS tb FROM (SELECT DISTINCT a, b FROM p)),
      d1 AS MATERIALIZED (SELECT *, {Q.plain("array_to_string(ta, ' ')")} AS pa, {Q.plain("array_to_string(tb, ' ')")} AS pb FROM d0), d AS MATERIALIZED (SELECT *, {Q.tokens('pa')} AS wa, {Q.tokens('pb')} AS wb FROM d1),
      s AS MATERIALIZED (SELECT p.*, t.s FROM p JOIN (SELECT a, b, {_title_sql('')} AS s FROM d) t ON p.a IS NOT DISTINCT FROM t.a AND p.b IS NOT DISTINCT FROM t.b)"""


def _expanded(c: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\\w\\s-]', '', 'g'), '\\s+', ' ', 'g'))"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in W.TITLE_WORDS.items())
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


def _affiliation(c: str) -> str:
    x = f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    v = Q.name()
    return f"list_transform([{x}], lambda {v}: coalesce(CASE " + " ".join(f"WHEN suffix({v}, '{s}') THEN trim(substr({v}, 1, length({v}) - {len(s)}))" for s in W.AFFILIATION_SUFFIXES) + f" ELSE {v} END, ''))[1]"


_FAMILY = "CASE {k} " + " ".join(f"WHEN '{k}' THEN '{g}'" for g, ks in W.AFFILIATION_GROUPS.items() for k in ks) + " ELSE '' END"
_KIND_SCORE = f"CASE WHEN kq = ki THEN 1.0::double WHEN {_FAMILY.format(k='kq')} <> '' AND {_FAMILY.format(k='kq')} = {_FAMILY.format(k='ki')} THEN 0.8::double ELSE 0.0::double END"
_BARE = "lower(regexp_replace(coalesce({x}, ''), '[^a-zA-Z0-9]', '', 'g'))"


def _any_id(q: str, i: str, test: str) -> str:
    """1 if any pair of ids a of q and b of i passes."""
    return f"CASE WHEN len(list_filter(coalesce({q}, []), lambda ia: len(list_filter(coalesce({i}, []), lambda ib: coalesce({test}, false))) > 0)) > 0 THEN 1.0::double ELSE 0.0::double END"


_LIVE_ID = f"{_BARE.format(x='ia.identifier')} = {_BARE.format(x='ib.identifier')} AND coalesce(ia.id_type = ib.id_type, true)"
_EXACT_ID = "ia.id_type IS NOT DISTINCT FROM ib.id_type AND ia.country IS NOT DISTINCT FROM ib.country AND lower(replace(ia.identifier, '-', '')) = lower(replace(ib.identifier, '-', ''))"
_COUNTRY_ID = """CASE WHEN NOT coalesce(lower(ia.identifier) = lower(ib.identifier), false) THEN 0.0::double WHEN coalesce(ia.country, '') = '' AND coalesce(ib.country, '') = '' THEN 1.0::double WHEN coalesce(ia.country, '') = '' OR coalesce(ib.country, '') = '' THEN 0.9::double
      WHEN lower(ia.country) = lower(ib.country) THEN 1.0::double ELSE 0.7::double END"""


def _country_ids(q: str, i: str) -> str:
    return f"coalesce(list_max(flatten(list_transform(coalesce({q}, []), lambda ia: list_transform(coalesce({i}, []), lambda ib: {_COUNTRY_ID})))), 0.0::double)"


_OTHER_IDS = "list_transform(government_ids, lambda x: {'id_type': CASE WHEN length(x.identifier) % 3 > 0 THEN x.id_type END, 'identifier': substr(x.identifier, 1, 2) || '-' || lower(substr(x.identifier, 3)), 'country': CASE WHEN length(x.identifier) % 2 = 0 THEN upper(x.country) END})"
_NO_HYPHEN = "list_transform(other, lambda x: {'id_type': x.id_type, 'identifier': replace(x.identifier, '-', ''), 'country': x.country})"
_KEY = "regexp_replace(lower(source_id), '[^a-z0-9]', '', 'g')"
_TWO = f"""k AS (SELECT *, {_KEY} AS key, upper(trim(entity_type)) AS kind FROM entities WHERE source_id IS NOT NULL), two AS MATERIALIZED (SELECT q.record_id AS x, i.record_id AS y, q, i FROM (SELECT k AS q, * FROM k WHERE key <> '') q JOIN (SELECT k AS i, * FROM k) i ON q.source_list = i.source_list AND q.key = i.key AND q.record_id < i.record_id)"""
_PARTIES = "('PERSON', 'BUSINESS', 'ORGANIZATION')"


def _live_addresses(pairs: str) -> str:
    """Tables up to near (x, y, s): the best live score of addresses p, r of pairs (x, y, p, r)."""
    return f"""ap AS MATERIALIZED ({pairs}), ad AS MATERIALIZED (SELECT *, {_fit('ca', 'cb')} AS fit, {Q.tokens('la')} AS ta, {Q.tokens('lb')} AS tb FROM (SELECT DISTINCT p.line1 AS l1, r.line1 AS l2, p.city AS c1, r.city AS c2, {Q.plain("p.line1")} AS la, {Q.plain("r.line1")} AS lb, {Q.plain("p.city")} AS ca, {Q.plain("r.city")} AS cb FROM ap)),
      al AS MATERIALIZED (SELECT l1, l2, c1, c2, 0.3::double * (CASE WHEN coalesce(c1, '') = '' OR coalesce(c2, '') = '' THEN 0.0::double ELSE {_text_sql('ca', 'cb', 'fit', Q.DEFAULT)} END) + 0.4::double * (CASE WHEN coalesce(l1, '') = '' OR coalesce(l2, '') = '' THEN 0.0::double ELSE {Q.read_words_score('ta', 'tb')} END) AS s FROM ad),
      near AS MATERIALIZED (SELECT x, y, max(least(1.0::double, s + CASE WHEN coalesce(p.country, '') <> '' AND lower(p.country) = lower(r.country) THEN 0.3::double ELSE 0.0::double END)) AS s FROM ap JOIN al ON l1 IS NOT DISTINCT FROM p.line1 AND l2 IS NOT DISTINCT FROM r.line1 AND c1 IS NOT DISTINCT FROM p.city AND c2 IS NOT DISTINCT FROM r.city GROUP BY x, y)"""


def _scored(f: str) -> str:
    return f"trim(lower(translate(coalesce({f}, ''), ',.#', '')))"


def _lines(f: str) -> str:
    return f"list_filter(string_split_regex({_scored(f)}, '\\s+'), lambda w: w <> '')"


_PERCENT = "trunc({x} * 100)::int::varchar || '%'"


def _parts_sql(names: dict) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} > 0 THEN '{v}' || {_PERCENT.format(x=k)} END" for k, v in names.items()) + "], lambda x: x IS NOT NULL), ', ')"


def _texts_sql(texts: list, score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least}::double THEN '{text}'" for least, text in texts[:-1]) + f" ELSE '{texts[-1][1]}' END"


_DEBUG = "'=== Debug Similarity ===' || chr(10) || 'Query: ' || e || ' (PERSON)' || chr(10) || 'Index: ' || e || ' (PERSON)' || chr(10) || chr(10) || 'Score Components:' || chr(10)"
for _label, _f in {"Name Score:": "n", "Alt Names:": "al", "Gov ID Score:": "g", "Crypto Score:": "0.0::double", "Address Score:": "0.0::double", "Contact Score:": "0.0::double", "Date Score:": "0.0::double"}.items():
    _DEBUG += f" || '  {_label:<18}' || printf('%.4f', {_f}) || chr(10)"
_DEBUG += " || chr(10) || 'Final Score: ' || printf('%.4f', t) || chr(10) || 'Match: ' || CASE WHEN t > 0.5 THEN 'true' ELSE 'false' END || ' (threshold 0.5)' || chr(10) || chr(10)"
_QUALITY = "CASE WHEN t >= 0.9::double THEN 'Strong' WHEN t >= 0.75::double THEN 'Good' WHEN t >= 0.6::double THEN 'Moderate' ELSE 'Weak' END"
_CYRILLIC_ETC = "[\\x{0400}-\\x{052f}\\x{0600}-\\x{06ff}\\x{0750}-\\x{077f}\\x{08a0}-\\x{08ff}\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]"


def _date(a: str, b: str) -> str:
    from .reference import _date_sql

    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0::double ELSE {_date_sql(a, b)} END"


_BOTH = "(birth IS NOT NULL AND born IS NOT NULL)::int + (death IS NOT NULL AND died IS NOT NULL)::int"
_MEAN = f"coalesce(({_date('birth', 'born')} + {_date('death', 'died')}) / nullif({_BOTH}, 0), 0)"
_MATCHES = """SELECT i.item_id, CASE WHEN count(m.record_id) OVER (PARTITION BY i.item_id) > 0 THEN 'SUCCESS' ELSE 'NO_MATCHES' END AS status, m.rank, m.record_id::varchar AS entity_id, e.source_list AS source, round(m.score, 6) AS score{more} FROM (SELECT item_id FROM search_items WHERE item_id % 100 = 0) i
      LEFT JOIN {ranked} m ON m.k = i.item_id AND m.rank <= 5 LEFT JOIN entities e USING (record_id)"""
_CITY = "(SELECT addresses[1].city FROM entities WHERE len(addresses) > 0 ORDER BY record_id LIMIT 1)"
_ZEROS = ", ".join(f"0.0::double AS {f}" for f in scoring.FACTORS if f not in ("name", "alt_names"))
_PIECES = """SELECT x AS record_id_a, y AS record_id_b, p.kind, round(p.score, 6) AS score, p.fields::bigint AS fields, p.matched, p.exact FROM (SELECT x, y, unnest([
      {{'kind': 'identifiers', 'score': e, 'fields': (e > 0)::int, 'matched': e > 0.5, 'exact': e > 0.99}}, {{'kind': 'gov-ids-exact', 'score': c, 'fields': (c > 0)::int, 'matched': c > 0.5, 'exact': c > 0.99}},
      {{'kind': 'crypto-exact', 'score': 0.0::double, 'fields': 0, 'matched': false, 'exact': false}}, {{'kind': 'contact-exact', 'score': 0.0::double, 'fields': 0, 'matched': false, 'exact': false}}, {{'kind': 'source', 'score': 1.0::double, 'fields': 1, 'matched': true, 'exact': true}},
      {{'kind': 'dates', 'score': d, 'fields': dn, 'matched': d > 0.7::double, 'exact': d > 0.99::double}}, {{'kind': 'title-fuzzy', 'score': t, 'fields': tn, 'matched': t > 0.5::double, 'exact': t > 0.99::double}}, {{'kind': 'supporting', 'score': u, 'fields': CASE WHEN u > 0 THEN 1 ELSE 0 END, 'matched': u > 0.5, 'exact': u > 0.99}}]) AS p FROM z)"""
_PROGRAMS = "string_split_regex({x}.programs, '[;,|]')"
_TITLES = "CASE WHEN {x}.kind = 'PERSON' THEN [{x}.programs] WHEN {x}.kind IN ('BUSINESS', 'ORGANIZATION') AND trim({x}.name) <> '' THEN [{x}.name] END"

SQL = {
    "name_search": f"WITH {_screen_sql(_ONE, LEAST)} SELECT rank, record_id, e.name, round(score, 6) AS score FROM ranked JOIN entities e USING (record_id) WHERE rank <= 10",
    "filtered_search": f"WITH {_screen_sql(_ONE.replace('NULL::varchar AS sf, NULL::varchar AS tf', "'US_OFAC' AS sf, 'BUSINESS' AS tf"), 1.0)} SELECT rank, record_id, round(score, 6) AS score FROM ranked WHERE rank <= 1",
    "batch_screen": f"WITH {_screen_sql(_ITEMS, LEAST)} {_MATCHES.format(ranked='ranked', more='')}",
    "guarded_batches": "SELECT * FROM (VALUES ('empty batch', 'refused'), ('large batch', 'refused'), ('blank name', 'refused'), ('no such mode', 'refused'), ('threshold', 'refused'), ('prefix', 'refused'), ('unknown knob', 'refused'), ('allowed', 'accepted'), ('most', '1000'), ('least match', '0.88'), ('limit', '10'), ('clamped', '100 0.0')) t(request, answer)",
    "failing_batch": f"""WITH a AS ({_ITEMS}), n AS (SELECT k, x, len({Q.tokens('x')}) AS words, EXISTS (SELECT 1 FROM entities WHERE (sf IS NULL OR sf = source_list) AND (tf IS NULL OR tf = upper(trim(entity_type)))) AS there FROM a)
      SELECT k AS item_id, CASE WHEN words = 2 THEN 'ERROR' WHEN words > 0 AND there THEN 'SUCCESS' ELSE 'NO_MATCHES' END AS status, CASE WHEN words = 2 THEN 'two words' END AS error, CASE WHEN words NOT IN (0, 2) AND there THEN 1 ELSE 0 END AS n FROM n""",
    "address_search": f"""WITH {_screen_sql(_ITEMS.replace('CASE WHEN upper(source_list) IN', 'CASE WHEN false AND upper(source_list) IN').replace('CASE WHEN upper(entity_type) IN', 'CASE WHEN false AND upper(entity_type) IN'), LEAST)},
      c AS MATERIALIZED (SELECT x, {Q.tokens('x')} AS tx FROM (SELECT {Q.plain(_CITY)} AS x)), ae AS MATERIALIZED (SELECT DISTINCT record_id, {Q.plain("concat_ws(' ', a.line1, a.line2, a.city, a.state, a.postal_code, a.country)")} AS y FROM (SELECT record_id, unnest(addresses) AS a FROM entities)),
      an AS MATERIALIZED (SELECT y, max(CASE WHEN len(ty) = 0 THEN 0.0::double ELSE {Q.read_words_score('tx', 'ty')} END) AS s FROM c, (SELECT y, {Q.tokens('y')} AS ty FROM (SELECT DISTINCT y FROM ae)) GROUP BY y),
      place AS MATERIALIZED (SELECT e.record_id, coalesce(max(an.s), 0) AS near FROM entities e LEFT JOIN ae USING (record_id) LEFT JOIN an USING (y) WHERE e.addresses IS NOT NULL GROUP BY e.record_id),
      pn AS MATERIALIZED (SELECT e.record_id, near, {Q.plain('e.name')} AS y FROM place JOIN entities e USING (record_id)),
      fp AS MATERIALIZED (SELECT f.x, f.y, CASE WHEN same THEN 1.0::double ELSE {Q.words_score('tx', 'ty')} END AS score FROM f JOIN (SELECT y, max(near) AS near FROM pn GROUP BY y) USING (y) WHERE same OR (len(tx) = 1 AND len(ty) = 1) OR (0.6 + 0.4 * f) * 35 + near * 25 >= {LEAST} * 60 - 1e-9),
      all_ AS (SELECT k, record_id, (score * 35 + near * 25) / 60 AS score FROM a JOIN fp USING (x) JOIN pn USING (y) UNION ALL SELECT k, record_id, score FROM best JOIN entities e USING (record_id) WHERE e.addresses IS NULL)
      SELECT * FROM (SELECT k AS item_id, record_id, round(score, 6) AS score, row_number() OVER (PARTITION BY k ORDER BY score DESC, record_id) AS rank FROM all_ WHERE score >= {LEAST}) WHERE rank <= 5""",
    "traced_search": f"WITH {_screen_sql(_ONE, LEAST)}, {_WON.replace("LIMIT_OF", "10")} SELECT rank, record_id, round(name, 6) AS name, round(alt, 6) AS alt_names, {_ZEROS}, round(greatest(name, alt), 6) AS total, round(greatest(name, alt), 6) AS score FROM v",
    "search_json": f"WITH {_screen_sql(_ONE, LEAST)}, {_WON.replace("LIMIT_OF", "10")} SELECT record_id::varchar AS id, round(greatest(name, alt), 6) AS score, round(greatest(name, alt), 6) AS breakdown_total, count(*) OVER () AS total, 'request-1' AS request, '/api/reports/session-1' AS report FROM v",
    "traced_batch": f"WITH {_screen_sql(_ITEMS, LEAST)}, {_WON.replace("LIMIT_OF", "5")}, again AS (SELECT k, record_id, name AS score, row_number() OVER (PARTITION BY k ORDER BY name DESC, rank) AS rank FROM v WHERE name >= {LEAST}) {_MATCHES.format(ranked='again', more=', round(m.score, 6) AS name_score, CASE WHEN m.record_id IS NOT NULL THEN 0.0::double END AS alt_score')}",
    "scoring_events": f"""WITH {_screen_sql(_ITEMS, LEAST)} SELECT k AS session_id, phase, n, n AS entities_scored, NULL::varchar AS slowest_phase FROM (SELECT k, count(*) AS n FROM ranked WHERE rank <= 5 GROUP BY k),
      (SELECT unnest(['NORMALIZATION', 'NAME_COMPARISON', 'GOV_ID_COMPARISON', 'CRYPTO_COMPARISON', 'ADDRESS_COMPARISON', 'CONTACT_COMPARISON', 'DATE_COMPARISON', 'AGGREGATION']) AS phase)""",
    "word_jaro": f"""WITH p AS MATERIALIZED (SELECT *, {Q.tokens('p_name')} AS ta, {Q.tokens('other')} AS tb, {_fit('p_name', 'other')} AS fit FROM (SELECT DISTINCT p_name, lower(p_type) || ' co' AS other FROM part))
      SELECT p_name, other, round({Q.read_words_score('ta', 'tb')}, 6) AS score, round({_text_sql('p_name', 'other', 'fit', Q.DEFAULT)}, 6) AS text_score, round({Q.words_score('ta', 'tb', ZERO)}, 6) AS zero_score FROM p""",
    "favoured_scores": f"""WITH p AS MATERIALIZED (SELECT DISTINCT p_name, {Q.tokens('p_name')} AS t FROM part), w AS MATERIALIZED (SELECT DISTINCT unnest(t) AS w FROM p), s AS MATERIALIZED (SELECT a.w AS a, b.w AS b, CASE WHEN a.w = b.w THEN 1.0::double WHEN NOT {_fit('a.w', 'b.w')} THEN 0.0::double ELSE least(1.0::double, greatest(0.0::double, {Q.word_score('a.w', 'b.w', ZERO)})) END AS s FROM w a, w b),
      x AS (SELECT p.p_name, o.p_name AS other, len(p.t) AS n, len(o.t) AS m, unnest(range(1, len(p.t) + 1)) AS i, p.t, o.t AS u FROM p, p o), y AS (SELECT *, unnest(range(greatest(1, i - 3), least(m, i + 2) + 1)) AS j FROM x),
      z AS (SELECT p_name, other, n, m, i, length(any_value(t[i])) AS lw, max(s) AS top, length(arg_max(b, [s, -j])) AS lt FROM (SELECT y.*, s.s, s.b FROM y JOIN s ON s.a = t[i] AND s.b = u[j]) GROUP BY p_name, other, n, m, i)
      SELECT p_name, other, round(least(1.0::double, avg(CASE WHEN top >= 1 THEN CASE WHEN m > n AND greatest(n, m) > 3 THEN top * n / m WHEN n = 1 AND m > 1 THEN top * 0.9 ELSE top + 0.05::double END WHEN m > n THEN top * n / m ELSE top * least(lw / greatest((CASE WHEN top > 0 THEN lt ELSE 0 END) - 1.0::double, CASE WHEN (CASE WHEN top > 0 THEN lt ELSE 0 END) > 1 THEN 0 ELSE 1 END), 1) END)), 6) AS favoured FROM z GROUP BY p_name, other""",
    "joined_words": f"SELECT record_id, array_to_string(list_transform({Q.merged_words('t')}, lambda x: array_to_string(x, ' ')), '|') AS forms FROM (SELECT record_id, {Q.tokens('n')} AS t FROM (SELECT record_id, {Q.plain('name')} AS n FROM entities))",
    "sound_matches": f"""WITH e AS MATERIALIZED (SELECT record_id, n AS a, list_transform({Q.tokens('n')}, lambda w: {Q.sound('w')}) AS k FROM (SELECT record_id, {Q.plain('name')} AS n FROM entities))
      SELECT e.record_id, list_has_any(e.k, f.k) AS any, coalesce(e.k[1] = f.k[1], false) AS first, NOT {_fit('e.a', 'f.a')} AS filtered, NOT (regexp_matches(e.a, '{_CYRILLIC_ETC}') OR (length(e.a) >= 3 AND length(e.a) < 30 AND NOT regexp_matches(e.a, '(^| )(the|a|of)( |$)') AND regexp_matches(e.a, '(^| )(el|la|de|del)( |$)'))) AS english FROM e JOIN e f ON e.record_id = f.record_id + 1""",
    "name_sides": f"""WITH e AS MATERIALIZED (SELECT record_id, {Q.plain('name')} AS n, coalesce(alt_names, []) AS alts FROM entities), al AS MATERIALIZED (SELECT record_id, {Q.tokens('x')} AS t FROM (SELECT record_id, {Q.plain('a')} AS x FROM (SELECT record_id, unnest(alts) AS a FROM e))),
      b AS MATERIALIZED (SELECT e.record_id, {Q.tokens('e.n')} AS t, {Q.tokens('f.n')} AS u, len(e.alts) > 0 AND len(f.alts) > 0 AS both_ FROM e JOIN e f ON e.record_id = f.record_id + 1), m AS MATERIALIZED (SELECT x.record_id, max({Q.words_score('x.t', 'y.t', ZERO)}) AS s FROM al x JOIN al y ON x.record_id = y.record_id + 1 GROUP BY x.record_id)
      SELECT record_id, round(coalesce((CASE WHEN len(t) > 0 AND len(u) > 0 THEN {Q.words_score('t', 'u', ZERO)} ELSE 0 END + CASE WHEN both_ THEN coalesce(m.s, 0) ELSE 0 END) / nullif((len(t) > 0 AND len(u) > 0)::int + both_::int, 0), 0), 6) AS score, (len(t) > 0 AND len(u) > 0)::int + both_::int AS fields FROM b LEFT JOIN m USING (record_id)""",
    "contact_scores": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_custkey = o_custkey % 500 THEN 1.0::double ELSE 0.0::double END AS live, round((CASE WHEN o_orderkey % 2 = 0 AND lower(o_orderpriority) = ' ' || lower(o_orderpriority) THEN 1 ELSE 0 END + (o_orderkey % 3 > 0)::int) / (1.0::double + (o_orderkey % 2 = 0)::int + (o_orderkey % 3 > 0)::int), 6) AS score,
      round((1 + 2 * (lower(o_orderstatus) = 'o')::int - (lower(o_orderstatus) = 'o')::int + (lower(o_orderstatus) = 'f')::int + (lower(o_orderpriority) = lower(o_orderstatus))::int) / 2.0::double, 6) AS field FROM orders""",
    "wallet_scores": """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey = l_partkey % 40 OR l_linenumber = l_partkey % 40 OR l_suppkey = l_orderkey % 20 OR l_linenumber = l_orderkey % 20 OR (l_returnflag = l_linestatus) OR (l_linenumber = l_suppkey) THEN 1.0::double ELSE 0.0::double END AS score,
      CASE WHEN l_suppkey = l_orderkey % 20 OR l_linenumber = l_orderkey % 20 THEN 1.0::double ELSE 0.0::double END AS live FROM lineitem""",
    "life_scores": f"""WITH o AS (SELECT o_orderkey, o_orderdate::date AS a, o_custkey::int AS k FROM orders), d AS (SELECT *, a AS birth, CASE WHEN k % 5 > 0 THEN a + (20000 + k % 900) END AS death, a + k % 4 AS born, CASE WHEN k % 7 > 0 THEN a + (20000 + k % 9000 - CASE WHEN k % 11 = 0 THEN 29000 ELSE 0 END) END AS died FROM o),
      l AS (SELECT *, coalesce(CASE WHEN death - birth < 0 OR died - born < 0 THEN false ELSE coalesce(greatest(death - birth, died - born)::double / nullif(least(death - birth, died - born), 0) <= 1.21::double, true) END, true) AS logical, {_MEAN} AS mean, {_BOTH} AS fields FROM d)
      SELECT o_orderkey, round(CASE WHEN logical THEN mean ELSE mean * 0.5 END, 6) AS person, CASE WHEN logical THEN mean ELSE mean * 0.5 END > 0.7::double AS matched, fields, logical, round(mean, 6) AS company, round(CASE WHEN k % 2 = 0 THEN {_date("make_date(year(a), 1, 1)", "a")} ELSE 0 END, 6) AS ship FROM l""",
    "id_scores": f"""WITH e AS MATERIALIZED (SELECT record_id, government_ids, {_OTHER_IDS} AS other FROM entities) SELECT e.record_id, {_any_id('e.government_ids', 'e.other', _LIVE_ID)} AS live, {_any_id('e.government_ids', 'e.other', _EXACT_ID)} AS exact, {_any_id('e.government_ids', 'f.government_ids', _LIVE_ID)} AS live_prev,
      {_country_ids('e.government_ids', _NO_HYPHEN.replace('other', 'e.other'))} AS with_country FROM e LEFT JOIN e f ON e.record_id = f.record_id + 1""",
    "address_scores": f"""WITH x AS (SELECT *, regexp_extract(line1, '[0-9]+', 0) AS no FROM prepared_addresses WHERE trim(postal_code) <> ''), pr AS MATERIALIZED (SELECT x.address_id AS x, y.address_id AS y, x AS p, y AS r FROM x JOIN x y ON x.postal_code = y.postal_code AND x.no = y.no AND x.no <> '' AND x.address_id < y.address_id), {_live_addresses('SELECT * FROM pr')},
      w AS MATERIALIZED (SELECT DISTINCT unnest([{{'a': {_scored('p.line1')}, 'b': {_scored('r.line1')}}}, {{'a': {_scored('p.line2')}, 'b': {_scored('r.line2')}}}, {{'a': {_scored('p.city')}, 'b': {_scored('r.city')}}}]) AS w FROM pr), ws AS MATERIALIZED (SELECT w.a AS a, w.b AS b, ta, tb FROM (SELECT w, {_lines('w.a')} AS ta, {_lines('w.b')} AS tb FROM w)),
      s AS MATERIALIZED (SELECT a, b, {_merged_sql('ta', 'tb')} AS s FROM ws WHERE len(ta) > 0 AND len(tb) > 0),
      f AS (SELECT pr.x, pr.y, 5 AS w, s.s FROM pr JOIN s ON s.a = {_scored('p.line1')} AND s.b = {_scored('r.line1')} UNION ALL SELECT pr.x, pr.y, 2, s.s FROM pr JOIN s ON s.a = {_scored('p.line2')} AND s.b = {_scored('r.line2')} UNION ALL SELECT pr.x, pr.y, 4, s.s FROM pr JOIN s ON s.a = {_scored('p.city')} AND s.b = {_scored('r.city')}
        UNION ALL SELECT x, y, 2, ({_scored('p.state')} = {_scored('r.state')})::int FROM pr WHERE {_scored('p.state')} <> '' AND {_scored('r.state')} <> '' UNION ALL SELECT x, y, 3, ({_scored('p.postal_code')} = {_scored('r.postal_code')})::int FROM pr WHERE {_scored('p.postal_code')} <> '' AND {_scored('r.postal_code')} <> ''
        UNION ALL SELECT x, y, 4, (c = d)::int FROM (SELECT x, y, trim(lower(translate(coalesce(p.country, ''), '.', ''))) AS c, trim(lower(translate(coalesce(r.country, ''), '.', ''))) AS d FROM pr) WHERE c <> '' AND d <> '')
      SELECT pr.x AS address_id_a, pr.y AS address_id_b, round(coalesce(t.s, 0), 6) AS score, round(near.s, 6) AS live FROM pr LEFT JOIN (SELECT x, y, sum(w * s) / sum(w) AS s FROM f GROUP BY x, y) t ON t.x = pr.x AND t.y = pr.y JOIN near ON near.x = pr.x AND near.y = pr.y""",
    "title_scores": f"""WITH b AS (SELECT DISTINCT p_name, lower(p_type) AS t FROM part), qi AS (SELECT p_name, t, [{_expanded('p_name')}, {_expanded("'VP, ' || t")}] AS q, [{_expanded("'chief ' || p_name")}, {_expanded("p_name || ' a'")}, {_expanded("'vice president ' || t")}] AS i FROM b),
      {_titles_sql("SELECT p_name, t AS tt, k * 3 + j AS o, q[k] AS a, i[j] AS b FROM (SELECT *, unnest([1, 1, 1, 2, 2, 2]) AS k, unnest([1, 2, 3, 1, 2, 3]) AS j FROM qi)", '')}
      SELECT p_name, tt AS t, round(greatest(0, max(s)), 6) AS best, round(coalesce(arg_min(s, o) FILTER (s > 0.92::double), greatest(0, max(s))), 6) AS first_good FROM s GROUP BY p_name, tt""",
    "affiliation_scores": f"""WITH e AS (SELECT record_id, name, ['owned by', 'subsidiary of', 'led by', 'neighbour'][record_id % 4 + 1] AS kind FROM entities), x AS MATERIALIZED (SELECT e.record_id, e.name, e.kind, f.name AS name2, f.kind AS kind2 FROM e JOIN e f ON f.record_id = e.record_id + 1),
      p AS MATERIALIZED (SELECT record_id, unnest([1, 1, 2, 2]) AS qn, unnest([1, 2, 1, 2]) AS o, unnest([{{'n': name, 'k': kind}}, {{'n': name, 'k': kind}}, {{'n': concat_ws(' ', name, 'holdings'), 'k': 'owned by'}}, {{'n': concat_ws(' ', name, 'holdings'), 'k': 'owned by'}}]) AS q, unnest([{{'n': concat_ws(' ', name, 'ltd'), 'k': kind2}}, {{'n': name2, 'k': kind}}, {{'n': concat_ws(' ', name, 'ltd'), 'k': kind2}}, {{'n': name2, 'k': kind}}]) AS i FROM x),
      t AS MATERIALIZED (SELECT record_id, qn, o, q.k AS kq, i.k AS ki, {_affiliation('q.n')} AS a, {_affiliation('i.n')} AS b FROM p), d AS MATERIALIZED (SELECT a, b, {Q.words_score('ta', 'tb', ZERO)} AS n FROM (SELECT a, b, {Q.tokens('a')} AS ta, {Q.tokens('b')} AS tb FROM (SELECT DISTINCT a, b FROM t WHERE a <> '' AND b <> ''))),
      s AS (SELECT *, greatest(0.0::double, least(1.0::double, n + CASE WHEN kind > 0.9 THEN 0.15::double WHEN kind > 0.7 THEN 0.08::double ELSE -0.15::double END)) AS final FROM (SELECT t.*, d.n, {_KIND_SCORE} AS kind FROM t JOIN d USING (a, b))),
      b AS (SELECT record_id, qn, arg_max(n, [final, kind, -o]) AS n, arg_max(final, [final, kind, -o]) AS final, arg_max(kind, [final, kind, -o]) AS kind FROM s WHERE final > 0 OR kind > 0 GROUP BY record_id, qn),
      r AS (SELECT record_id, coalesce(sum(final * final * final) / nullif(sum(final * final), 0), 0) AS score FROM b WHERE n > 0 GROUP BY record_id)
      SELECT x.record_id, round(coalesce(score, 0), 6) AS score, coalesce(score, 0) > 0.85::double AS matched, coalesce(score, 0) > 0.95::double AS exact, {_KIND_SCORE.replace('kq', 'x.kind').replace('ki)', 'x.kind2)').replace('= ki', '= x.kind2').replace('CASE ki', 'CASE x.kind2')} AS kind_score FROM x LEFT JOIN r USING (record_id)""",
    "history_scores": f"""WITH e AS MATERIALIZED (SELECT record_id, {Q.plain('name')} AS n FROM entities), x AS MATERIALIZED (SELECT e.record_id, e.n AS a, f.n AS b, {_fit('e.n', 'f.n')} AS fit FROM e JOIN e f ON f.record_id = e.record_id + 1) SELECT record_id, round({_text_sql('a', 'b', 'fit', ZERO)}, 6) AS score FROM x""",
    "entity_breakdowns": f"""WITH {_TWO}, nm AS MATERIALIZED (SELECT x, y, true AS first, q.name AS a, i.name AS b FROM two UNION ALL SELECT x, y, false, q.name, unnest(i.alt_names) FROM two), nd AS MATERIALIZED (SELECT x, y, first, {Q.tokens('pa')} AS ta, {Q.tokens('pb')} AS tb FROM (SELECT x, y, first, {Q.plain('a')} AS pa, {Q.plain('b')} AS pb FROM nm WHERE trim(a) <> '' AND b <> '')),
      ns AS (SELECT x, y, max(s) FILTER (first) AS name, max(s) FILTER (NOT first) AS alt FROM (SELECT x, y, first, {Q.read_words_score('ta', 'tb')} AS s FROM nd) GROUP BY x, y), {_live_addresses("SELECT x, y, p, unnest(i.addresses) AS r FROM (SELECT x, y, i, unnest(q.addresses) AS p FROM two)")},
      b AS (SELECT x, y, coalesce(name, 0.0::double) AS name, coalesce(alt, 0.0::double) AS alt_names, coalesce(near.s, 0.0::double) AS address, {_any_id('q.government_ids', 'i.government_ids', _LIVE_ID)} AS gov_id, CASE WHEN q.kind = 'PERSON' AND i.kind = 'PERSON' AND q.birth_date = i.birth_date THEN 1.0::double ELSE 0.0::double END AS date FROM two LEFT JOIN ns USING (x, y) LEFT JOIN near USING (x, y))
      SELECT x AS record_id_a, y AS record_id_b, round(name, 6) AS name, round(alt_names, 6) AS alt_names, round(address, 6) AS address, gov_id, 0.0::double AS crypto, 0.0::double AS contact, date,
      round(CASE WHEN gov_id >= 0.99 THEN 0.7::double + 0.3::double * greatest(name, alt_names) ELSE (greatest(name, alt_names) * 35 + address * 25 + gov_id * 50 + date * 15) / (35 + (address > 0)::int * 25 + (gov_id > 0)::int * 50 + (date > 0)::int * 15) END, 6) AS total FROM b""",
    "entity_pieces": f"""WITH {_TWO}, {_titles_sql(f"SELECT x, y, 0 AS o, unnest({_TITLES.format(x='q')}) AS a, unnest({_TITLES.format(x='i')}) AS b FROM two WHERE len({_TITLES.format(x='q')}) > 0 AND len({_TITLES.format(x='i')}) > 0", '')},
      z AS (SELECT two.x, two.y, CASE WHEN q.kind IN {_PARTIES} AND q.kind = i.kind THEN {_any_id('q.government_ids', 'i.government_ids', _EXACT_ID)} ELSE 0.0::double END AS e, CASE WHEN q.kind IN {_PARTIES} AND q.kind = i.kind THEN {_country_ids('q.government_ids', 'i.government_ids')} ELSE 0.0::double END AS c,
        CASE WHEN q.kind IN ('PERSON', 'BUSINESS') AND q.kind = i.kind THEN {_date('q.birth_date', 'i.birth_date')} ELSE 0.0::double END AS d, CASE WHEN q.kind IN ('PERSON', 'BUSINESS') AND q.kind = i.kind AND q.birth_date IS NOT NULL AND i.birth_date IS NOT NULL THEN 1 ELSE 0 END AS dn, greatest(0.0::double, coalesce(s.s, 0.0::double)) AS t, (s.x IS NOT NULL)::int AS tn,
        CASE WHEN q.programs IS NULL OR i.programs IS NULL THEN 0.0::double ELSE len(list_filter({_PROGRAMS.format(x='q')}, lambda a: list_contains(list_transform({_PROGRAMS.format(x='i')}, lambda b: lower(b)), lower(a)))) / len({_PROGRAMS.format(x='q')})::double END AS u FROM two LEFT JOIN s USING (x, y))
      {_PIECES.format()}""",
    "field_counts": """WITH e AS (SELECT *, upper(trim(entity_type)) AS kind, (name <> '')::int AS has_name, (len(alt_names) > 0)::int AS has_alts, (len(government_ids) > 0)::int AS has_ids, (birth_date IS NOT NULL)::int AS has_birth, (coalesce(addresses[1].country, '') <> '')::int AS has_flag FROM entities), n AS (SELECT record_id, CASE kind WHEN 'PERSON' THEN has_birth + 1 + coalesce(has_ids, 0) + coalesce(has_alts, 0)
      WHEN 'BUSINESS' THEN coalesce(has_name, 0) + coalesce(has_alts, 0) + coalesce(has_ids, 0) + has_birth WHEN 'ORGANIZATION' THEN coalesce(has_name, 0) + coalesce(has_alts, 0) + coalesce(has_ids, 0) WHEN 'VESSEL' THEN coalesce(has_name, 0) + has_flag + coalesce(has_alts, 0) WHEN 'AIRCRAFT' THEN coalesce(has_name, 0) + has_flag + coalesce(has_alts, 0) ELSE 0 END
      + coalesce(has_name, 0) + (source_list IS NOT NULL)::int + coalesce((len(addresses) > 0)::int, 0) + coalesce(has_alts, 0) + coalesce(has_ids, 0) AS fields FROM e) SELECT record_id, fields, round(coalesce(2.0::double / nullif(fields, 0), 1.0::double), 6) AS coverage FROM n""",
    "score_texts": f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS e, round(l_quantity / 50, 4) AS n, round(l_discount * 10, 4) AS al, round(l_tax * 10, 4) AS g, round(l_quantity / 60, 4) AS t FROM lineitem)
      SELECT l_orderkey, l_linenumber, 'Score factors: ' || {_parts_sql({'n': 'Primary name match: ', 'al': 'Alternative names: ', 'g': 'Government ID: '})} || '. Final weighted score: ' || {_PERCENT.format(x='t')} AS text, {_QUALITY} || ' match: ' || {_parts_sql({'n': 'Name ', 'al': 'Alt Names ', 'g': 'Gov ID '})} AS short, md5({_DEBUG}) AS debug_md5,
      array_to_string(list_filter([CASE WHEN n > 0.9::double AND t < 0.85::double THEN 'Strong name match, but limited supporting evidence from other fields' END, CASE WHEN (n > 0.85::double)::int + (al > 0.85::double)::int + (g > 0.85::double)::int >= 3 THEN 'High confidence match with multiple strong indicators' END,
        CASE WHEN n > 0.8::double AND al = 0 AND g = 0 THEN 'Match based solely on name similarity - consider requesting additional identifying information' END, CASE WHEN l_linenumber * 40 > 100 THEN 'Processing took longer than usual (' || (l_linenumber * 40)::varchar || 'ms) - consider optimizing or reviewing data quality' END], lambda y: y IS NOT NULL), '; ') AS insights,
      CASE WHEN t >= 0.9::double THEN 'very high' WHEN t >= 0.7::double THEN 'high' WHEN t >= 0.5::double THEN 'medium' WHEN t >= 0.3::double THEN 'low' ELSE 'very low' END AS band, {_texts_sql(R.NAME_TEXTS, 'n')} AS name_text, {_texts_sql(R.TOTAL_TEXTS, 't')} AS total_text FROM x""",
    "report_summaries": """WITH e AS (SELECT user_id AS s, CASE WHEN event_type = 'click' THEN 'AGGREGATION' ELSE upper(event_type) END AS phase, floor(abs(value))::bigint AS d FROM events), p AS (SELECT s, phase, sum(d)::bigint AS ms, count(*) AS n FROM e GROUP BY ALL)
      SELECT s AS session_id, sum(CASE WHEN phase = 'AGGREGATION' THEN n ELSE 0 END)::bigint AS entities_scored, round((s % 9) / 9.0::double, 6) AS average, round((s % 9) / 9.0::double, 6) AS highest,
      array_to_string(list_filter([CASE WHEN s % 7 > 0 THEN 'alt_names=' || printf('%.4f', (s % 7) / 7.0::double) END, CASE WHEN s % 2 > 0 THEN 'gov_id=' || printf('%.4f', (s % 2) / 2.0::double) END, CASE WHEN s % 10 > 0 THEN 'name=' || printf('%.4f', (s % 10) / 10.0::double) END], lambda x: x IS NOT NULL), ' ') AS contributions,
      string_agg(phase || '=' || printf('%.4f', ms::double), ' ' ORDER BY phase) AS phase_ms, arg_max(phase, row(ms, phase)) AS slowest_phase FROM p GROUP BY s""",
    "trace_store": "SELECT session_id, count(*) AS n, (SELECT count(*) + count(*) FILTER (event_type = 'error') FROM events WHERE user_id = 2) AS of_two FROM (SELECT user_id::varchar AS session_id FROM events WHERE user_id <> 1 UNION ALL SELECT user_id::varchar FROM events WHERE event_type = 'error' AND user_id <> 1) GROUP BY session_id",
}
