"""Scores of an entity asked against entities of the index, factor by factor, over a table of pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, WEIGHTS, Similarity, Weights
from ..functions import compare as C
from ..functions import similarity as S

FACTORS = ["name", "alt_names", "address", "gov_id", "crypto", "contact", "date"]


def name_factors(query: Column, name: Column, alt_names: Column, prepared: Column | None = None, config: Similarity = DEFAULT) -> tuple[Column, Column]:
    """Scores of the primary and of the best alternative name; prepared names are used where there are any."""

    @F.pandas_udf("struct<name: double, alt_names: double>")
    def score(q: pd.Series, n: pd.Series, alts: pd.Series, pn: pd.Series, palts: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, xs, p, ps in zip(q, n, alts, pn, palts, strict=True):
            if a is None or not a.strip():
                out.append((0.0, 0.0))
                continue
            first = S.prepared_score(a, [p], config) if p else S.name_score(a, b, config)
            some = ps is not None and len(ps)
            rest = S.prepared_score(a, list(ps), config) if some else max((S.name_score(a, x, config) for x in (xs if xs is not None else []) if x and x.strip()), default=0.0)
            out.append((first, rest))
        return pd.DataFrame(out, columns=["name", "alt_names"])

    none = F.lit(None).cast("string")
    p = prepared["name"] if prepared is not None else none
    ps = prepared["alt_names"] if prepared is not None else F.lit(None).cast("array<string>")
    both = score(query, name, alt_names, p, ps)
    return both["name"], both["alt_names"]


def breakdown(pairs: DataFrame, q: str = "q", i: str = "i", weights: Weights = WEIGHTS, config: Similarity = DEFAULT) -> DataFrame:
    """Adds ``breakdown``, the eight scores of entity structs ``q`` and ``i``. Disabled factors score nothing; equal source ids score one in everything."""
    col = lambda t, f: F.col(f"{t}.{f}")
    on = lambda flag, c: c if flag else F.lit(0.0)
    name, alts = name_factors(col(q, "name"), col(i, "name"), col(i, "alt_names"), F.col(f"{i}.prepared"), config)
    with_names = pairs.withColumn("_n", F.struct(name.alias("name"), alts.alias("alt_names"), C.live_address_column(col(q, "addresses"), col(i, "addresses")).alias("address")))
    born = (col(q, "person.birth_date") == col(i, "person.birth_date"))
    f = {
        "name": on(weights.use_name, F.col("_n.name")), "alt_names": on(weights.use_alt_names, F.col("_n.alt_names")), "address": on(weights.use_address, F.col("_n.address")),
        "gov_id": on(weights.use_gov_id, C.live_gov_id(col(q, "government_ids"), col(i, "government_ids"))), "crypto": on(weights.use_crypto, C.wallets(col(q, "crypto_addresses"), col(i, "crypto_addresses"), live=True)),
        "contact": on(weights.use_contact, C.live_contact(F.col(f"{q}.contact"), F.col(f"{i}.contact"))), "date": on(weights.use_date, F.when(F.coalesce(born, F.lit(False)), 1.0).otherwise(0.0)),
    }
    a, b = F.trim(col(q, "source_id")), F.trim(col(i, "source_id"))
    both = F.coalesce((a != "") & (b != ""), F.lit(False))
    same = both & (col(q, "source_id") == col(i, "source_id"))
    differs = both & (col(q, "source_id") != col(i, "source_id"))
    total = C.factor_total(f, weights, differs)
    return with_names.withColumn("breakdown", F.struct(*[F.when(same, 1.0).otherwise(f[k]).alias(k) for k in FACTORS], F.when(same, 1.0).otherwise(total).alias("total"))).drop("_n")


def best_name_score(pairs: DataFrame, prepared: bool = False) -> DataFrame:
    """Adds ``score`` to pairs (query, name, alt_names[, prepared]): the better of the primary and alternative names."""
    name, alts = name_factors(F.col("query"), F.col("name"), F.col("alt_names"), F.col("prepared") if prepared else None)
    return pairs.withColumn("score", F.greatest(name, alts))


def piece(kind: str, score: Column, weight: float, fields: Column, required: bool, matched: Column, exact: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), score.alias("score"), F.lit(weight).alias("weight"), fields.cast("int").alias("fields"), F.lit(required).alias("required"), matched.alias("matched"), exact.alias("exact"))


def exact_id_piece(q: str = "q", i: str = "i") -> Column:
    """Exact identifiers by the type of the entity asked."""
    kind = F.col(f"{q}.entity_type")
    ids = lambda p: C.exact_ids(F.col(f"{q}.{p}.government_ids"), F.col(f"{i}.{p}.government_ids"))
    score = (
        F.when(kind == "PERSON", ids("person")).when(kind == "BUSINESS", ids("business")).when(kind == "ORGANIZATION", ids("organization"))
        .when(kind == "VESSEL", C.vessel_ids(F.col(f"{q}.vessel"), F.col(f"{i}.vessel"))).when(kind == "AIRCRAFT", C.aircraft_ids(F.col(f"{q}.aircraft"), F.col(f"{i}.aircraft"))).otherwise(0.0)
    )
    return piece("identifiers", F.coalesce(score, F.lit(0.0)), 50.0, F.when(score > 0, 1).otherwise(0), True, F.coalesce(score > 0.5, F.lit(False)), F.coalesce(score > 0.99, F.lit(False)))


def source_piece(q: str = "q", i: str = "i") -> Column:
    same = F.coalesce(F.col(f"{q}.source") == F.col(f"{i}.source"), F.lit(False))
    return piece("source", F.when(same, 1.0).otherwise(0.0), 0.0, F.when(F.col(f"{q}.source").isNotNull(), 1).otherwise(0), False, same, same)




def by_type(e: str, **choices: Column) -> Column:
    """A value by the type of an entity struct."""
    out = None
    for k, c in choices.items():
        hit = F.col(f"{e}.entity_type") == k.upper()
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out


def gov_id_piece(q: str = "q", i: str = "i", weight: float = 50.0) -> Column:
    """Government ids with countries, of persons, businesses and organizations."""
    score = F.coalesce(by_type(q, **{k: C.gov_ids_with_country(F.col(f"{q}.{k}.government_ids"), F.col(f"{i}.{k}.government_ids")) for k in ("person", "business", "organization")}), F.lit(0.0))
    return piece("gov-ids-exact", score, weight, F.when(score > 0, 1).otherwise(0), True, score > 0.5, score > 0.99)


def wallet_piece(q: str = "q", i: str = "i", weight: float = 50.0) -> Column:
    score = C.wallets(F.col(f"{q}.crypto_addresses"), F.col(f"{i}.crypto_addresses"))
    return piece("crypto-exact", score, weight, F.when(score > 0, 1).otherwise(0), False, score > 0.5, score > 0.99)


def contact_piece(q: str = "q", i: str = "i", weight: float = 50.0) -> Column:
    """Null contacts compare nothing."""
    a, b = F.col(f"{q}.contact"), F.col(f"{i}.contact")
    n = sum((F.when(F.coalesce(~C.nothing(a[f]) & ~C.nothing(b[f]), F.lit(False)), 1).otherwise(0) for f in ("email", "phone", "fax")), F.lit(0))
    score = C.contact_score(a, b)
    return piece("contact-exact", score, weight, n, False, score > 0, score > 0.99)


def date_piece(q: str = "q", i: str = "i", weight: float = 15.0) -> Column:
    two = lambda k, f, g: C.company_dates(F.col(f"{q}.{k}.{f}"), F.col(f"{q}.{k}.{g}"), F.col(f"{i}.{k}.{f}"), F.col(f"{i}.{k}.{g}"))
    person = C.person_dates(F.col(f"{q}.person.birth_date"), F.col(f"{q}.person.death_date"), F.col(f"{i}.person.birth_date"), F.col(f"{i}.person.death_date"))
    built = lambda k: C.asset_dates(F.col(f"{q}.{k}.built"), F.col(f"{i}.{k}.built"))
    r = by_type(q, person=person, business=two("business", "created", "dissolved"), organization=two("organization", "created", "dissolved"), vessel=built("vessel"), aircraft=built("aircraft"))
    score = F.coalesce(r["score"], F.lit(0.0))
    return piece("dates", score, weight, F.coalesce(r["fields"], F.lit(0)), False, F.coalesce(r["matched"], F.lit(False)), score > 0.99)


def address_piece(q: str = "q", i: str = "i", weight: float = 25.0) -> Column:
    from ..functions.normalize import scored_address

    a, b = F.col(f"{q}.addresses"), F.col(f"{i}.addresses")
    score = C.address_list_score(F.transform(a, scored_address), F.transform(b, scored_address))
    both = F.coalesce((F.size(a) > 0) & (F.size(b) > 0), F.lit(False))
    return piece("address", score, weight, F.when(both, 1).otherwise(0), False, score > 0.5, score > 0.99)


def titles_of(e: str) -> Column:
    """What an entity is compared by as a title: a person's titles, a company's name, the type of an aircraft or vessel."""
    one = lambda c: F.when(F.trim(c) != "", F.array(c))
    return by_type(e, person=F.col(f"{e}.person.titles"), business=one(F.col(f"{e}.business.name")), organization=one(F.col(f"{e}.organization.name")), aircraft=one(F.col(f"{e}.aircraft.type")), vessel=one(F.col(f"{e}.vessel.type")))


def title_piece(q: str = "q", i: str = "i", weight: float = 15.0) -> Column:
    a, b = titles_of(q), titles_of(i)
    score = C.title_list_score(a, b)
    both = F.coalesce((F.size(a) > 0) & (F.size(b) > 0), F.lit(False))
    return piece("title-fuzzy", score, weight, F.when(both, 1).otherwise(0), False, score > 0.5, score > 0.99)


def affiliation_piece(q: Column, i: Column, weight: float = 15.0) -> Column:
    """Affiliations are arrays of struct(entity_name, type); they aren't fields of an entity."""
    score = C.affiliation_list_score(C.read_affiliations(q), C.read_affiliations(i))
    return piece("affiliations", score, weight, F.when(F.coalesce(F.size(q) > 0, F.lit(False)), 1).otherwise(0), False, score > 0.85, score > 0.95)


def supporting_piece(q: str = "q", i: str = "i", weight: float = 15.0) -> Column:
    a, b = F.col(f"{q}.sanctions"), F.col(f"{i}.sanctions")
    h, k = F.col(f"{q}.historical"), F.col(f"{i}.historical")
    programs = F.when(a.isNotNull() & b.isNotNull(), C.programs_score(a, b)).otherwise(0.0)
    score = C.supporting_score(programs, C.history_score(h, k))
    n = F.when(a.isNotNull() & b.isNotNull(), 1).otherwise(0) + F.when(F.coalesce((F.size(h) > 0) & (F.size(k) > 0), F.lit(False)), 1).otherwise(0)
    return piece("supporting", score, weight, F.when(score > 0, n).otherwise(0), False, score > 0.5, score > 0.99)


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("fields", T.IntegerType())]))
def prepared_name_scores(q: pd.Series, qs: pd.Series, i: pd.Series, js: pd.Series) -> pd.DataFrame:
    """Prepared names of both sides: the mean of the primary names' score and the best pair of alternative names, of what both have."""
    from ..config import ZERO

    words = lambda t: (t or "").split()
    out = []
    for a, xs, b, ys in zip(q, qs, i, js, strict=True):
        got = [S.words_score(words(a), words(b), ZERO)] if a and b else []
        if xs is not None and len(xs) and ys is not None and len(ys):
            got.append(max(S.words_score(words(x), words(y), ZERO) for x in xs for y in ys))
        out.append((sum(got) / len(got) if got else 0.0, len(got)))
    return pd.DataFrame(out, columns=["score", "fields"])


def name_piece(q: str = "q", i: str = "i", weight: float = 35.0) -> Column:
    r = prepared_name_scores(F.col(f"{q}.prepared.name"), F.col(f"{q}.prepared.alt_names"), F.col(f"{i}.prepared.name"), F.col(f"{i}.prepared.alt_names"))
    return piece("name", r["score"], weight, r["fields"], True, r["score"] > 0.5, r["score"] > 0.99)


def available_fields(e: str = "i") -> Column:
    """How many fields an entity has: those of its type record, the first there is, and the common ones."""
    c = lambda f: F.col(f"{e}.{f}")
    texts = lambda k, *fs: {f"t_{f}": c(f"{k}.{f}") for f in fs}
    lists = lambda k, *fs: {f"l_{f}": c(f"{k}.{f}") for f in fs}
    dates = lambda k, *fs: {f: c(f"{k}.{f}") for f in fs}
    own = {
        "person": dates("person", "birth_date", "death_date") | texts("person", "gender", "place_of_birth") | lists("person", "titles", "government_ids", "alt_names"),
        "business": texts("business", "name") | lists("business", "alt_names", "government_ids") | dates("business", "created", "dissolved"),
        "organization": texts("organization", "name") | lists("organization", "alt_names", "government_ids") | dates("organization", "created", "dissolved"),
        "vessel": texts("vessel", "name", "type", "flag", "call_sign", "tonnage", "owner", "imo_number", "built", "mmsi") | lists("vessel", "alt_names"),
        "aircraft": texts("aircraft", "name", "type", "flag", "serial_number", "model", "built", "icao_code") | lists("aircraft", "alt_names"),
    }
    special = F.coalesce(*[F.when(c(k).isNotNull(), C.field_count(fs)) for k, fs in own.items()], F.lit(0))
    common = {"t_name": c("name"), "source": c("source")} | texts("contact", "email", "phone", "fax") | {f"l_{f}": c(f) for f in ("crypto_addresses", "addresses", "alt_names", "government_ids")}
    return special + C.field_count(common)


def with_pieces(pairs: DataFrame, q: str = "q", i: str = "i") -> DataFrame:
    """Adds ``pieces``, all comparisons of two entity structs, with ``coverage`` and ``importance``."""
    all_ = [f(q, i) for f in (name_piece, exact_id_piece, gov_id_piece, wallet_piece, contact_piece, source_piece, date_piece, address_piece, title_piece, supporting_piece)]
    out = pairs.withColumn("pieces", F.array(*all_))
    n = available_fields(i)
    return out.withColumn("coverage", F.when(n == 0, F.struct(F.lit(1.0).alias("ratio"), F.lit(1.0).alias("critical_ratio"))).otherwise(C.coverage(F.col("pieces"), n))).withColumn("importance", C.importance(F.col("pieces")))
