"""Comparers of entity parts as column expressions: dates, identifiers, contacts, addresses, titles, affiliations, programmes.

Where the result of an early stop differs from the maximum, the fold stops too.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, WEIGHTS, ZERO, Weights
from . import similarity as S
from . import words as W
from .normalize import affiliation_name, bare_id, digits

def nought() -> Column:
    return F.lit(0.0)


def nothing(c: Column) -> Column:
    """Null or empty text."""
    return c.isNull() | (c == "")


# ---- dates


def days_alike(a: Column, b: Column) -> Column:
    """A digit and its double, or two digits swapped."""
    x, y = a.cast("string"), b.cast("string")
    return (a == b) | (F.concat(x, x) == y) | (F.concat(y, y) == x) | ((F.length(x) == 2) & (F.length(y) == 2) & (F.reverse(x) == y))


def date_score(a: Column, b: Column) -> Column:
    """0.4 for the year, 0.3 each for month and day, each falling with distance; 0 if either date is null."""
    dy, dm, dd = F.abs(F.year(a) - F.year(b)), F.abs(F.month(a) - F.month(b)), F.abs(F.dayofmonth(a) - F.dayofmonth(b))
    year = F.when(dy <= 5, 1.0 - 0.1 * dy).otherwise(0.2)
    january = (F.least(F.month(a), F.month(b)) == 1) & (F.greatest(F.month(a), F.month(b)) >= 10)
    month = F.when(dm == 0, 1.0).when(dm == 1, 0.9).when(january, 0.7).otherwise(0.3)
    day = F.when(dd == 0, 1.0).when(dd <= 3, 0.95 - 0.05 * dd / 3.0).when(days_alike(F.dayofmonth(a), F.dayofmonth(b)), 0.7).otherwise(0.3)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(0.4 * year + 0.3 * month + 0.3 * day)


def lives_logical(birth_a: Column, death_a: Column, birth_b: Column, death_b: Column) -> Column:
    """Births before deaths and lifespans within a fifth of each other; true if a date is missing or a lifespan is nought."""
    x, y = F.datediff(death_a, birth_a), F.datediff(death_b, birth_b)
    ratio = F.try_divide(F.greatest(x, y).cast("double"), F.least(x, y).cast("double"))
    return F.coalesce(F.when((x < 0) | (y < 0), False).otherwise(F.coalesce(ratio <= 1.21, F.lit(True))), F.lit(True))


def dates_result(pairs: list[tuple[Column, Column]], factor: Column | None = None) -> Column:
    """struct(score, matched, fields): mean over the pairs that are both there."""
    n = sum((F.when(a.isNotNull() & b.isNotNull(), 1).otherwise(0) for a, b in pairs), F.lit(0))
    mean = F.coalesce(F.try_divide(sum((date_score(a, b) for a, b in pairs), nought()), n), nought())
    score = mean * factor if factor is not None else mean
    return F.struct(score.alias("score"), (score > 0.7).alias("matched"), n.alias("fields"))


def person_dates(birth_a: Column, death_a: Column, birth_b: Column, death_b: Column) -> Column:
    return dates_result([(birth_a, birth_b), (death_a, death_b)], F.when(lives_logical(birth_a, death_a, birth_b, death_b), 1.0).otherwise(0.5))


def company_dates(created_a: Column, dissolved_a: Column, created_b: Column, dissolved_b: Column) -> Column:
    return dates_result([(created_a, created_b), (dissolved_a, dissolved_b)])


def built_date(c: Column) -> Column:
    """A year or an ISO date given as text."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(F.when(c.rlike("^\\d{4}$"), F.concat(c, F.lit("-01-01"))), "yyyy-MM-dd"))


def asset_dates(built_a: Column, built_b: Column) -> Column:
    return dates_result([(built_date(built_a), built_date(built_b))])


# ---- identifiers


def live_gov_id(q: Column, i: Column) -> Column:
    """1 if any two identifiers are equal without signs and their types are equal or one has none; countries don't count."""
    hit = lambda a, b: (bare_id(a["identifier"]) == bare_id(b["identifier"])) & F.coalesce(a["id_type"] == b["id_type"], F.lit(True))
    return F.when(F.coalesce(F.exists(q, lambda a: F.exists(i, lambda b: hit(a, b))), F.lit(False)), 1.0).otherwise(0.0)


def exact_ids(q: Column, i: Column) -> Column:
    """1 if any two identifiers agree in type, country and, without hyphens and case, in their signs. Null lists are empty."""
    bare = lambda x: F.lower(F.replace(x["identifier"], F.lit("-"), F.lit("")))
    hit = lambda a, b: a["id_type"].eqNullSafe(b["id_type"]) & a["country"].eqNullSafe(b["country"]) & (bare(a) == bare(b))
    return F.when(F.coalesce(F.exists(q, lambda a: F.exists(i, lambda b: hit(a, b))), F.lit(False)), 1.0).otherwise(0.0)


def id_country_score(id_a: Column, country_a: Column, id_b: Column, country_b: Column) -> Column:
    same = F.coalesce(F.lower(id_a) == F.lower(id_b), F.lit(False))
    a, b = nothing(country_a), nothing(country_b)
    return F.when(~same, 0.0).when(a & b, 1.0).when(a | b, 0.9).when(F.lower(country_a) == F.lower(country_b), 1.0).otherwise(0.7)


def gov_ids_with_country(q: Column, i: Column) -> Column:
    all_ = F.flatten(F.transform(q, lambda a: F.transform(i, lambda b: id_country_score(a["identifier"], a["country"], b["identifier"], b["country"]))))
    return F.coalesce(F.array_max(all_), nought())


def weighted_ids(fields: list[tuple[Column, Column, float]]) -> Column:
    """Weights of the identifiers that agree over those that the query has; 0 if it has none."""
    has = sum((F.when(~nothing(q), w).otherwise(0.0) for q, _, w in fields), nought())
    got = sum((F.when(~nothing(q) & F.coalesce(F.lower(q) == F.lower(i), F.lit(False)), w).otherwise(0.0) for q, i, w in fields), nought())
    return F.coalesce(F.try_divide(got, has), nought())


def vessel_ids(q: Column, i: Column) -> Column:
    return weighted_ids([(q[f], i[f], w) for f, w in (("imo_number", 15.0), ("call_sign", 12.0), ("mmsi", 12.0))])


def aircraft_ids(q: Column, i: Column) -> Column:
    return weighted_ids([(q[f], i[f], w) for f, w in (("serial_number", 15.0), ("icao_code", 12.0))])


def wallets(q: Column, i: Column, live: bool = False) -> Column:
    """1 if any two addresses are equal: live ones to the letter, else without case and with equal currencies if both have one."""
    if live:
        hit = lambda a, b: a["address"] == b["address"]
    else:
        hit = lambda a, b: (F.lower(a["address"]) == F.lower(b["address"])) & (nothing(a["currency"]) | nothing(b["currency"]) | (F.lower(a["currency"]) == F.lower(b["currency"])))
    return F.when(F.coalesce(F.exists(q, lambda a: F.exists(i, lambda b: hit(a, b))), F.lit(False)), 1.0).otherwise(0.0)


# ---- contacts


def live_contact(q: Column, i: Column) -> Column:
    email = F.lower(F.trim(q["email"])) == F.lower(F.trim(i["email"]))
    number = q["phone"].isNotNull() & i["phone"].isNotNull() & (digits(q["phone"]) == digits(i["phone"]))
    return F.when(F.coalesce(email, F.lit(False)) | F.coalesce(number, F.lit(False)), 1.0).otherwise(0.0)


def contact_score(q: Column, i: Column) -> Column:
    """Mean of equality of the e-mail, phone and fax that both have; 0 without any."""
    both = lambda f: ~nothing(q[f]) & ~nothing(i[f])
    n = sum((F.when(F.coalesce(both(f), F.lit(False)), 1).otherwise(0) for f in ("email", "phone", "fax")), F.lit(0))
    k = sum((F.when(F.coalesce(both(f) & (F.lower(q[f]) == F.lower(i[f])), F.lit(False)), 1.0).otherwise(0.0) for f in ("email", "phone", "fax")), nought())
    return F.coalesce(F.try_divide(k, n), nought())


def contact_field_score(q: Column, i: Column) -> Column:
    """Matches over the query's values; doubled values of the index count twice."""
    hits = F.aggregate(F.transform(q, lambda a: F.size(F.filter(i, lambda b: F.lower(a) == F.lower(b)))), F.lit(0), lambda x, y: x + y)
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(q)), nought())


# ---- addresses, titles, programmes, history: words are scored in Arrow batches


def _word_list_score(a, b) -> float:
    return S.merged_score(list(a), list(b), ZERO)


def address_pair_score(q: dict, i: dict) -> float:
    total = weight = 0.0
    for f, w in (("line1", 5.0), ("line2", 2.0), ("city", 4.0)):
        if q[f] is not None and len(q[f]) and i[f] is not None and len(i[f]):
            total += w * _word_list_score(q[f], i[f])
            weight += w
    for f, w in (("state", 2.0), ("postal_code", 3.0), ("country", 4.0)):
        if q[f] and i[f]:
            total += w * (q[f].lower() == i[f].lower())
            weight += w
    return total / weight if weight else 0.0


def best_address(q: list[dict] | None, i: list[dict] | None) -> float:
    """The first score above 0.92, else the best."""
    best = 0.0
    for a in q if q is not None else []:
        for b in i if i is not None else []:
            best = max(best, address_pair_score(a, b))
            if best > 0.92:
                return best
    return best


@F.pandas_udf(T.DoubleType())
def address_list_score(q: pd.Series, i: pd.Series) -> pd.Series:
    """Best pair of two lists of scored addresses (normalize.scored_address)."""
    return pd.Series([best_address(a, b) for a, b in zip(q, i, strict=True)], dtype="float64")


def live_address_score(q: dict, i: dict) -> float:
    same = bool(q["country"]) and bool(i["country"]) and q["country"].lower() == i["country"].lower()
    return min(1.0, 0.3 * same + 0.3 * (S.text_score(q["city"], i["city"], DEFAULT) if q["city"] and i["city"] else 0.0) + 0.4 * (S.name_score(q["line1"], i["line1"], DEFAULT) if q["line1"] and i["line1"] else 0.0))


@F.pandas_udf(T.DoubleType())
def live_address_column(q: pd.Series, i: pd.Series) -> pd.Series:
    return pd.Series([max((live_address_score(a, b) for a in (x if x is not None else []) for b in (y if y is not None else [])), default=0.0) for x, y in zip(q, i, strict=True)], dtype="float64")


def title_pair_score(a: str, b: str) -> float:
    """Similarity of two normalised titles without one-letter words, a tenth off for each word more on one side."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = [w for w in a.split() if len(w) > 1], [w for w in b.split() if len(w) > 1]
    return S.name_score(" ".join(x), " ".join(y), ZERO) * (1.0 - 0.1 * abs(len(x) - len(y))) if x and y else 0.0


title_score = S.pair_column(lambda a, b, _: title_pair_score(a or "", b or ""), ZERO)


def group_of(kind: Column) -> Column:
    table = {k: g for g, ks in W.AFFILIATION_GROUPS.items() for k in ks}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(kind)], F.lit(""))


def tidy_kind(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9\\s]", ""), "\\s+", " "))


def affiliation_kind_score(a: Column, b: Column) -> Column:
    x, y = tidy_kind(a), tidy_kind(b)
    return F.when(x == y, 1.0).when((group_of(x) != "") & (group_of(x) == group_of(y)), 0.8).otherwise(0.0)


def affiliation_score(name: Column, kind: Column) -> Column:
    return F.greatest(nought(), F.least(F.lit(1.0), name + F.when(kind > 0.9, 0.15).when(kind > 0.7, 0.08).otherwise(-0.15)))


def affiliations_score(scores: Column) -> Column:
    """Mean weighted by the square: sum of cubes over sum of squares."""
    power = lambda k: F.aggregate(scores, nought(), lambda acc, x: acc + F.pow(x, F.lit(k)))
    return F.coalesce(F.try_divide(power(3.0), power(2.0)), nought())


def programs_score(q: Column, i: Column) -> Column:
    """Share of the query's programmes that the other has, less a fifth if only one is secondary."""
    hits = F.size(F.filter(q["programs"], lambda a: F.exists(i["programs"], lambda b: F.lower(a) == F.lower(b)))).cast("double")
    share = F.coalesce(F.try_divide(hits, F.size(q["programs"])), nought())
    return F.when(q["secondary"].eqNullSafe(i["secondary"]), share).otherwise(share * 0.8)


@F.pandas_udf(T.DoubleType())
def history_score(q: pd.Series, i: pd.Series) -> pd.Series:
    """Best similarity of two values of one type."""
    rows = lambda x: x if x is not None else []
    kind = lambda r: (r["type"] or "").lower()
    return pd.Series([max((S.text_score(a["value"], b["value"], ZERO) for a in rows(x) for b in rows(y) if kind(a) == kind(b)), default=0.0) for x, y in zip(q, i, strict=True)], dtype="float64")


def supporting_score(programs: Column, history: Column) -> Column:
    """Mean of those that aren't nought."""
    n = F.when(programs > 0, 1).otherwise(0) + F.when(history > 0, 1).otherwise(0)
    return F.coalesce(F.try_divide(programs + history, n), nought())


# ---- totals


def factor_total(factors: dict[str, Column], weights: Weights = WEIGHTS, source_id_differs: Column | None = None, critical: list[str] | None = None) -> Column:
    """The weighted total of a comparison.

    factors: name, alt_names, address, gov_id, crypto, contact, date. If an exact identifier reaches the threshold the total is 0.7 and 0.3
    of the better name; else the mean over the name and all factors above nought, in which differing ids of one list are a
    factor of nought.
    """
    w = {"name": weights.name, "address": weights.address, "gov_id": weights.critical_id, "crypto": weights.critical_id, "contact": weights.critical_id, "date": weights.supporting}
    best = F.greatest(factors["name"], factors["alt_names"])
    exact = F.greatest(*[factors[f] for f in (critical or ["gov_id", "crypto", "contact"])]) >= weights.exact
    over = F.lit(w["name"]) + sum((F.when(factors[f] > 0, w[f]).otherwise(0.0) for f in w if f != "name"), nought())
    score = best * w["name"] + sum((factors[f] * w[f] for f in w if f != "name"), nought())
    if source_id_differs is not None:
        over = over + F.when(source_id_differs, weights.critical_id).otherwise(0.0)
    return F.when(exact, 0.7 + 0.3 * best).otherwise(F.coalesce(F.try_divide(score, over), nought()))


def name_address_total(primary: Column, address: Column, weights: Weights = WEIGHTS) -> Column:
    """A name and an address: null where both weights are nought, so a threshold drops the row."""
    return F.try_divide(primary * weights.name + address * weights.address, F.lit(weights.name + weights.address))


def positive_mean(scores: Column, default: dict[str, float] | None = None) -> Column:
    """Weighted mean of the positive parts of a map from part to score; unknown parts don't count."""
    w = default or {"name": 40.0, "address": 10.0, "gov_id": 15.0, "crypto": 15.0, "contact": 15.0, "date": 5.0}
    weight = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
    kept = F.filter(F.map_entries(scores), lambda e: (e["value"] > 0) & weight[e["key"]].isNotNull())
    part = F.aggregate(kept, F.struct(nought().alias("s"), nought().alias("w")), lambda a, e: F.struct((a["s"] + e["value"] * weight[e["key"]]).alias("s"), (a["w"] + weight[e["key"]]).alias("w")))
    return F.coalesce(F.try_divide(part["s"], part["w"]), nought())


def quality_adjusted(score: Column, query_words: Column, matched_words: Column, exact: Column, historical: Column) -> Column:
    return F.when((query_words >= 2) & (matched_words < 2) & ~exact & ~historical, score * 0.8).otherwise(score)


def penalised(score: Column, coverage: Column, critical_coverage: Column, required: Column, name_only: Column, perfect: Column) -> Column:
    """Penalties for little coverage and few required fields, a bonus for a perfect match, at most 1."""
    x = F.when(coverage < 0.35, score * 0.95).otherwise(score)
    x = F.when(critical_coverage < 0.7, x * 0.9).otherwise(x)
    x = F.when(required < 2, x * 0.9).otherwise(x)
    x = F.when(name_only, x * 0.95).otherwise(x)
    return F.least(F.lit(1.0), F.when(perfect, x * 1.15).otherwise(x))


def high_confidence(words: Column, score: Column) -> Column:
    return (words >= 2) & (score > 0.85)


def close_enough(score: Column) -> Column:
    """True for names worth comparing further; missing scores are."""
    return F.coalesce(score >= 0.4, F.lit(True))


def field_count(e: dict[str, Column]) -> Column:
    """How many of the named fields are there: ``t_`` texts that aren't empty, ``l_`` lists that have elements, others that aren't null."""
    there = lambda k, c: ~nothing(c) if k.startswith("t_") else F.size(c) > 0 if k.startswith("l_") else c.isNotNull()
    return sum((F.when(F.coalesce(there(k, c), F.lit(False)), 1).otherwise(0) for k, c in e.items()), F.lit(0))


def coverage(pieces: Column, available: Column) -> Column:
    """Fields compared over fields available. The ratio over critical fields has the same sum on both sides, so it is 1."""
    n = F.aggregate(pieces, F.lit(0), lambda a, p: a + p["fields"])
    return F.struct(F.coalesce(F.try_divide(n.cast("double"), available), F.lit(1.0)).alias("ratio"), F.lit(1.0).alias("critical_ratio"))


def importance(pieces: Column) -> Column:
    """struct(has_name, has_id, has_address, has_critical, required) over pieces that have weight and fields."""
    real = F.filter(pieces, lambda p: (p["weight"] > 0) & (p["fields"] > 0))
    hit = lambda test: F.exists(real, lambda p: p["matched"] & test(p))
    required = F.aggregate(F.filter(real, lambda p: p["required"]), F.lit(0), lambda a, p: a + p["fields"])
    return F.struct(
        hit(lambda p: p["kind"] == "name").alias("has_name"), hit(lambda p: p["exact"] & p["kind"].isin("identifiers", "gov-ids-exact")).alias("has_id"), hit(lambda p: p["kind"] == "address").alias("has_address"),
        hit(lambda p: p["exact"]).alias("has_critical"), required.alias("required"),
    )


def best_title(q: list[str] | None, i: list[str] | None, stop: float = 2.0) -> float:
    """The best pair of titles; with ``stop`` the first that exceeds it."""
    best = 0.0
    for a in q if q is not None else []:
        for b in i if i is not None else []:
            best = max(best, title_pair_score(a or "", b or ""))
            if best > stop:
                return best
    return best


@F.pandas_udf(T.DoubleType())
def title_list_score(q: pd.Series, i: pd.Series) -> pd.Series:
    return pd.Series([best_title(a, b) for a, b in zip(q, i, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def first_good_title(q: pd.Series, i: pd.Series) -> pd.Series:
    return pd.Series([best_title(a, b, 0.92) for a, b in zip(q, i, strict=True)], dtype="float64")


def read_affiliations(c: Column) -> Column:
    """Affiliations with normalised names and kinds, and the group of the kind."""
    return F.transform(c, lambda a: F.struct(affiliation_name(a["entity_name"]).alias("name"), tidy_kind(a["type"]).alias("kind"), group_of(tidy_kind(a["type"])).alias("family")))


def best_affiliations(asked: list | None, held: list | None) -> list[tuple[float, float, float, bool]]:
    """(name, kind, final, exact) of the best of each affiliation asked, by final score, then by kind; those whose name scores nothing are dropped."""
    found = []
    for a in asked if asked is not None else []:
        best = (0.0, 0.0, 0.0, False)
        for b in held if held is not None else []:
            if a["name"] and b["name"]:
                n = S.words_score(a["name"].split(), b["name"].split(), ZERO)
                kind = 1.0 if a["kind"] == b["kind"] else 0.8 if a["family"] and a["family"] == b["family"] else 0.0
                final = max(0.0, min(1.0, n + (0.15 if kind > 0.9 else 0.08 if kind > 0.7 else -0.15)))
                if (final, kind) > (best[2], best[1]):
                    best = (n, kind, final, n > 0.95 and kind > 0.9)
        if best[0] > 0:
            found.append(best)
    return found


@F.pandas_udf(T.DoubleType())
def affiliation_list_score(q: pd.Series, i: pd.Series) -> pd.Series:
    """Square-weighted mean of the best matches of two lists (read_affiliations); 0 without any."""
    out = []
    for asked, held in zip(q, i, strict=True):
        s = [x[2] for x in best_affiliations(asked, held)]
        out.append(sum(x**3 for x in s) / sum(x**2 for x in s) if any(s) else 0.0)
    return pd.Series(out, dtype="float64")
