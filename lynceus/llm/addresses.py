"""Same postal address written differently: expansion into plausible forms, hashed component combinations, equi-join.

An address is expanded into every form that its words allow: a last word of line1 may be part of the street or the city, a number may be a range,
an abbreviation may stand for several words, words may stand in another order, and the street may be in line2.
Each form gives hashes of component combinations, all with the house number: the street with no or one letter deleted, and
the city with the street's beginning or end. Forms that share a hash are compared; conflicting house numbers never
meet, conflicting cities, countries, street types, postal codes or states reject a pair. Equal forms are one class, so copies
of an address cost no comparison.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import country_names
from ..session import table, written
from .namekit import latin, sound

# Street types and their short forms; a short form may stand for several.
STREET_TYPES = {
    "alley": "alley aly", "avenue": "avenue ave av", "avenida": "avenida avda av", "boulevard": "boulevard blvd bd boul", "bulvar": "bulvar bulv", "calle": "calle cl c", "camino": "camino cno", "carrera": "carrera cra kra", "caddesi": "caddesi cad cd",
    "chaussee": "chaussee chee", "circle": "circle cir", "close": "close", "corso": "corso", "court": "court ct", "crescent": "crescent cres", "drive": "drive drv", "highway": "highway hwy", "jalan": "jalan jln", "lane": "lane ln", "naberezhnaya": "naberezhnaya nab",
    "parkway": "parkway pkwy", "paseo": "paseo", "pereulok": "pereulok per", "piazza": "piazza pza", "place": "place pl", "platz": "platz", "plaza": "plaza plz", "prospekt": "prospekt prosp pr prospect prkt", "quai": "quai", "road": "road rd", "rua": "rua", "rue": "rue r",
    "shosse": "shosse", "sokak": "sokak sok sk", "square": "square sq", "strasse": "strasse", "street": "street str st", "terrace": "terrace ter terr", "travessa": "travessa tv", "ulitsa": "ulitsa ulica ul", "viale": "viale", "way": "way",
}
# Abbreviations inside names of streets and towns.
INSIDE = {"st": "saint", "ste": "sainte", "sta": "santa", "mt": "mount", "ft": "fort", "gen": "general", "col": "colonel", "pres": "president", "dr": "doctor", "prof": "professor", "nth": "north", "sth": "south", "gt": "great", "upr": "upper", "lwr": "lower"}
TYPES_OF: dict[str, list[str]] = {}
for _full, _shorts in STREET_TYPES.items():
    for _s in _shorts.split():
        TYPES_OF.setdefault(_s, []).append(_full)
# Formal and older names of countries, each line one country; codes and English names of all others are those of the JVM's locale data.
COUNTRIES = """belarus, by, blr, republic of belarus
china, cn, chn, prc, people s republic of china, peoples republic of china
colombia, co, col, republic of colombia
cuba, cu, cub, republic of cuba
cyprus, cy, cyp, republic of cyprus
france, fr, fra, french republic
germany, de, deu, deutschland, fed rep of germany, federal republic of germany
iran, ir, irn, islamic republic of iran, iran islamic republic of
latvia, lv, lva, republic of latvia
lebanon, lb, lbn, lebanese republic
libya, ly, lby, state of libya
malta, mt, mlt, republic of malta
mexico, mx, mex, united mexican states
myanmar, mm, mmr, burma
nigeria, ng, nga, federal republic of nigeria
pakistan, pk, pak, islamic republic of pakistan
panama, pa, pan, republic of panama
russia, ru, rus, russian federation
serbia, rs, srb, republic of serbia
singapore, sg, sgp, republic of singapore
south korea, kr, kor, republic of korea
spain, es, esp, espana, kingdom of spain
sudan, sd, sdn, republic of the sudan
switzerland, ch, che, swiss confederation
syria, sy, syr, syrian arab republic
turkey, tr, tur, turkiye, republic of turkiye
united arab emirates, ae, are, uae, u a e
united kingdom, gb, gbr, uk, u k, great britain
venezuela, ve, ven, bolivarian republic of venezuela
yemen, ye, yem, republic of yemen"""
COUNTRY_OF = {x.strip(): line.split(",")[0] for line in COUNTRIES.split("\n") for x in line.split(",")}
UNIT = re.compile(r"\b(?:suite|ste|flat|apt|apartment|office|off|floor|fl|unit|room|rm)\b\.?\s*(?:no\b\.?|#)?\s*\d+[a-z]?\b|\b\d+(?:st|nd|rd|th)\s+(?:floor|fl)\b")
NUMBER_SIGN = re.compile(r"\bn(?:[º°]|o\b|r\b|um\b)\.?\s*(?=\d)|#\s*(?=\d)|[º°]")
#: No word that is typed is longer; of longer strings no deletions are listed, their ends link them.
LONG = 64
MARKERS = frozenset(("", "n a", "na", "unknown", "none", "null", "0", "not available"))


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text)


#: Words that formal names of countries add; what is left must be a name of its own.
FORMAL = re.compile(r"^(?:the )?(?:(?:people s|peoples|islamic|federal|democratic|arab|bolivarian|socialist|plurinational|hashemite|grand|united) )*(?:republic|kingdom|state|states|commonwealth|federation|duchy|principality|sultanate|union|fed rep) of (?:the )?")
#: Names that the formal words tell apart.
TOLD_APART = frozenset(("korea", "congo", "china"))


def known_countries(spark: SparkSession) -> dict[str, str]:
    """Names and codes of all countries, each to one name: a few hundred, whatever the data."""
    out = {" ".join(words_of(latin(r.key))): " ".join(words_of(latin(r.name))) for r in country_names(spark).collect()}
    return out | {x.strip(): out.get(line.split(",")[0].strip(), line.split(",")[0]) for line in COUNTRIES.split("\n") for x in line.split(",")}


def country_of(text: str | None, known: dict[str, str] = COUNTRY_OF) -> str:
    """One name for a country however it is written; "" for a text that names none, which says nothing and contradicts nothing."""
    low = " ".join(words_of(latin(text))) if text else ""
    if low in known:
        return known[low]
    bare = FORMAL.sub("", low)
    return known.get(bare, "") if bare != low and bare not in TOLD_APART else ""


def forms_of(line1: str | None, line2: str | None, city: str | None) -> list[tuple[str, str, list[str], str]]:
    """Plausible (house number, street, street types, city); none without a house number and a street.

    line2 is read where it holds a number and a street of its own, or what line1 lacks.
    """
    out = line_forms(line1, city)
    if line2 and line2.strip():
        out += line_forms(line2, city) or ([] if out else line_forms(f"{line1 or ''} , {line2}", city))
    return list({(n, s, tuple(t), c): (n, s, t, c) for n, s, t, c in out}.values())


def line_forms(line: str | None, city: str | None) -> list[tuple[str, str, list[str], str]]:
    text = NUMBER_SIGN.sub(" ", (line or "").lower().replace("№", " "))
    text = NUMBER_SIGN.sub(" ", latin(text))
    if " ".join(words_of(text)) in MARKERS:
        return []
    text = UNIT.sub(" , ", re.sub(r"\bpr[ -]kt\b", "prkt", text))
    words = words_of(text)
    numbers = [w for w in words if re.fullmatch(r"\d+[a-z]?", w)]
    town = " ".join(words_of(latin(city))) if city else ""
    towns = [""] if town in MARKERS else readings(town.split())
    ranged = re.search(r"\b(\d+[a-z]?) ?[-–/] ?(\d+[a-z]?)\b", text)
    houses = list(ranged.groups()) if ranged and ranged.group(1) == (numbers or [""])[0] else numbers[:1]
    names = [w for w in words if not w[0].isdigit() and w not in ("no", "nr", "n", "num")]
    out = []
    for as_type in {True, not any(w in INSIDE and w in TYPES_OF for w in names[:-1])}:
        # an abbreviation that is a street type and a word of names, as "st", is read both ways unless it ends the line
        typed = [w for k, w in enumerate(names) if w in TYPES_OF and (as_type or w not in INSIDE or k == len(names) - 1)]
        street = [w for k, w in enumerate(names) if not (w in TYPES_OF and (as_type or w not in INSIDE or k == len(names) - 1))]
        if not street and len(typed) > 1:  # a street named like a type
            street, typed = typed[1:], typed[:1]
        if not street:
            continue
        types = sorted({t for w in typed for t in TYPES_OF[w]})
        for number in houses:
            if any(towns) or len(street) == 1:
                out += [(number, s, types, t) for s in readings(street, True) for t in towns]
            if len(street) > 1:  # the last words may be the city's
                out += [(number, s, types, t) for k in range(1, len(street)) for s in readings(street[:k], True) for t in readings(street[k:])]
    return out


def readings(words: list[str], orders: bool = False) -> list[str]:
    """The words as one sounded text: as written, with abbreviations written out, and, of streets of several words, in alphabetical order."""
    full = [INSIDE.get(w, w) for w in words]
    out = [words, full] + ([sorted(words), sorted(full)] if orders and len(words) > 1 else [])
    return list(dict.fromkeys(sound("".join(x)) for x in out))


def expanded(addresses: DataFrame, key: str) -> DataFrame:
    """(key, number, street, types, city, country, state, postal): one row a plausible form."""
    countries = known_countries(addresses.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, known = [], {}
            for i, a, b, c, s, p, n in pdf.itertuples(index=False, name=None):
                k = (a, b, c)
                if k not in known:
                    known[k] = forms_of(a, b, c)
                if known[k]:
                    rest = (country_of(n, countries), " ".join(words_of(latin(s or ""))), "".join(words_of(latin(p or ""))))
                    rest = tuple("" if x in MARKERS else x for x in rest)
                    out += [(i, *f, *rest) for f in known[k]]
            yield pd.DataFrame(out, columns=[key, "number", "street", "types", "city", "country", "state", "postal"])

    kind = addresses.schema[key].dataType.simpleString()
    text = addresses.select(key, *[F.col(c).cast("string") for c in ("line1", "line2", "city", "state", "postal_code", "country")])
    return text.mapInPandas(read, f"`{key}` {kind}, number string, street string, types array<string>, city string, country string, state string, postal string")


def shorter(word: Column) -> Column:
    """The word and the word with any one letter deleted; of a word of more than LONG letters only the word itself."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, n)))
    return F.array_distinct(F.concat(F.array(word), F.when((n > 3) & (n <= LONG), cut).otherwise(F.array().cast("array<string>"))))


def combinations_of(number: Column, street: Column, city: Column, postal: Column) -> Column:
    """Hashes of component combinations of one form."""
    streets = F.transform(shorter(street), lambda s: F.xxhash64(F.lit("street"), number, s))
    there = F.array(F.xxhash64(F.lit("start"), number, city, F.substring(street, 1, 3)), F.xxhash64(F.lit("end"), number, city, F.substring(street, -3, 3)))
    none = F.array().cast("array<long>")
    coded = F.array(F.xxhash64(F.lit("postal"), number, postal))
    return F.concat(streets, F.when(city != "", there).otherwise(none), F.when(postal != "", coded).otherwise(none))


def near(a: str, b: str, sure: Column | None = None) -> Column:
    """Few edits for their length, a swap of neighbours being two: 2 from five letters on, 1 from four; where the place is sure by other
    components, 4 from eight letters on, 3 from five, 2 from four."""
    least = F.least(F.length(a), F.length(b))
    allowed = F.when(least >= 5, 2).when(least >= 4, 1).otherwise(0)
    if sure is not None:
        allowed = F.when(sure, F.when(least >= 8, 4).when(least >= 5, 3).when(least >= 4, 2).otherwise(0)).otherwise(allowed)
    d = F.levenshtein(a, b, 4)  # -1 beyond 4, found without comparing long words in full
    return (F.col(a) == F.col(b)) | ((d >= 0) & (d <= allowed))


def agree(a: str, b: str) -> Column:
    return (F.col(a) == "") | (F.col(b) == "") | (F.col(a) == F.col(b))


def same_building(addresses: DataFrame, key: str = "address_id") -> DataFrame:
    """(key_a, key_b): rows that denote the same building; flat, floor and office don't matter.

    Rows without house number or street, as null or empty ones, denote nothing; a row delivered twice pairs with itself under its
    other key; rows that repeat a key give no pair of it with itself; an empty table gives an empty result.
    """
    forms = expanded(addresses, key)
    parts = ["number", "street", "types", "city", "country", "state", "postal"]
    forms = written(forms.withColumn("form", F.xxhash64(*parts)))
    members = forms.select("form", key).distinct()
    kinds = forms.dropDuplicates(["form"]).select("form", *parts)
    keyed = kinds.withColumn("hash", F.explode(F.array_distinct(combinations_of(F.col("number"), F.col("street"), F.col("city"), F.col("postal")))))
    a = keyed.select("hash", *[F.col(c).alias(f"{c}_a") for c in ("form", *parts)])
    b = keyed.select("hash", *[F.col(c).alias(f"{c}_b") for c in ("form", *parts)])
    place = agree("postal_a", "postal_b") & agree("state_a", "state_b")
    one_code = (F.col("postal_a") != "") & (F.col("postal_a") == F.col("postal_b"))
    one_town = (F.col("city_a") != "") & (F.col("city_a") == F.col("city_b"))
    street = F.col("street_a") == F.col("street_b")
    town = F.when((F.col("city_a") != "") & (F.col("city_b") != ""), (street & one_code) | near("city_a", "city_b", street | one_code)).otherwise(place)
    types = (F.size("types_a") == 0) | (F.size("types_b") == 0) | F.arrays_overlap("types_a", "types_b")
    fits = (F.col("number_a") == F.col("number_b")) & types & agree("country_a", "country_b") & near("street_a", "street_b", one_code | one_town) & town
    pairs = a.join(b, "hash").where(F.col("form_a") < F.col("form_b")).where(fits).select("form_a", "form_b").distinct()
    pairs = written(pairs.union(kinds.select(F.col("form").alias("form_a"), F.col("form").alias("form_b"))))
    left = members.select(F.col("form").alias("form_a"), F.col(key).alias("x"))
    right = members.select(F.col("form").alias("form_b"), F.col(key).alias("y"))
    both = pairs.join(left, "form_a").join(right, "form_b").where("x <> y")
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of prepared addresses that denote the same building."""
    return same_building(table(spark, folder, "prepared_addresses"))
