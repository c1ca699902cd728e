"""Normalisation as column expressions; all of it stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

EMPTY = lambda: F.array().cast("array<string>")


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Every accented letter of the basic plane that is one letter and combining marks, and that letter.

    Hangul syllables decompose into letters, not marks, and are left as they are.
    """
    src, dst = [], []
    for o in range(0xC0, 0x10000):
        c = chr(o)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and len(base := "".join(x for x in d if not 0x300 <= ord(x) <= 0x36F)) == 1 and base != c:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


def plain(c: Column) -> Column:
    """Lower case, accents stripped, signs and white space single spaces, all else but letters and digits gone."""
    x = F.lower(F.regexp_replace(c, "[.,-]", " "))
    for a, b in W.WRITTEN_OUT.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.translate(x, *accents()), "[\\u0300-\\u036f]|[\\x{10000}-\\x{10ffff}]", "")
    x = F.regexp_replace(x, "[\\p{P}\\p{S}\\s\\x1c-\\x1f\\u1680\\u2000-\\u2006\\u2008-\\u200a\\u2028\\u2029\\u205f\\u3000]+", " ")
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(x, "[^\\p{L}\\p{Nd} ]", ""), " +", " ")), F.lit(""))


def tokens(c: Column) -> Column:
    """Words between white space; none of a blank or null text."""
    return F.when(F.trim(c) != "", F.split(F.trim(c), "\\s+")).otherwise(EMPTY())


def bare_id(c: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", "")), F.lit(""))


def digits(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "[^\\p{Nd}]", ""), F.lit(""))


def without_stopwords(c: Column, language: Column | str = "en") -> Column:
    """Words that are no stopwords of the language; an unknown language reads as English."""
    kept = lambda w, k: ~F.lower(w).isin(W.STOPWORDS.get(k, W.STOPWORDS["en"]).split())  # noqa: E731  # one look-up in a hash set a word
    if isinstance(language, str):
        return F.array_join(F.filter(tokens(c), lambda w: kept(w, language)), " ")

    def test(w: Column) -> Column:
        out = None
        for k in W.STOPWORDS:
            out = F.when(language == k, kept(w, k)) if out is None else out.when(language == k, kept(w, k))
        return out.otherwise(kept(w, "en"))

    return F.array_join(F.filter(tokens(c), test), " ")


def language_guess(c: Column) -> Column:
    """struct(language, confidence): the rules on scripts and short texts; where a trained model would follow, English at 0.5."""
    low = F.lower(c)

    guess = lambda lang, p: F.struct(F.lit(lang).alias("language"), F.lit(p).alias("confidence"))
    short = F.length(c) < 30
    return (
        F.when(c.isNull() | (F.trim(c) == ""), guess("en", 0.0))
        .when(c.rlike("[\\u0400-\\u052f]"), guess("ru", 0.9))
        .when(c.rlike("[\\u0600-\\u06ff\\u0750-\\u077f\\u08a0-\\u08ff]"), guess("ar", 0.9))
        .when(c.rlike("[\\u4e00-\\u9fff\\u3400-\\u4dbf]"), guess("zh", 0.9))
        .when(F.length(c) < 3, guess("en", 0.5))
        .when(short & low.rlike("(^| )(the|a|of)( |$)"), guess("en", 0.8))
        .when(short & low.rlike("(^| )(el|la|de|del)( |$)"), guess("es", 0.8))
        .otherwise(guess("en", 0.5))
    )


def is_language(c: Column, language: str) -> Column:
    """Whether a text is told to be in the language."""
    return language_guess(c)["language"] == language


def country_language(c: Column) -> Column:
    table = {name.strip(): lang for lang, names in W.COUNTRY_LANGUAGES.items() for name in names.split(",")}
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(F.trim(c))]


def country_aware_language(text: Column, country: Column) -> Column:
    """The detected language, or the country's where detection is unsure."""
    g, own = language_guess(text), country_language(country)
    unsure = (g["confidence"] < 0.7) & own.isNotNull() & (own != g["language"])
    return F.when(g["confidence"] >= 0.5, F.when(unsure, own).otherwise(g["language"])).otherwise(F.coalesce(own, F.lit("en")))


def reordered(c: Column) -> Column:
    """``LAST, FIRST`` as ``FIRST LAST``, split at the first comma."""
    return F.when(c.contains(","), F.concat(F.trim(F.regexp_replace(c, "^[^,]*,", "")), F.lit(" "), F.trim(F.substring_index(c, ",", 1)))).otherwise(c)


def without_company_titles(c: Column) -> Column:
    """Endings like ``llc`` dropped, again and again."""
    return F.regexp_replace(c, "(?:(?:" + "|".join(t.replace(" ", "\\s") for t in W.COMPANY_TITLES) + ")\\s*)+$", "")


def particle_forms(c: Column) -> Column:
    """The name, the name with neighbouring particles merged, and with particles merged into the next word."""
    p = "|".join(sorted(W.PARTICLES))
    once = F.regexp_replace(c, f"(?<![^ ])((?i:{p})) (?=(?i:{p})(?: |$))", "$1")
    all_ = F.regexp_replace(c, f"(?<![^ ])((?i:{p})) (?=[^ ])", "$1")
    for _ in range(3):  # a match may start where the one before it ended
        once = F.regexp_replace(once, f"(?<![^ ])((?:(?i:{p}))+) (?=(?i:{p})(?: |$))", "$1")
        all_ = F.regexp_replace(all_, f"(?<![^ ])((?:(?i:{p}))+) (?=[^ ])", "$1")
    forms = F.array(c, F.when(once != c, once), F.when(all_ != c, all_))
    return F.array_compact(forms)


def address_field(c: Column) -> Column:
    """Lower case without commas and full stops; null if empty."""
    return F.when(c != "", F.lower(F.translate(c, ",.", "")))


def scored_address(a: Column) -> Column:
    """struct of word lists and fields as address comparison reads them."""
    text = lambda f: F.coalesce(F.lower(F.translate(a[f], ",.#", "")), F.lit(""))
    country = F.coalesce(F.lower(F.translate(a["country"], ".", "")), F.lit(""))
    return F.struct(tokens(text("line1")).alias("line1"), tokens(text("line2")).alias("line2"), tokens(text("city")).alias("city"), F.trim(text("state")).alias("state"), F.trim(text("postal_code")).alias("postal_code"), F.trim(country).alias("country"))


def full_address(a: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[a[f] for f in ("line1", "line2", "city", "state", "postal_code", "country")]))


def phone(c: Column) -> Column:
    """Digits as written, without the trunk nought and signs; null if nothing is left."""
    x = F.replace(F.replace(c, F.lit("(0)"), F.lit("")), F.lit(" 0 "), F.lit(" "))
    return F.nullif(F.translate(x, "+- ().", ""), F.lit(""))


def gender(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("m", "male", "man", "guy"), "male").when(low.isin("f", "female", "woman", "gal", "girl"), "female").otherwise("unknown")


def country_names(spark: SparkSession) -> DataFrame:
    """(key, name): upper-case codes and names of countries from the JVM's locale data, with the stated overrides."""
    locale = spark._jvm.java.util.Locale
    rows: dict[str, str] = {}
    for code in locale.getISOCountries():
        one = locale("", code)
        name = one.getDisplayCountry(locale.ENGLISH)
        own = W.COUNTRY_OVERRIDES.get(code, name)
        rows.setdefault(name.upper(), own)
        rows[code] = own
        rows[one.getISO3Country()] = W.COUNTRY_OVERRIDES.get(one.getISO3Country(), name)
    for code, name in W.COUNTRY_OVERRIDES.items():
        rows[code] = name
    return spark.createDataFrame(sorted(rows.items()), "key string, name string")


def with_country_name(df: DataFrame, column: str, output: str) -> DataFrame:
    """Adds the English name of a country given as a code or name; unknown texts stay, blank is ""."""
    names = F.broadcast(country_names(df.sparkSession)).withColumnsRenamed({"key": "_country_key", "name": "_country_name"})
    out = df.join(names, F.upper(F.trim(column)) == F.col("_country_key"), "left")
    return out.withColumn(output, F.coalesce("_country_name", F.trim(column), F.lit(""))).drop("_country_key", "_country_name")


def title(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^\\w\\s-]", ""), "\\s+", " ")), F.lit(""))


def expanded_title(c: Column) -> Column:
    full = F.create_map(*[F.lit(x) for kv in W.TITLE_WORDS.items() for x in kv])
    return F.array_join(F.transform(tokens(c), lambda w: F.coalesce(full[w], w)), " ")


def affiliation_name(c: Column) -> Column:
    x = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9\\s]", ""), "\\s+", " "))
    out = x
    for s in reversed(W.AFFILIATION_SUFFIXES):  # the first in list order that fits is the one that is dropped
        out = F.when(x.endswith(s), F.trim(F.regexp_replace(x, f"{s}$", ""))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def sound_key(word: Column) -> Column:
    """Four-sign phonetic key: vowels, h, w and y separate equal codes; a first sign that is no letter stays and has no code."""
    w = plain(word)
    codes = {ch: d for d, letters in W.SOUND_CODES.items() for ch in letters}
    alphabet = "".join(sorted(codes))
    digits_ = "".join(codes[ch] for ch in alphabet)
    coded = F.translate(F.translate(w, "0123456789", "aaaaaaaaaa"), alphabet, digits_)
    squeezed = F.regexp_replace(F.regexp_replace(coded, "[^1-6]", "0"), "([1-6])\\1+", "$1")
    rest = F.regexp_replace(F.substring(squeezed, 2, 1_000_000), "0", "")
    return F.when(w == "", "").otherwise(F.rpad(F.concat(F.upper(F.substring(w, 1, 1)), rest), 4, "0"))


def sound_set(names: Column) -> Column:
    """Sorted set of the phonetic keys of a name's words."""
    return F.array_sort(F.array_distinct(F.transform(tokens(names), sound_key)))


def first_letters_fit(a: Column, b: Column) -> Column:
    """Whether two texts can start with the same sound: equal or exchangeable first letters, both digits, or one empty."""
    x, y = F.substring(plain(a), 1, 1), F.substring(plain(b), 1, 1)
    pairs = [p for q in W.FIRST_LETTERS for p in (q, q[::-1])]
    swap = F.concat(x, y).isin([p + q for p, q in pairs])
    return (x == "") | (y == "") | (x == y) | swap | (x.rlike("\\p{Nd}") & y.rlike("\\p{Nd}"))



def sounds_match(a: Column, b: Column) -> Column:
    """Whether two words have one phonetic key; words without a sign have none."""
    x, y = sound_key(a), sound_key(b)
    return F.coalesce((x != "") & (x == y), F.lit(False))


def any_sounds_match(a: Column, b: Column) -> Column:
    """Whether any word of one list sounds like any of the other."""
    keys = lambda ws: F.filter(F.transform(ws, sound_key), lambda k: k != "")
    return F.coalesce(F.arrays_overlap(keys(a), keys(b)), F.lit(False))


def filtered_out(a: Column, b: Column) -> Column:
    """Whether two texts need no comparison, as their first letters can't sound alike."""
    return F.coalesce(~first_letters_fit(a, b), F.lit(False))
