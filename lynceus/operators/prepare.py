"""Prepared fields: names, word forms and addresses as matching reads them, computed once for an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N


def read_name(c: Column) -> Column:
    return N.plain(F.translate(N.reordered(c), "'’", ""))


def prepared(name: Column, alt_names: Column, addresses: Column) -> Column:
    """The struct of prepared fields. The language of the name as written chooses its stopwords, that of each normalised alternative name its own."""
    some = lambda xs: F.array_distinct(F.filter(xs, lambda x: x != ""))
    lang = N.language_guess(name)["language"]
    first = read_name(F.coalesce(name, F.lit("")))
    primary = N.without_stopwords(first, lang)
    alts_before = some(F.transform(F.coalesce(alt_names, N.EMPTY()), read_name))
    alts = some(F.transform(alts_before, lambda x: N.without_stopwords(x, N.language_guess(x)["language"])))
    all_ = F.concat(F.when(primary != "", F.array(primary)).otherwise(N.EMPTY()), alts)
    before = F.concat(F.when(first != "", F.array(first)).otherwise(N.EMPTY()), alts_before)
    field = lambda a, f: F.coalesce(N.address_field(a[f]), F.lit(""))
    lower = lambda a, f: F.coalesce(F.lower(a[f]), F.lit(""))
    address = lambda a: F.trim(F.concat_ws(" ", field(a, "line1"), field(a, "city"), field(a, "state"), lower(a, "postal_code"), lower(a, "country")))
    return F.struct(
        primary.alias("name"), alts.alias("alt_names"), some(F.transform(all_, lambda x: N.without_stopwords(x, lang))).alias("without_stopwords"), some(F.transform(all_, N.without_company_titles)).alias("without_company_titles"),
        F.array_distinct(F.flatten(F.transform(before, N.particle_forms))).alias("word_forms"), some(F.transform(F.coalesce(addresses, F.array().cast("array<struct<line1:string,line2:string,city:string,state:string,postal_code:string,country:string>>")), address)).alias("addresses"), lang.alias("language"),
    )


def with_prepared(entities: DataFrame) -> DataFrame:
    """Fills ``prepared`` where it isn't filled yet; addresses and phone numbers are normalised with it."""
    done = F.coalesce(F.col("prepared")["name"] != "", F.lit(False))
    tidy = lambda a: F.struct(*[N.address_field(a[f]).alias(f) for f in ("line1", "line2", "city", "state")], F.lower(a["postal_code"]).alias("postal_code"), F.lower(a["country"]).alias("country"))
    contact = F.when(F.col("contact").isNotNull(), F.struct(F.col("contact.email").alias("email"), N.phone(F.col("contact.phone")).alias("phone"), N.phone(F.col("contact.fax")).alias("fax"), F.col("contact.website").alias("website")))
    return entities.select(
        *[
            F.when(done, F.col("prepared")).otherwise(prepared(F.col("name"), F.col("alt_names"), F.col("addresses"))).alias("prepared") if c == "prepared"
            else F.when(done, F.col("addresses")).otherwise(F.transform("addresses", tidy)).alias(c) if c == "addresses"
            else F.when(done, F.col("contact")).otherwise(contact).alias(c) if c == "contact"
            else F.col(c)
            for c in entities.columns
        ]
    )
