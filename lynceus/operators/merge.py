"""Merge of the rows of one entity: an ordered fold, written as aggregations so that no group is ever held in one place.

Rows of a group are read in order of position. Later rows without a name are passed over. The first value that isn't empty wins; lists
become ordered unions; the type record is that of the last row's kind, and names that differ from the merged one go to its alternative
names, the latest first. History is not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PARTS, entity_schema
from ..session import written
from .prepare import with_prepared


def merge_key(source: Column, source_id: Column, entity_type: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.lower(F.concat(none(source), F.lit("/"), none(source_id), F.lit("/"), none(entity_type)))


def first_filled(c: Column, pos: Column, text: bool = True) -> Column:
    """The value of least position that isn't null or, for texts, empty."""
    there = c.isNotNull() & (c != "") if text else c.isNotNull()
    return F.min_by(c, F.when(there, pos))


def ordered_union(rows: DataFrame, key: str, element: Column, same: Column, order: Column, name: str) -> DataFrame:
    """(key, name): the elements of all rows in order, of those that are the same the first. Repeats vanish map-side."""
    one = rows.select(key, element.alias("e"), same.alias("s"), order.alias("o")).where("e IS NOT NULL").groupBy(key, "s").agg(F.min("o").alias("o"), F.min_by("e", "o").alias("e"))
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "s", "e"))), lambda x: x["e"]).alias(name))


def merged_list(rows: DataFrame, column: str, same, name: str | None = None) -> DataFrame:
    """Ordered union of an array column over the rows (key, pos)."""
    long = rows.select("key", "pos", F.posexplode(column).alias("k", "x"))
    return ordered_union(long, "key", F.col("x"), same(F.col("x")), F.struct("pos", "k"), name or column)


low = lambda *cs: F.lower(F.concat_ws("/", *[F.coalesce(c, F.lit("")) for c in cs]))
same_text = lambda x: F.lower(x)
same_id = lambda x: low(F.coalesce(x["country"], F.lit("null")), F.coalesce(x["id_type"], F.lit("null")), F.regexp_replace(x["identifier"], "[ -]", ""))
same_wallet = lambda x: low(x["currency"], x["address"])


def merged_addresses(rows: DataFrame) -> DataFrame:
    """Addresses of equal lines become one, its missing parts filled from later ones."""
    long = rows.select("key", F.posexplode("addresses").alias("k", "x"), "pos").select("key", F.struct("pos", "k").alias("o"), "x").where("x IS NOT NULL")
    same = long.withColumn("s", low(F.col("x.line1"), F.col("x.line2")))
    parts = [first_filled(F.col(f"x.{f}"), F.col("o")).alias(f) for f in ("line1", "line2", "city", "state", "postal_code", "country")]
    one = same.groupBy("key", "s").agg(F.min("o").alias("o"), *parts)
    address = F.struct("line1", "line2", "city", "state", "postal_code", "country")
    return one.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", address.alias("a")))), lambda x: x["a"]).alias("addresses"))


def merge_entities(entities: DataFrame, prepare: bool = True) -> DataFrame:
    """One entity for each source, source id and type. An empty table gives an empty one; single rows stay as they are, but prepared."""
    base = entities.withColumn("key", merge_key(F.col("source"), F.col("source_id"), F.col("entity_type"))).withColumnRenamed("index_pos", "pos")
    base = written(base)
    first = base.groupBy("key").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    rows = base.join(first, "key").where("pos = first_pos OR (name IS NOT NULL AND name <> '')")
    kinds = list(PARTS)
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), k) for k in kinds])
    rows = rows.withColumn("kind", kind)
    last = rows.groupBy("key").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("pos"))).alias("last_kind"), first_filled(F.col("name"), F.col("pos")).alias("merged_name"), F.count("*").alias("m"))
    rows = written(rows.join(last, "key"))
    # the record of the kind that comes last is folded from after the last row of another kind
    other = rows.where("kind IS NOT NULL AND kind <> last_kind").groupBy("key").agg(F.max("pos").alias("other_pos"))
    own = rows.join(other, "key", "left").where("kind = last_kind AND (other_pos IS NULL OR pos > other_pos)")
    scalars = [first_filled(F.col(c), F.col("pos")).alias(c) for c in ("entity_type", "source", "source_id", "remarks")]
    contact = [first_filled(F.col(f"contact.{f}"), F.col("pos")).alias(f"contact_{f}") for f in ("email", "phone", "fax", "website")]
    sums = rows.groupBy("key").agg(
        F.min("pos").alias("index_pos"), F.min_by("id", "pos").alias("id"), F.first("merged_name").alias("name"), F.first("last_kind").alias("kind"), F.first("m").alias("m"), *scalars, *contact,
        F.max("sanctions.secondary").alias("secondary"), first_filled(F.col("sanctions.description"), F.col("pos")).alias("description"), F.max(F.col("sanctions").isNotNull()).alias("has_sanctions"), F.min_by("historical", "pos").alias("historical"),
    )
    parts = []
    for k in kinds:
        mine = own.where(F.col("kind") == k)
        fields = [f for f in entity_schema()[k].dataType.fields]
        plain_fields = [f for f in fields if f.dataType.simpleString() in ("string", "date") and f.name != "name"]
        part = mine.groupBy("key").agg(first_filled(F.col(f"{k}.name"), F.col("pos")).alias("part_name"), *[first_filled(F.col(f"{k}.{f.name}"), F.col("pos"), f.dataType.simpleString() == "string").alias(f"part_{f.name}") for f in plain_fields])
        seen = F.struct(F.lit(1).alias("g"), F.col("pos").alias("a"), F.col("k").alias("b"))
        alts = mine.select("key", "pos", F.posexplode(F.col(f"{k}.alt_names")).alias("k", "x")).select("key", "x", seen.alias("o"))
        later = mine.where("pos > first_pos AND name <> merged_name").select("key", F.col("name").alias("x"), F.struct(F.lit(0).alias("g"), (-F.col("pos")).alias("a"), F.lit(0).alias("b")).alias("o"))
        part = part.join(ordered_union(alts.union(later), "key", F.col("x"), F.lower("x"), F.col("o"), "part_alt_names"), "key", "left")
        none = {f.name: F.lit(None).cast(f.dataType) for f in fields}
        if "titles" in none:
            part = part.join(merged_list(mine.withColumn("titles", F.col(f"{k}.titles")), "titles", same_text, "part_titles"), "key", "left")
        if "government_ids" in none:
            part = part.join(merged_list(mine.withColumn("ids", F.col(f"{k}.government_ids")), "ids", same_id, "part_government_ids"), "key", "left")
        have = set(part.columns)
        value = lambda f: F.coalesce(F.col(f"part_{f.name}"), F.array().cast(f.dataType)) if f.dataType.typeName() == "array" else F.col(f"part_{f.name}")
        struct = F.struct(*[(value(f) if f"part_{f.name}" in have else none[f.name]).cast(f.dataType).alias(f.name) for f in fields])
        parts.append(part.select("key", struct.alias(k)))
    lists = [merged_list(rows, "alt_names", same_text), merged_list(rows, "government_ids", same_id), merged_list(rows, "crypto_addresses", same_wallet), merged_addresses(rows), merged_list(rows.withColumn("programs", F.col("sanctions.programs")), "programs", same_text)]
    out = sums
    for t in (*parts, *lists):
        out = out.join(t, "key", "left")
    types = {f.name: f.dataType for f in entity_schema().fields}
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(types[c]))
    several = F.col("m") > 1
    out = out.select(
        "index_pos", "id", "name", "entity_type", "source", "source_id", *[F.when(F.col("kind") == k, F.col(k)).alias(k) for k in kinds],
        F.struct(*[F.col(f"contact_{f}").alias(f) for f in ("email", "phone", "fax", "website")]).alias("contact"), empty("addresses").alias("addresses"), empty("crypto_addresses").alias("crypto_addresses"),
        empty("alt_names").alias("alt_names"), empty("government_ids").alias("government_ids"),
        F.when(F.col("has_sanctions"), F.struct(F.coalesce("programs", F.array().cast("array<string>")).alias("programs"), F.coalesce("secondary", F.lit(False)).alias("secondary"), F.col("description"))).alias("sanctions"),
        F.when(several, F.array().cast(types["historical"])).otherwise(F.col("historical")).alias("historical"), "remarks", F.lit(None).cast(types["prepared"]).alias("prepared"), "m", "key",
    )
    single = base.join(out.where("m = 1").select("key", F.col("index_pos").alias("keep")), "key").where("pos = keep").withColumnRenamed("pos", "index_pos")
    columns = [f.name for f in entity_schema().fields]
    all_ = out.where("m > 1").select(*columns).unionByName(single.select(*columns))
    return with_prepared(all_) if prepare else all_
