"""Matching entities across sources without keys: bit vectors, multi-index Hamming hashing, calibrated confidences.

Names and identifiers become bit vectors of 128 bits, one a q-gram of a name and two a q-gram of an identifier. Two vectors within Hamming distance r
agree, in at least one of four chunks of 32 bits, up to r // 4 bits; each vector is filed under its chunks and looked up under all values so
near, so every pair within r is found, none by chance missed. The Dice coefficient of the vectors of a field gives a step; every step of
a field has a weight, the log odds of seeing it between rows of one entity and of two, and the weighted sum is the confidence.
Weights are found by expectation-maximisation over the counts of patterns of steps; how often two rows have one identifier by chance is counted over
all rows, not among pairs that were found by it. Every pair that comes out has the confidence of its own pattern or, if it is joined through other
rows, of the weakest pattern on the way. Confident pairs form entities; what only a name speaks for is taken where the name is unambiguous.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, tidy, written
from .namekit import read, sound
from .one_form import names_of
from .spellings import components

NAME_RADIUS = 7
#: Two bits a q-gram keep the chunks of short identifiers from being empty; the distance counts every q-gram twice.
ID_RADIUS = 6
EM_ROUNDS = 60
#: Lowest Dice coefficients of the steps of names and identifiers, the highest being equality; below the first nothing agrees.
NAME_STEPS = [0.7, 0.8, 0.84, 0.88, 0.93, 0.999]
ID_STEPS = [0.8, 0.9, 2.0]
#: Identifiers of no meaning are told by their look; markers are words, one repeated sign, a count from one, or no digit at all.
PLACEHOLDER = re.compile(r"^(?:(.)\1*|unknown|na|none|null|tbd|pending|notavailable|0*1?2?3?4?5?6?7?8?9?0?)$")


def bit_of(gram: str) -> int:
    return (zlib.crc32(gram.encode()) * 2654435761 >> 7) % 128


def _signed(v: int) -> int:
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def vector(words: list[str], bits: int = 1) -> tuple[int, int]:
    """Two longs with ``bits`` bits for each pair of neighbouring letters, word borders included."""
    v = 0
    for w in words:
        p = f"^{w}$"
        for i in range(len(p) - 1):
            for k in range(bits):
                v |= 1 << bit_of(p[i : i + 2] + "'" * k)
    return _signed(v), _signed(v >> 64)


def bare_id(text: str | None) -> str:
    """An identifier without signs, case and a leading "No."; "" for placeholders."""
    if not text:
        return ""
    x = re.sub(r"[^a-z0-9]", "", re.sub(r"^\s*(?:no|nr|num)\b\.?", "", text.lower()))
    return "" if PLACEHOLDER.match(x) or not re.search(r"\d", x) else x


def name_vectors(names: DataFrame) -> DataFrame:
    """(name, v1, v2, trade) of the distinct strings that name somebody; one word of a person's name doesn't. names: (name, alone)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, alone in zip(pdf["name"], pdf["alone"], strict=True):
                _, words, _, trade = read(name)
                if len(words) > 1 or len("".join(words)) >= 10 or (words and alone):
                    out.append((name, *vector([sound(w) for w in words]), "|".join(trade)))
            yield pd.DataFrame(out, columns=["name", "v1", "v2", "trade"])

    return names.groupBy("name").agg(F.max("alone").alias("alone")).mapInPandas(parse, "name string, v1 long, v2 long, trade string")


def id_vectors(entities: DataFrame) -> DataFrame:
    """(record_id, identifier, v1, v2, trade) of the identifiers that mean something; trade is empty, as ids have none."""
    ids = F.transform(F.coalesce("government_ids", F.array().cast(entities.schema["government_ids"].dataType)), lambda g: g["identifier"])
    raw = entities.select("record_id", F.explode(F.concat(ids, F.array(F.concat(F.lit("imo"), F.regexp_replace("imo_number", "[^0-9]", ""))))).alias("raw")).where("raw IS NOT NULL")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, raw_ in zip(pdf["record_id"], pdf["raw"], strict=True):
                if x := bare_id(raw_):
                    out.append((i, x, *vector([x], 2), ""))
            yield pd.DataFrame(out, columns=["record_id", "identifier", "v1", "v2", "trade"])

    return raw.mapInPandas(parse, "record_id long, identifier string, v1 long, v2 long, trade string").distinct()


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1"))) + F.bit_count(F.col(f"{a}2").bitwiseXOR(F.col(f"{b}2")))


def dice(a: str, b: str) -> Column:
    both = F.bit_count(F.col(f"{a}1").bitwiseAND(F.col(f"{b}1"))) + F.bit_count(F.col(f"{a}2").bitwiseAND(F.col(f"{b}2")))
    size = F.bit_count(f"{a}1") + F.bit_count(f"{a}2") + F.bit_count(f"{b}1") + F.bit_count(f"{b}2")
    return 2 * both / size


def close_vectors(vectors: DataFrame, radius: int) -> DataFrame:
    """(va, vb, dice) for all pairs of different vectors of one trade within ``radius``, exactly; radius below 8.

    vectors: (vid, v1, v2, trade), distinct. Each side of a pair is filed and looked up in four chunks of 32 bits.
    """
    if not 0 <= radius < 8:
        raise ValueError("four chunks with at most one flipped bit each find pairs within 7")
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: F.shiftrightunsigned(c, 32)
    chunks = F.array(low("v1"), high("v1"), low("v2"), high("v2"))
    filed = vectors.select("vid", "v1", "v2", "trade", F.posexplode(chunks).alias("c", "chunk"))
    flips = [1 << b for b in range(32)] if radius >= 4 else []
    probes = F.array(F.col("chunk"), *[F.col("chunk").bitwiseXOR(F.lit(x)) for x in flips])
    asked = filed.select("vid", "v1", "v2", "trade", "c", F.explode(probes).alias("chunk"))
    key = F.xxhash64("c", "chunk", "trade")
    a = asked.select(key.alias("key"), F.col("vid").alias("va"), F.col("v1").alias("a1"), F.col("v2").alias("a2"), F.col("trade").alias("ta"))
    b = filed.select(key.alias("key"), F.col("vid").alias("vb"), F.col("v1").alias("b1"), F.col("v2").alias("b2"), F.col("trade").alias("tb"))
    met = a.join(b, "key").where((F.col("va") < F.col("vb")) & (F.col("ta") == F.col("tb")) & (hamming("a", "b") <= radius))
    return met.select("va", "vb", F.round(dice("a", "b"), 4).alias("dice")).distinct()


def with_self(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Both directions, and every vector with itself."""
    one = vectors.select(F.col("vid").alias("va"), F.col("vid").alias("vb"), F.lit(1.0).alias("dice"))
    return pairs.union(pairs.select(F.col("vb").alias("va"), F.col("va").alias("vb"), "dice")).union(one)


def birth_level(a: str, b: str) -> Column:
    """2 equal, 1 could be the same (first of January, day and month swapped, days apart), 0 different, null unknown."""
    jan = lambda d: (F.month(d) == 1) & (F.dayofmonth(d) == 1)
    inexact = (F.year(a) == F.year(b)) & (jan(a) | jan(b))
    swapped = (F.year(a) == F.year(b)) & (F.month(a) == F.dayofmonth(b)) & (F.month(b) == F.dayofmonth(a))
    near = F.abs(F.datediff(a, b)) <= 3
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(None)).when(F.col(a) == F.col(b), 2).when(inexact | swapped | near, 1).otherwise(0)


def type_class(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("person", "individual"), "person").when(low.isin("vessel", "ship"), "vessel").when(low == "aircraft", "aircraft").when(low.isin("business", "organization", "entity", "company"), "company")


class Calibration:
    """Weights of the steps of each field; unknown fields say nothing."""

    def __init__(self, m: list[dict], u: list[dict], prior: float) -> None:
        self.m, self.u, self.prior = m, u, prior

    def __call__(self, pattern: tuple) -> float:
        """Probability that a pair of this pattern is a match; a step that was never seen weighs as the highest that was."""
        odds = math.log(self.prior) - math.log(1 - self.prior)
        for f, v in enumerate(pattern):
            if v is not None and self.m[f]:
                v = v if v in self.m[f] else max(self.m[f])
                odds += math.log(self.m[f][v]) - math.log(self.u[f][v])
        return 1 / (1 + math.exp(max(-500.0, min(500.0, -odds))))


def calibrated(patterns: list[tuple[tuple, int]], rounds: int = EM_ROUNDS, chance: dict[int, tuple[int, float]] | None = None) -> Calibration:
    """Weights by expectation-maximisation over pattern counts.

    A pattern is a tuple of steps, None where a field is unknown. The start favours agreement, so the first class is that of
    matches. chance: for a field, a step and how often two rows of different entities have it, counted elsewhere.
    """
    fields = range(len(patterns[0][0])) if patterns else range(3)
    levels = [sorted({p[f] for p, _ in patterns if p[f] is not None}) for f in fields]
    top = [max(x, default=0) for x in levels]
    m = [{v: 0.9 if v == top[f] else 0.1 / max(1, len(levels[f]) - 1) for v in levels[f]} for f in fields]
    u = [{v: 0.1 if v == top[f] else 0.9 / max(1, len(levels[f]) - 1) for v in levels[f]} for f in fields]
    for f, (v, p) in (chance or {}).items():
        if v in u[f]:
            u[f][v] = min(u[f][v], max(p, 1e-9))
    now = Calibration(m, u, 0.5)
    if not patterns:
        return now
    all_ = sum(n for _, n in patterns)
    for _ in range(rounds):
        post = {p: now(p) for p, _ in patterns}
        yes = sum(n * post[p] for p, n in patterns)
        for f in fields:
            for side, w in ((m, lambda p: post[p]), (u, lambda p: 1 - post[p])):
                total = sum(n * w(p) for p, n in patterns if p[f] is not None)
                for v in levels[f]:
                    side[f][v] = (sum(n * w(p) for p, n in patterns if p[f] == v) + 0.5) / (total + 0.5 * len(levels[f]))
            if chance and f in chance and chance[f][0] in u[f]:
                u[f][chance[f][0]] = min(u[f][chance[f][0]], max(chance[f][1], 1e-9))
        now = Calibration(m, u, min(0.999, max(0.001, yes / all_)))
    return now


def list_id(source_id: Column) -> Column:
    """A list's own id without differences of format: case, separators, leading zeros and a decimal nought."""
    low = F.regexp_replace(F.lower(F.trim(source_id)), r"^(\d+)\.0+$", "$1")
    dotted = F.regexp_replace(F.regexp_replace(low, r"[\s._/-]+", "."), r"^([a-z]+)\.?(?=\d)", "$1.")
    return F.regexp_replace(dotted, r"^([a-z]+\.)?0+(?=\d)", "$1")


def step(value: Column, steps: list[float]) -> Column:
    """How many of the steps a value reaches."""
    return sum((F.when(value >= x, 1).otherwise(0) for x in steps), F.lit(0))


class Read:
    """What is compared of each row, read once: vectors of names and identifiers, and who has them."""

    def __init__(self, entities: DataFrame) -> None:
        kind = type_class(F.col("entity_type"))
        self.base = entities.select("record_id", "birth_date", kind.alias("type"))
        held = written(names_of(entities, "entity_type").select("record_id", "name", F.coalesce(kind != "person", F.lit(True)).alias("alone")).distinct())
        vectors = written(name_vectors(held.select("name", "alone")).withColumn("vid", F.xxhash64("v1", "v2", "trade")))
        self.kinds = vectors.select("vid", "v1", "v2", "trade").distinct()
        self.owners = written(held.join(vectors.select("name", "vid"), "name").select("record_id", "vid").distinct())
        ids = written(id_vectors(entities).withColumn("vid", F.xxhash64("identifier")))
        self.id_kinds = ids.select("vid", "v1", "v2", "trade").distinct()
        self.id_owners = ids.select("record_id", "vid").distinct()


def scored_pairs(r: Read, rows: DataFrame) -> DataFrame:
    """(a, b, name_level, id_level, birth_level): all pairs of the rows (record_id) near in a name or an identifier, levels null if unknown."""
    owners, id_owners = r.owners.join(rows, "record_id", "left_semi"), r.id_owners.join(rows, "record_id", "left_semi")
    near = with_self(written(close_vectors(r.kinds, NAME_RADIUS).where(F.col("dice") >= NAME_STEPS[0])), r.kinds)
    by_name = (
        owners.select(F.col("record_id").alias("a"), F.col("vid").alias("va")).join(near, "va").join(owners.select(F.col("record_id").alias("b"), F.col("vid").alias("vb")), "vb")
        .where("a < b").groupBy("a", "b").agg(F.max("dice").alias("name"))
    )
    id_near = with_self(written(close_vectors(r.id_kinds, ID_RADIUS).where(F.col("dice") >= ID_STEPS[0])), r.id_kinds)
    by_id = (
        id_owners.select(F.col("record_id").alias("a"), F.col("vid").alias("va")).join(id_near, "va").join(id_owners.select(F.col("record_id").alias("b"), F.col("vid").alias("vb")), "vb")
        .where("a < b").groupBy("a", "b").agg(F.max(F.when(F.col("va") == F.col("vb"), 2.0).otherwise(F.col("dice"))).alias("id"))
    )
    has_id = r.id_owners.select("record_id").distinct().withColumn("has", F.lit(True))
    wide = r.base.join(has_id, "record_id", "left")
    side = lambda t: wide.select(F.col("record_id").alias(t), F.col("birth_date").alias(f"born_{t}"), F.col("type").alias(f"type_{t}"), F.col("has").alias(f"has_{t}"))
    pairs = by_name.join(by_id, ["a", "b"], "full").join(side("a"), "a").join(side("b"), "b").where("type_a IS NULL OR type_b IS NULL OR type_a = type_b")
    name = F.when(F.col("name").isNull(), 0).otherwise(step(F.col("name"), NAME_STEPS))
    known = F.col("has_a") & F.col("has_b")
    ident = F.when(F.col("id").isNotNull(), step(F.col("id"), ID_STEPS)).when(known, 0)
    return pairs.select("a", "b", name.alias("name_level"), ident.alias("id_level"), birth_level("born_a", "born_b").alias("birth_level"))


def copy_classes(r: Read) -> DataFrame:
    """(record_id, first, has_id, has_birth): rows with the same names, identifiers, birth date and type, the least of them, and what they have."""
    names = r.owners.groupBy("record_id").agg(F.array_sort(F.collect_set("vid")).alias("names"))  # bounded by one row
    ids = r.id_owners.groupBy("record_id").agg(F.array_sort(F.collect_set("vid")).alias("ids"))
    all_ = r.base.join(names, "record_id").join(ids, "record_id", "left")
    signed = all_.select("record_id", F.xxhash64("names", "ids", "birth_date", "type").alias("s"), F.col("ids").isNotNull().alias("has_id"), F.col("birth_date").isNotNull().alias("has_birth"))
    first = signed.groupBy("s").agg(F.min("record_id").alias("first"))
    mine = signed.join(first, "s").select("record_id", "first", "has_id", "has_birth")
    rest = r.base.join(mine, "record_id", "left_anti").select("record_id", F.col("record_id").alias("first"), F.lit(False).alias("has_id"), F.lit(False).alias("has_birth"))
    return mine.union(rest)


def same_id_by_chance(r: Read, counts: list[tuple[tuple, int]]) -> float:
    """How often two rows of different entities have one identifier: pairs that share one though their birth dates differ, over all pairs of rows
    that have identifiers."""
    n = r.id_owners.select("record_id").distinct().count()
    differing = sum(k for (_, ident, birth), k in counts if ident == TOP_ID and birth == 0)
    return min(0.5, (differing + 0.5) / max(1.0, n * (n - 1.0) / 2))


TOP_NAME, TOP_ID = len(NAME_STEPS), len(ID_STEPS)


def matched(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """(record_id_a, record_id_b, confidence): pairs of rows of different lists that describe the same entity.

    Rows without a telling name and identifier match nothing; null types, dates and identifiers say nothing; repeated record ids
    count as one row; an empty table gives an empty result. Copies have the confidence of the pattern of equal rows. A pair that is not near
    itself but joined through other rows has the least confidence of its entity.
    """
    rows = entities.dropDuplicates(["record_id"])
    r = Read(rows)
    # rows that read the same in every field are one class; only its first row is compared, so a third of all rows
    # being copies of one another costs no pairs
    copies = written(copy_classes(r))
    pairs = written(scored_pairs(r, copies.where("record_id = first").select("record_id")))
    levels = ["name_level", "id_level", "birth_level"]
    counts = [((x.name_level, x.id_level, x.birth_level), x.n) for x in pairs.groupBy(*levels).agg(F.count("*").alias("n")).collect()]  # at most 7 * 5 * 4 patterns
    chance = calibrated(counts, chance={1: (TOP_ID, same_id_by_chance(r, counts))})
    spark = entities.sparkSession
    scale = spark.createDataFrame([(*p, float(chance(p))) for p, _ in counts], "name_level int, id_level int, birth_level int, confidence double")
    same = [pairs[c].eqNullSafe(scale[c]) for c in levels]
    judged = pairs.join(F.broadcast(scale), same[0] & same[1] & same[2]).select("a", "b", *[pairs[c] for c in levels], "confidence")
    sure = F.col("confidence") >= least
    same_id = F.coalesce((F.col("id_level") == TOP_ID) & (F.coalesce("birth_level", F.lit(1)) > 0), F.lit(False)) & sure
    same_birth = F.coalesce((F.col("birth_level") > 0) & (F.col("name_level") > 0), F.lit(False)) & sure
    against = F.coalesce(F.col("birth_level") == 0, F.lit(False)) & F.coalesce(F.col("id_level") < TOP_ID, F.lit(True)) & (F.col("name_level") > 0)
    judged = written(judged.withColumn("kind", F.when(same_id | same_birth, "strong").when(against, "against").when((F.col("name_level") > 0) & sure, "weak")).where("kind IS NOT NULL"))
    equal = F.when(F.col("has_id") & F.col("has_birth"), chance((TOP_NAME, TOP_ID, 2))).when(F.col("has_id"), chance((TOP_NAME, TOP_ID, None))).when(F.col("has_birth"), chance((TOP_NAME, None, 2))).otherwise(chance((TOP_NAME, None, None)))
    alike = copies.where("record_id <> first").withColumn("confidence", equal)
    evident = F.col("has_id") | F.col("has_birth")
    judged_copies = alike.where(~evident).select(F.col("first").alias("a"), F.col("record_id").alias("b"), F.lit("weak").alias("kind"))
    strong = judged.where("kind = 'strong'").select(F.col("a").alias("x"), F.col("b").alias("y")).union(alike.where(evident).select(F.col("first").alias("x"), F.col("record_id").alias("y")))
    one = written(components(rows.select("record_id"), strong, "record_id"))
    # by a name alone: groups of entities that share a name and hold no contradiction become one; equal names before near ones, so a
    # contradiction among near names leaves the groups of equal names as they are
    tidy(spark)
    entity = one.withColumnRenamed("root", "entity")
    loose = written(judged.where("kind <> 'strong'").select("a", "b", "kind", F.col("name_level").cast("int").alias("level")).union(judged_copies.select("a", "b", "kind", F.lit(TOP_NAME).alias("level"))))
    for lowest in (TOP_NAME, 1):
        ra, rb = entity.select(F.col("record_id").alias("a"), F.col("entity").alias("x")), entity.select(F.col("record_id").alias("b"), F.col("entity").alias("y"))
        between = written(loose.where(F.col("level") >= lowest).join(ra, "a").join(rb, "b").where("x <> y").select("x", "y", "kind").distinct())
        wide = written(components(entity.select(F.col("entity").alias("record_id")).distinct(), between.where("kind = 'weak'").select("x", "y"), "record_id"))
        bad = between.where("kind = 'against'").join(wide.select(F.col("record_id").alias("x"), F.col("root").alias("wx")), "x").join(wide.select(F.col("record_id").alias("y"), F.col("root").alias("wy")), "y").where("wx = wy").select(F.col("wx").alias("root")).distinct()
        wide = wide.join(bad.withColumn("bad", F.lit(True)), "root", "left").select(F.col("record_id").alias("entity"), F.when(F.col("bad"), F.col("record_id")).otherwise(F.col("root")).alias("new"))
        entity = written(entity.join(wide, "entity").select("record_id", F.col("new").alias("entity")))
    weakest = judged.where("kind <> 'against'").select("a", "confidence").union(alike.select(F.col("first").alias("a"), "confidence")).join(entity.select(F.col("record_id").alias("a"), "entity"), "a").groupBy("entity").agg(F.min("confidence").alias("low"))
    # pairs are formed between the first rows of classes of copies, each judged once, then given to their members
    lists = rows.select("record_id", "source_list")
    member = written(entity.join(lists, "record_id").join(copies.select("record_id", "first"), "record_id"))
    left = member.select("entity", F.col("record_id").alias("a"), F.col("source_list").alias("la"), F.col("first").alias("fa"))
    right = member.select("entity", F.col("record_id").alias("b"), F.col("source_list").alias("lb"), F.col("first").alias("fb"))
    own = judged.where("kind <> 'against'").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "confidence")
    out = left.join(right, "entity").where("a < b AND la <> lb").withColumn("lo", F.least("fa", "fb")).withColumn("hi", F.greatest("fa", "fb"))
    out = out.join(own, ["lo", "hi"], "left").join(weakest, "entity", "left").join(alike.select(F.col("first").alias("lo"), F.col("confidence").alias("equal")).distinct(), "lo", "left")
    confidence = F.when(F.col("lo") == F.col("hi"), F.col("equal")).otherwise(F.coalesce("confidence", "low"))
    return out.select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"), F.round(confidence, 6).alias("confidence"))


def p7_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of different lists that describe one entity, with a confidence."""
    return matched(table(spark, folder, "entities"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_matches(spark, folder).select("record_id_a", "record_id_b")
