"""Long exact spans shared between records: repeated-phrase automata.

1. Anchors. Every document is sampled by winnowing: hashes of all ``k``-grams, the least in each window of ``w``. With
   k + w - 1 = min_chars, any span of min_chars that stands in two documents holds at least one anchor of both, so
   nothing is lost; about 2 / (w + 1) of all positions are kept.
2. Confirmed phrases. Anchors that stand in two documents are read with what stands left and right of them. Occurrences
   with equal surroundings become one class. A window of min_chars around an anchor can only be shared from an
   offset at which two surroundings part; those offsets are the common-suffix lengths of neighbours in sorted order. Each
   such window that stands in two documents is a phrase; phrases that stand in the same documents are represented
   by one.
3. Automata. Phrases are put into shards of bounded size, an Aho-Corasick automaton is compiled for each, and the documents
   that hold an anchor of a shard are streamed through it. A document without such an anchor can't hold a phrase of the
   shard, so leaving it out loses nothing. The automata see the text itself: hashes decide nothing in the pairs.
4. Passages. A maximal shared passage starts with a located phrase that not everywhere has the same character before it, and ends
   with one that not everywhere has the same after it. All spans between such places are told equal by 128-bit digests; of those
   that stand in two documents the ones inside no other remain.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread, table, written

MIN_CHARS = 240
K = 120
SHARD_CHARS = 1_500_000
TASK_CHARS = 24_000_000
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for b in (_BASE, _INVERSE):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers.clear()
        _powers[size] = (out[0], out[1])
    a, b = _powers[size]
    return a[:n], b[:n]


def _sliding(x: np.ndarray, w: int, f: np.ufunc, pad: int) -> np.ndarray:
    """f over each window of w, by blocks: no factor w in the work."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, pad, dtype=np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    before = f.accumulate(y, axis=1).ravel()
    after = f.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(after[: n - w + 1], before[w - 1 : n])


def anchors(texts: list[str], min_chars: int = MIN_CHARS, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash) of every anchor of the texts, handled as one array."""
    w = min_chars - k + 1
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    if n < min_chars:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(codes + np.uint64(0x51_7C_C1_B7_27_22_0A_95)) * up[:n], out=sums[1:])
    h = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    h[h == _MASK] = _MASK - 1
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    crosses = np.arange(n - k + 1) + k > ends[owner[: n - k + 1]]
    h[crosses] = _MASK  # a k-gram over a border is nobody's
    if len(h) < w:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    least = _sliding(h, w, np.minimum, _MASK)
    starts = np.arange(len(least))
    least[starts + w - 1 + k > ends[owner[: len(least)]]] = 0  # nor a window over a border
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    most = _sliding(padded, w, np.maximum, 0)
    at = np.flatnonzero((most == h) & ~crosses)
    return owner[at], at - (ends - lengths)[owner[at]], h[at]


def _batches(ids: list, texts: list[str], min_chars: int) -> Iterator[tuple[list, list[str]]]:
    some, out, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        if t is None or len(t) < min_chars:
            continue
        some.append(i)
        out.append(t)
        size += len(t)
        if size >= CHUNK:
            yield some, out
            some, out, size = [], [], 0
    if some:
        yield some, out


def anchor_table(documents: DataFrame, key: str, text: str, min_chars: int, k: int) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, texts in _batches(pdf["_key"].tolist(), pdf["_text"].tolist(), min_chars):
                own, pos, h = anchors(texts, min_chars, k)
                yield pd.DataFrame({"h": h.view(np.int64), "_key": np.asarray(ids)[own], "pos": pos.astype(np.int32)})

    rows = spread(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    return rows.mapInPandas(find, f"h long, _key {documents.schema[key].dataType.simpleString()}, pos int")


def confirmed_phrases(documents: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS, k: int = K, both_ends: bool = False) -> tuple[DataFrame, DataFrame]:
    """Windows of min_chars that stand in two or more documents.

    Two tables: (phrase, phrase_text), one row a window; (phrase, key, from_char), one row an occurrence at an anchor. With
    both_ends, windows that end where surroundings part are added, so that the windows cover every shared character.
    """
    kind = documents.schema[key].dataType.simpleString()
    side = min_chars - k
    all_anchors = written(anchor_table(documents, key, text, min_chars, k))
    again = all_anchors.groupBy("h").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).where("a <> b").select("h")
    places = all_anchors.join(again, "h").groupBy("_key").agg(F.collect_list(F.struct("h", "pos")).alias("places"))  # bounded by one text

    def surround(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, places_ in zip(pdf["_key"], pdf["_text"], pdf["places"], strict=True):
                for p in places_:
                    pos = p["pos"]
                    out.append((p["h"], i, pos, t[max(0, pos - side) : pos], t[pos : pos + k], t[pos + k : pos + k + side]))
            yield pd.DataFrame(out, columns=["h", "_key", "pos", "before", "gram", "after"])

    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(places, "_key")
    surrounded = rows.mapInPandas(surround, f"h long, _key {kind}, pos int, before string, gram string, after string")
    surrounded = written(surrounded.withColumn("class", F.xxhash64("before", "gram", "after")))
    classes = surrounded.groupBy("h", "class").agg(F.first("before").alias("before"), F.first("gram").alias("gram"), F.first("after").alias("after"))

    # Offsets at which two surroundings of an anchor part. Sorted text has its nearest relative beside it; anchors that stand in
    # very many places are split by the four characters next to them, and the offsets 0 to 3 are tried for all.
    def parting(col: str) -> DataFrame:
        near = F.reverse(col) if col == "before" else F.col(col)
        one = classes.select("h", near.alias("s")).distinct().withColumn("salt", F.substring("s", 1, 4))
        last = F.lag("s").over(Window.partitionBy("h", "salt").orderBy("s"))
        paired = one.withColumn("t", last).where("t IS NOT NULL")
        return paired.select("h", "salt", common_prefix("s", "t").alias("o")).distinct().groupBy("h", "salt").agg(F.collect_set("o").alias("o"))

    def windows(col: str, left: bool) -> DataFrame:
        salted = classes.withColumn("salt", F.substring(F.reverse(col) if left else F.col(col), 1, 4)).join(parting(col), ["h", "salt"], "left")
        # equal text on this side up to the border of what is read, or to the text's end, is a parting too
        offsets = F.array_union(F.coalesce("o", F.array().cast("array<int>")), F.array(*[F.lit(x) for x in range(4)], F.least(F.length(col), F.lit(side))))
        tried = salted.select("class", "before", "gram", "after", F.explode(offsets).alias("o"))
        start = F.col("o") if left else F.lit(side) - F.col("o")  # characters taken of "before"
        tried = tried.withColumn("o", start).where((F.col("o") >= 0) & (F.length("before") >= F.col("o")) & (F.length("after") >= F.lit(side) - F.col("o")))
        body = F.concat(F.expr("substring(before, length(before) - o + 1, o)"), "gram", F.expr(f"substring(after, 1, {side} - o)"))
        return tried.select("class", "o", body.alias("phrase_text"))

    found = windows("before", True)
    if both_ends:
        found = found.union(windows("after", False))
    found = written(found.distinct().select(F.concat(F.hex(F.xxhash64("phrase_text")), F.hex(F.hash("phrase_text"))).alias("phrase"), "class", "o", "phrase_text"))
    members = surrounded.select("class", "_key", "pos")
    placed = found.select("phrase", "class", "o").join(members, "class").select("phrase", F.col("_key").alias(key), (F.col("pos") - F.col("o")).alias("from_char")).distinct()
    shared = placed.groupBy("phrase").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("phrase")
    texts = found.join(shared, "phrase", "left_semi").groupBy("phrase").agg(F.first("phrase_text").alias("phrase_text"))
    return texts, placed.join(shared, "phrase", "left_semi")


def common_prefix(a: str, b: str) -> Column:
    """Length of the common prefix of two string columns, found by halving steps: eight comparisons."""
    fits = f"n + step <= least(length({a}), length({b})) and substring({a}, n + 1, step) = substring({b}, n + 1, step)"
    return F.expr(f"aggregate(array(128, 64, 32, 16, 8, 4, 2, 1), 0, (n, step) -> if({fits}, n + step, n))")


def representatives(texts: DataFrame, placed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """One phrase for all that stand in the same documents: (phrase, phrase_text) and (phrase, key)."""
    where = placed.select("phrase", key).distinct()
    mark = F.xxhash64(key)
    signed = where.groupBy("phrase").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("s"), F.bit_xor(mark).alias("x"))
    one = signed.groupBy("n", "s", "x").agg(F.min("phrase").alias("phrase")).select("phrase")
    return texts.join(one, "phrase", "left_semi"), where.join(one, "phrase", "left_semi")


def located(documents: DataFrame, key: str, text: str, texts: DataFrame, where: DataFrame, shard_chars: int = SHARD_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """(phrase, key, from_char, before, after): every occurrence of the phrases, found by one Aho-Corasick automaton a shard, and the
    characters beside it, "" at the ends of the text.

    A shard's documents are spread over as many tasks as their length needs, so no task holds more than about
    task_chars of text beside one automaton.
    """
    kind = documents.schema[key].dataType.simpleString()
    texts = written(texts)
    size = texts.agg(F.coalesce(F.sum(F.length("phrase_text")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / shard_chars))
    shard = F.pmod(F.xxhash64("phrase"), F.lit(shards)).cast("int")
    wanted = where.select(F.col(key).alias("_key"), shard.alias("shard")).distinct()
    docs = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(wanted, "_key")
    length = wanted.join(documents.select(F.col(key).alias("_key"), F.length(text).alias("_n")), "_key").groupBy("shard").agg(F.ceil(F.sum("_n") / task_chars).cast("int").alias("tasks"))  # one row a shard
    docs = docs.join(length, "shard").withColumn("task", F.pmod(F.xxhash64("_key"), F.col("tasks")).cast("int"))
    phrases = texts.withColumn("shard", shard).join(length, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "phrase", "phrase_text")

    def stream(own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name, body in zip(own["phrase"], own["phrase_text"], strict=True):
            automaton.add_word(body, (name, len(body)))
        out = []
        if len(automaton):
            automaton.make_automaton()
            for i, t in zip(pdf["_key"], pdf["_text"], strict=True):
                for end, (name, n) in automaton.iter(t):
                    at = end - n + 1
                    out.append((name, i, at, t[at - 1 : at] if at else "", t[end + 1 : end + 2]))
        return pd.DataFrame(out, columns=["phrase", key, "from_char", "before", "after"])

    return phrases.groupBy("shard", "task").cogroup(docs.select("shard", "task", "_key", "_text").groupBy("shard", "task")).applyInPandas(stream, f"phrase string, `{key}` {kind}, from_char int, before string, after string")


def shared_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, k: int = K) -> DataFrame:
    """(key_a, key_b): documents that have at least min_chars consecutive characters in common.

    Null and shorter texts share nothing; long texts are read whole; rows that repeat a key count as one document; an empty
    table gives an empty result; further columns are ignored.
    """
    texts, placed = confirmed_phrases(documents, key, text, min_chars, k)
    texts, where = representatives(texts, written(placed), key)
    hits = written(located(documents, key, text, texts, where).select("phrase", key).distinct())
    a, b = hits.select("phrase", F.col(key).alias(f"{key}_a")), hits.select("phrase", F.col(key).alias(f"{key}_b"))
    return a.join(b, "phrase").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()


def shared_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, k: int = K) -> DataFrame:
    """(key, from_char, to_char, passage, holders): the maximal passages of each document that stand in another one too.

    Positions count from 0, to_char is exclusive. A passage is maximal if no longer span around it stands in any other document;
    passages of one document may overlap. Equal texts have one passage id; holders is the number of documents that hold it.
    """
    kind = documents.schema[key].dataType.simpleString()
    texts, placed = confirmed_phrases(documents, key, text, min_chars, k, both_ends=True)
    hits = written(located(documents, key, text, texts, written(placed).select("phrase", key)))
    parts = lambda c: (F.min(c) != F.max(c)) | (F.min(c) == "")
    turns = hits.groupBy("phrase").agg(parts("before").alias("opens"), parts("after").alias("closes"))
    at = hits.join(turns, "phrase").groupBy(F.col(key).alias("_key"), "from_char").agg(F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    starts = at.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("from_char", "opens", "closes"))).alias("starts"))  # bounded by one text

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["_key", "from_char", "to_char", "passage"]
        for pdf in batches:
            out = []
            for i, t, places in zip(pdf["_key"], pdf["_text"], pdf["starts"], strict=True):
                for n, first in enumerate(places):
                    if not first["opens"]:
                        continue
                    digest, done = hashlib.blake2b(digest_size=16), first["from_char"]
                    for p in places[n:]:
                        if p["from_char"] > done:  # no phrase goes on from here
                            break
                        end = p["from_char"] + min_chars
                        digest.update(t[done:end].encode("utf-8", "surrogatepass"))
                        done = end
                        if p["closes"]:
                            out.append((i, first["from_char"], end, digest.hexdigest()))
                    if len(out) > 100_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(starts, "_key")
    found = written(rows.mapInPandas(spans, f"_key {kind}, from_char int, to_char int, passage string").distinct())
    held = found.groupBy("passage").agg(F.countDistinct("_key").alias("holders")).where("holders > 1")
    before = Window.partitionBy("_key").orderBy("from_char", F.desc("to_char")).rowsBetween(Window.unboundedPreceding, -1)
    whole = found.join(held, "passage").withColumn("reach", F.coalesce(F.max("to_char").over(before), F.lit(-1))).where("to_char > reach")
    return whole.select(F.col("_key").alias(key), "from_char", "to_char", "passage", "holders")


def shared_coverage(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, k: int = K) -> DataFrame:
    """(key, n_chars, shared_chars, shared_share, passages): how much of each document stands in another one too.

    One row a document, zeros where nothing is shared or the text is null. passages: stretches of shared characters, overlapping
    passages being one.
    """
    by = Window.partitionBy(key).orderBy("from_char")
    reach = F.max("to_char").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = shared_passages(documents, key, text, min_chars, k).select(key, "from_char", "to_char").distinct().withColumn("reach", F.coalesce(reach, F.lit(-1)))
    fresh = F.greatest(F.lit(0), F.col("to_char") - F.greatest("from_char", "reach"))
    per = spans.groupBy(key).agg(F.sum(fresh).alias("shared_chars"), F.sum(F.when(F.col("from_char") > F.col("reach"), 1).otherwise(0)).alias("passages"))
    base = documents.groupBy(key).agg(F.coalesce(F.max(F.length(text)), F.lit(0)).alias("n_chars"))
    out = base.join(per, key, "left").fillna(0, ["shared_chars", "passages"])
    return out.withColumn("shared_share", F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 240 consecutive characters in common."""
    return shared_pairs(table(spark, folder, "documents"))


def p10_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every document stands elsewhere."""
    return shared_coverage(table(spark, folder, "documents"))


def p10_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The maximal passages that documents share."""
    return shared_passages(table(spark, folder, "documents"))
