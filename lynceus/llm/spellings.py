"""Variant spellings of names typed by people: merge-and-rematch resolution.

A profile is one name under all its known spellings: a list of slots (one a word), each with the spellings seen so far, the
initials of its words and its line of business. Names of listed records start as profiles of their own. Each round

1. blocks: a profile's words are linked to the vocabulary of words that are one deletion apart on either side, and two
   words of a name make a key, so candidates share two words up to small errors, whatever their order;
2. matches profile with profile, and typed names with profiles, slot by slot;
3. merges what matches: slots take the union of the spellings, so a merged profile has words that neither had together.

Profiles that grew re-enter blocking in the next round, with their new keys only; the rounds end when nothing merges any more. An initial is a slot
of its own and unites like a word; two different initials never meet. Typed names whose initials stand for words, or that lack a middle
name or a line of business, are matched to every profile that is new or grew too, but give it no spellings: they would merge different names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, table, tidy, written
from .addresses import LONG, shorter
from .namekit import NICK_OF, read, sound
from .one_form import names_of

MAX_TOTAL = 2
JOINED_FROM = 10


@lru_cache(maxsize=1 << 15)
def edits(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours being one; at most 9."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 3:
        return 9
    # what both begin and end with costs nothing
    least, k = min(len(a), len(b)), 0
    while k < least and a[k] == b[k]:
        k += 1
    a, b, least, e = a[k:], b[k:], least - k, 0
    while e < least and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[: len(a) - e], b[: len(b) - e]
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row[j] = v
        two, one = one, row
    return one[-1]


@lru_cache(maxsize=1 << 14)
def facts(word: str) -> tuple[str, frozenset, int, int]:
    """(sounded form, lines of given names, letters as written, letters as sounded) of a word; a letter is a bit."""
    s = sound(word)
    return s, NICK_SOUND.get(s, NONE), letters(word), letters(s)


def letters(word: str) -> int:
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 31)
    return out


def word_distance(a: str, b: str) -> int:
    """Edits between two words that can be the same word, the lesser of those as written and as sounded; 9 if they can't be. Short forms
    of a given name are 0 apart. An initial is equal to itself only."""
    if a == b:
        return 0
    if len(a) == 1 or len(b) == 1:
        return 9
    x, nick_a, written_a, sounded_a = facts(a)
    y, nick_b, written_b, sounded_b = facts(b)
    if x == y or nick_a and nick_b and nick_a & nick_b:
        return 0
    d = limited(x, y, sounded_a, sounded_b)
    return d if d == 1 or (a, b) == (x, y) else min(d, limited(a, b, written_a, written_b))


def limited(a: str, b: str, in_a: int, in_b: int) -> int:
    """Edits between two different words, 9 if they are too many for the shorter one. in_a, in_b: their letters; an edit takes one of them and gives
    one at most, so most words are told apart by them alone."""
    least = min(len(a), len(b))
    if least > LONG:
        return 9
    most = 2 if least >= 6 else 1 if least >= 4 else 0
    if a != b and (abs(len(a) - len(b)) > most or (in_a & ~in_b).bit_count() > most or (in_b & ~in_a).bit_count() > most):
        return 9
    d = edits(a, b)
    return d if d <= most else 9


NONE: frozenset = frozenset()
NICK_SOUND = {}
for _w, _lines in NICK_OF.items():
    NICK_SOUND[sound(_w)] = NICK_SOUND.get(sound(_w), NONE) | frozenset(_lines)


def assignment(cost: list[list[int]]) -> tuple[int, list[int]]:
    """Least total of an assignment of rows to different columns, and the column of each row; rows are at most as many as columns.

    Shortest augmenting paths: the work grows with the cube of the words of a name. Where every row has one least column and no two
    rows the same, that is the only best assignment.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    lows = [min(row) for row in cost]
    at = [row.index(low) for row, low in zip(cost, lows, strict=True)]
    if len(set(at)) == n and all(row.count(low) == 1 for row, low in zip(cost, lows, strict=True)):
        return sum(lows), at
    u, v, row_of = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, way, used = [1 << 30] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            used[j] = True
            r, delta, nxt = row_of[j], 1 << 30, 0
            for k in range(1, m + 1):
                if not used[k]:
                    c = cost[r - 1][k - 1] - u[r] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = nxt
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    at = [0] * n
    for k in range(1, m + 1):
        if row_of[k]:
            at[row_of[k] - 1] = k - 1
    return sum(cost[i][at[i]] for i in range(n)), at


def slot_cost(word: str, slot: list[str]) -> int:
    """Edits between a word and the nearest spelling of a slot."""
    return 0 if word in slot else min([word_distance(word, s) for s in slot], default=9)


def slot_distance(words: list[str], slots: list[list[str]]) -> int:
    """Least total of edits over assignments of words to slots, each word to the nearest spelling of its slot; 9 if none fits."""
    if len(words) != len(slots):
        return 9
    costs = []
    for w in words:
        row = [slot_cost(w, slot) for slot in slots]
        if min(row, default=9) > MAX_TOTAL:
            return 9
        costs.append(row)
    return min(9, assignment(costs)[0])


def fits(words: list[str], initials: list[str], slots: list[list[str]]) -> tuple[int, bool]:
    """(distance, whole) of a typed name with initials or without a middle name; whole if every slot is taken."""
    n, m = len(words), len(words) + len(initials)
    if n < 2 or m > len(slots):
        return 9, False
    costs = []
    for w in words:
        costs.append([slot_cost(w, slot) for slot in slots])
        if min(costs[-1]) > MAX_TOTAL:
            return 9, False
    costs += [[0 if any(i in (sound(s)[:1], sound(s[:1])) for s in slot) else 9 for slot in slots] for i in initials]
    if any(min(row) > MAX_TOTAL for row in costs):
        return 9, False
    d = assignment(costs)[0]
    return (d, m == len(slots)) if d <= MAX_TOTAL else (9, False)


def forms_of(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, form, kind, words, sounds, initials, trade) of every distinct string that names somebody; equal readings are one form.

    words: as written, in Latin letters; sounds: the same words sounded, place by place."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name in pdf["name"]:
                kind, words, initials, trade = read(name)
                if words:
                    words = sorted(words)
                    out.append((name, kind, words, [sound(w) for w in words], sorted(sound(i)[:1] for i in initials), trade))
            yield pd.DataFrame(out, columns=["name", "kind", "words", "sounds", "initials", "trade"])

    distinct = names.select(F.col(column).cast("string").alias("name")).where("name IS NOT NULL").distinct()
    read_ = distinct.mapInPandas(parse, "name string, kind string, words array<string>, sounds array<string>, initials array<string>, trade array<string>")
    return read_.withColumn("form", F.xxhash64("kind", "words", "initials", "trade"))


def joined_spelling(words: Column) -> Column:
    """Words run together, in either order of two."""
    return F.when(F.size(words) == 2, F.array(F.concat(words[0], words[1]), F.concat(words[1], words[0]))).otherwise(F.array(F.array_join(words, "")))


def vocabulary_links(words: DataFrame) -> DataFrame:
    """(word, sounded, n, ks, es): a word, its sounded form and its length; ks: hashes of that form and of every more frequent sounded form within
    reach of it; es: hashes of its first and last three letters, written and sounded.

    words: (word, sounded, n). Two sounded forms are within reach if deleting at most one letter of each, or of a word written so, makes
    them equal, or if they are short forms of one given name. Of two such forms the less frequent one gets the other as a key, so
    they share a key.
    """
    counts = words.groupBy("sounded").agg(F.sum("n").alias("n"))
    near = words.select("sounded", F.explode(F.array_union(shorter(F.col("word")), shorter(F.col("sounded")))).alias("cut"))
    nick = [(w, f"={line}") for w, lines in NICK_SOUND.items() for line in lines]  # fixed table
    nicks = F.broadcast(words.sparkSession.createDataFrame(nick, "sounded string, cut string"))
    near = near.union(counts.join(nicks, "sounded").select("sounded", "cut")).select("sounded", F.xxhash64("cut").alias("cut"))
    near = written(near.distinct().join(counts, "sounded"))
    a, b = near.select("sounded", "n", "cut"), near.select(F.col("sounded").alias("key_word"), F.col("n").alias("m"), "cut")
    more = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("key_word") > F.col("sounded")))
    reach = a.join(b, "cut").where(more).select("sounded", "key_word").union(counts.select("sounded", F.col("sounded").alias("key_word")))
    reach = reach.groupBy("sounded").agg(F.collect_set(F.xxhash64("key_word")).alias("ks"))  # bounded by the forms within reach
    ends = F.array(*[F.xxhash64(F.concat(F.lit(sign), F.substring(w, at, 3))) for w in ("word", "sounded") for sign, at in (("<", 1), (">", -3))])
    return words.join(reach, "sounded").select("word", "sounded", F.length("word").alias("n"), "ks", F.array_distinct(ends).alias("es"))


def pair_keys(slots: DataFrame, links: DataFrame, owner: str, rest: bool = False, single: bool = False) -> DataFrame:
    """(owner, key): hashes of two key words of different slots, or of a key word and the first or last three letters of
    another slot's word, written or sounded, which a word with several errors mostly keeps; with ``rest`` also the hashes of the other slots.
    Initials count only beside a single word. slots: (owner, slot, word); single: every slot has one word."""
    keyed = slots.join(links, "word").select(owner, "slot", "n", "ks", "es").repartition(owner)  # both groupings keep this partitioning
    if not single:
        keyed = keyed.groupBy(owner, "slot").agg(F.max("n").alias("n"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("ks", "es")])
    lists = keyed.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("slot", "n", "ks", "es"))).alias("all"))  # bounded by one name
    real = F.filter("all", lambda x: x["n"] > 1)
    lists = lists.withColumn("all", F.when(F.size(real) > 1, real).otherwise(F.col("all")))
    both = lambda x, y: F.concat(crossed(x["ks"], y["ks"]), crossed(x["ks"], y["es"]), crossed(x["es"], y["ks"]))
    if not rest:
        pairs = F.flatten(F.transform(F.col("all"), lambda x: F.flatten(F.transform(F.filter(F.col("all"), lambda y: y["slot"] > x["slot"]), lambda y: both(x, y)))))
        return lists.select(owner, F.explode(F.array_distinct(pairs)).alias("key"))
    others = lambda x, y: F.flatten(F.transform(F.filter(F.col("all"), lambda z: (z["slot"] != x["slot"]) & (z["slot"] != y["slot"])), lambda z: F.concat(z["ks"], z["es"])))
    pairs = F.flatten(F.transform(F.col("all"), lambda x: F.transform(F.filter(F.col("all"), lambda y: y["slot"] > x["slot"]), lambda y: F.struct(F.array_distinct(both(x, y)).alias("ks"), others(x, y).alias("rest")))))
    return lists.select(owner, F.explode(pairs).alias("p")).select(owner, F.explode("p.ks").alias("key"), "p.rest")


def crossed(p: Column, q: Column) -> Column:
    """Hashes of every pair of hashes from two lists, whatever their order."""
    return F.flatten(F.transform(p, lambda a: F.transform(q, lambda b: F.xxhash64(F.least(a, b), F.greatest(a, b)))))


def far_keys(slots: DataFrame, links: DataFrame, hot: DataFrame, owner: str) -> DataFrame:
    """(owner, key): hot keys of two words of names of three, with the third as it is left by deleting up to two letters, written and sounded.

    Where the third words are two edits apart the others are equal, so two such names have the key of those, under their own sounded forms or short
    forms of one given name, and a form of the third in common. Any other pair agrees in a further key word of its own."""
    alike: dict[str, set[str]] = {}
    for a, lines in NICK_SOUND.items():
        alike[a] = {b for b, others in NICK_SOUND.items() if lines & others}
    given = F.broadcast(slots.sparkSession.createDataFrame([(a, sorted(b)) for a, b in alike.items()], "sounded string, ks array<string>"))  # fixed table
    own = slots.join(links.select("word", "sounded"), "word").join(given, "sounded", "left")
    own = own.select(owner, "slot", "word", "sounded", F.array_union(F.array("sounded"), F.coalesce("ks", F.array().cast("array<string>"))).alias("ks"))
    keyed = own.groupBy(owner, "slot").agg(F.max(F.length("word")).alias("n"), F.array_distinct(F.flatten(F.collect_set("ks"))).alias("ks"), F.array_union(F.collect_set("word"), F.collect_set("sounded")).alias("ts"))
    lists = keyed.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("slot", "n", "ks", "ts"))).alias("all"))  # bounded by one name
    real = F.filter("all", lambda x: x["n"] > 1)
    lists = lists.withColumn("all", F.when(F.size(real) > 1, real).otherwise(F.col("all"))).where("size(all) = 3")
    at = lambda i: F.col("all")[i]
    hashes = lambda i: F.transform(at(i)["ks"], lambda k: F.xxhash64(k))
    rows = F.array(*[F.struct(F.array_distinct(crossed(hashes(i), hashes(j))).alias("ks"), F.filter(at(k)["ts"], lambda t: F.length(t) >= 6).alias("ts")) for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0))])
    met = lists.select(owner, F.explode(rows).alias("p")).where("size(p.ts) > 0").select(owner, "p.ts", F.explode("p.ks").alias("key")).join(hot, "key", "left_semi")
    cuts = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.flatten(F.transform(shorter(t), shorter)))))
    return met.select(owner, "key", F.explode(cuts).alias("cut")).select(owner, F.xxhash64("key", F.lit("far"), "cut").alias("key"))


def narrowed(keys: DataFrame, hot: DataFrame | None, slots: DataFrame, links: DataFrame, owner: str) -> DataFrame:
    """(owner, key) for names that must agree in every word: a hot key is narrowed by each of the other words, so names that have two
    words in common and differ in the rest don't meet; names of two words keep it among themselves. No pair within reach is lost, so which keys are
    hot changes no result. None: no key is hot. The rows are a table of ``written``."""
    if hot is None:
        return keys
    warm = slots.join(keys.join(hot, "key", "left_semi").select(owner).distinct(), owner, "left_semi")
    many = pair_keys(warm, links, owner, rest=True).join(hot, "key", "left_semi")
    wide = many.withColumn("key", F.explode(F.when(F.size("rest") > 0, F.transform("rest", lambda r: F.xxhash64("key", r))).otherwise(F.array(F.xxhash64("key", F.lit(-1)))))).drop("rest")
    return written(keys.join(hot, "key", "left_anti").unionByName(wide.unionByName(far_keys(warm, links, hot, owner)).distinct()))


def components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, root): least node reachable over edges (x, y); label propagation with pointer jumping, rounds logarithmic in path length.

    Only nodes that have an edge take part in the rounds; each round's table is deleted once the next is written.
    """
    both = written(edges.where("x <> y").select("x", "y").union(edges.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    if both.limit(1).count() == 0:
        discard(both)
        return nodes.select(node, F.col(node).alias("root"))
    labels = written(both.select(F.col("x").alias(node), F.col("x").alias("root")).distinct())
    while True:
        around = both.join(labels.withColumnRenamed(node, "y"), "y").groupBy("x").agg(F.min("root").alias("low"))
        step = labels.join(around, labels[node] == around["x"], "left").select(node, F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = step.select(F.col(node).alias("root"), F.col("root").alias("far"))
        new = written(step.join(jump, "root", "left").select(node, "was", F.least("root", "far").alias("root")))
        discard(labels)
        labels = new
        if new.where("root <> was").limit(1).count() == 0:
            break
    discard(both)
    joined = labels.select(F.col(node).alias("_node"), "root")
    return nodes.select(node).join(joined, F.col(node) == F.col("_node"), "left").select(node, F.coalesce("root", node).alias("root"))


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(x, y, d) of the pairs whose slots, as texts of ``as_text``, fit."""
    for pdf in batches:
        out = []
        for x, y, a, b in zip(pdf["x"], pdf["y"], pdf["slots_x"], pdf["slots_y"], strict=True):
            # a profile's own spellings against the other's: the nearest pair of each slot
            slots = of_text(b)
            best = min((slot_distance(w, slots) for w in _spellings(of_text(a))), default=9)
            if best <= MAX_TOTAL:
                out.append((x, y, best))
        yield pd.DataFrame(out, columns=["x", "y", "d"])


def as_text(slots: str) -> Column:
    """Slots as one text, which crosses to Python faster than lists do; words are letters only."""
    return F.array_join(F.transform(slots, lambda s: F.array_join(s, " ")), "|")


def of_text(text: str) -> list[list[str]]:
    return [s.split(" ") for s in text.split("|")]


def _spellings(slots: list[list[str]]) -> list[tuple[str, ...]]:
    """One word a slot: a slot's first spelling everywhere but in one place, where each of its spellings stands once."""
    base = tuple(s[0] for s in slots)
    out = {base}
    for k, s in enumerate(slots):
        out |= {(*base[:k], w, *base[k + 1 :]) for w in s}
    return list(out)


#: A key that more than half as many profiles, or typed names, share is narrowed by their other words; no pair is lost by it.
HOT_NAMES = 1000
SLOTS = "transform(concat(words, initials), w -> array(w))"


def resolve(names: DataFrame, typed: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of listed names, and the typed names linked to them.

    names, typed: one column ``name`` each; names may have ``alone``, whether one word of it names somebody. Returns (name, profile) of the
    listed names, (name, profile, distance) of the typed names, and the profiles. Names that read alike are linked first. Rounds go on until
    nothing merges; ``rounds`` can end them earlier.
    """
    listed = written(forms_of(names))
    asked = written(forms_of(typed))
    parts = "size(words) + size(initials)"
    full = asked.dropDuplicates(["form"]).where(f"size(words) > 0 AND {parts} > 1")
    whole = written(full.select("form", "kind", F.expr("concat(words, initials)").alias("words"), "trade"))
    # profiles: id, kind, trade, slots (array of arrays of spellings, the first one the profile's own); an initial is a slot of its own
    profiles = written(listed.dropDuplicates(["form"]).where("size(words) > 0").select(F.col("form").alias("id"), "kind", "trade", F.expr(SLOTS).alias("slots")))
    owner = written(listed.select("form", F.col("form").alias("id")).distinct())  # listed form -> profile
    own = profiles.select(F.col("id").alias("form"), F.expr("transform(slots, s -> s[0])").alias("words"))  # the first profiles; their table stays
    # equal readings are linked first; one word alone only where it names somebody
    alone = listed.select("name", "form").join(names.where("alone").select("name").distinct(), "name").select("form").distinct() if "alone" in names.columns else listed.select("form").distinct()
    same = asked.select("form", F.expr(parts).alias("n")).distinct().join(listed.select("form").distinct(), "form")
    attached = written(same.where("n > 1").union(same.where("n = 1").join(alone, "form", "left_semi")).select("form", F.col("form").alias("id"), F.lit(0).alias("d")))  # typed form -> profile, distance
    spelt = lambda df: df.select(F.inline(F.arrays_zip(F.expr("concat(words, initials)").alias("word"), F.expr("concat(sounds, initials)").alias("sounded"))))
    counts = spelt(listed).union(spelt(asked)).groupBy("word", "sounded").agg(F.count("*").alias("n"))
    links = written(vocabulary_links(written(counts)))  # one row a word
    typed_slots = whole.select("form", F.posexplode("words").alias("slot", "word"))
    typed_keys = written(pair_keys(typed_slots, links, "form", single=True))
    part = written(full.where("size(words) > 1 AND (size(initials) > 0 OR (kind <> 'c' AND size(words) = 2) OR (kind = 'c' AND size(trade) = 0))").select("form", "kind", "words", "initials", "trade"))
    part_keys = written(typed_keys.join(part.select("form"), "form", "left_semi"))
    slots_of = lambda df: df.select("id", F.posexplode("slots").alias("slot", "ws")).select("id", "slot", F.explode("ws").alias("word"))
    keys = written(pair_keys(slots_of(profiles), links, "id", single=True))
    often = lambda df: df.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT_NAMES // 2).select("key")
    typed_often = written(often(typed_keys))
    changed, n = profiles.select("id"), 0
    met = None  # names with a part missing -> profile
    given = None  # typed forms whose spellings a profile has
    while True:
        n += 1
        hot = written(often(keys).union(typed_often).distinct())
        some = hot if hot.limit(1).count() else None
        all_ = narrowed(keys, some, slots_of(profiles), links, "id")
        mine = written(all_.join(changed, "id", "left_semi")) if n > 1 else all_  # a table, so joins know when it is small
        fresh = mine if some is None else keys.join(changed, "id", "left_semi") if n > 1 else keys
        theirs = narrowed(typed_keys, some, typed_slots, links, "form")
        side = lambda t: profiles.select(F.col("id").alias(t), as_text("slots").alias(f"slots_{t}"), F.size("slots").alias(f"n_{t}"), F.array_join("trade", "|").alias(f"trade_{t}"), F.col("kind").alias(f"kind_{t}"))
        can = "n_x = n_y AND (trade_x = trade_y OR kind_x = 'e' OR kind_y = 'e')"
        pairs = mine.select(F.col("id").alias("x"), "key").join(all_.select(F.col("id").alias("y"), "key"), "key").where("x <> y")
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        fat = pairs.join(side("x"), "x").join(side("y"), "y").where(can)
        edges = written(fat.select("x", "y", "slots_x", "slots_y").mapInPandas(_match, "x long, y long, d int"))
        # typed names against profiles that are new or grew
        cand = mine.select(F.col("id").alias("y"), "key").join(theirs.select(F.col("form").alias("x"), "key"), "key").select("x", "y").distinct()
        ask = whole.select(F.col("form").alias("x"), F.array_join("words", "|").alias("slots_x"), F.size("words").alias("n_x"), F.array_join("trade", "|").alias("trade_x"), F.col("kind").alias("kind_x"))
        found = cand.join(ask, "x").join(side("y"), "y").where(can).select("x", "y", "slots_x", "slots_y").mapInPandas(_match, "x long, y long, d int")
        found = attached.union(found.select(F.col("x").alias("form"), F.col("y").alias("id"), "d"))
        more = partial_matches(part, part_keys, profiles, fresh)
        met_now = more if met is None else met.union(more)
        # merge profiles; every typed name gives its spellings to the nearest profile, if there is one nearest
        roots = written(components(profiles.select("id"), edges, "id"))
        moved = lambda df, *by: df.join(roots, "id").groupBy(*by, F.col("root").alias("id")).agg(F.min("d").alias("d"))
        was, attached = attached, written(moved(found, "form").select("form", "id", "d"))
        gone, met = met, written(moved(met_now, "form", "missing").select("form", "id", "d", "missing"))
        owned, owner = owner, written(owner.join(roots, "id").select("form", F.col("root").alias("id")))
        discard(was, gone, owned)
        tidy(profiles.sparkSession)
        by_distance = attached.repartition("form").groupBy("form", "d").agg(F.count("*").alias("m"), F.first("id").alias("id"))
        nearest = by_distance.groupBy("form").agg(F.min_by(F.struct("m", "id"), "d").alias("p")).where("p.m = 1").select("form", "p.id")
        giving = written(nearest.join(whole.select("form"), "form", "left_semi").select("form", "id"))
        merged = roots.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("merged"))
        new = giving if given is None else giving.join(given, ["form", "id"], "left_anti")
        touched = written(merged.where("merged > 1").select("id").union(new.select("id")).distinct())
        gifts = giving.join(whole.select("form", "words"), "form").select("id", "words").union(owner.join(own, "form").select("id", "words"))
        gifts = gifts.join(touched, "id", "left_semi").distinct()
        heads = profiles.join(roots, "id").groupBy("root").agg(F.min_by(F.struct("kind", "trade", "slots"), "id").alias("p"), F.count("*").alias("merged"))
        heads = written(heads.select(F.col("root").alias("id"), "p.*", "merged"))
        grown = written(grow(heads.join(touched, "id", "left_semi"), gifts).select("id", "kind", "trade", "slots", "merged"))
        spellings = "aggregate(slots, 0, (a, s) -> a + size(s))"
        before = profiles.select("id", F.expr(spellings).alias("was"))
        changed = written(grown.join(before, "id", "left").where(f"was IS NULL OR merged > 1 OR {spellings} > was").select("id"))
        old, profiles = profiles, written(heads.join(touched, "id", "left_anti").select("id", "kind", "trade", "slots").union(grown.select("id", "kind", "trade", "slots")))
        # keys of profiles that are as they were stay
        stay = keys.join(profiles.select("id"), "id", "left_semi").join(changed, "id", "left_anti")
        outdated, keys = keys, written(stay.unionByName(pair_keys(slots_of(profiles.join(changed, "id", "left_semi")), links, "id")))
        discard(old if n > 1 else None, heads, outdated, edges, roots, touched, grown, hot, given, *((all_, theirs) if some is not None else ()), *((mine,) if n > 1 else ()))
        given = giving
        tidy(profiles.sparkSession)
        if changed.limit(1).count() == 0 or (rounds and n >= rounds):
            break
    partial = written(unambiguous(met))
    run_together = written(attach_joined(asked, listed, owner))
    linked = written(attached.union(partial).union(run_together).groupBy("form", "id").agg(F.min("d").alias("d")))
    low = linked.groupBy("form").agg(F.min("d").alias("low"))
    linked = linked.join(low, "form").where("d <= greatest(low, 2)").select("form", "id", "d")
    return (
        listed.select("name", "form").join(owner, "form").select("name", F.col("id").alias("profile")).distinct(),
        asked.select("name", "form").join(linked, "form").select("name", F.col("id").alias("profile"), F.col("d").alias("distance")).distinct(),
        profiles,
    )


def grow(heads: DataFrame, gifts: DataFrame) -> DataFrame:
    """Profiles with the spellings of the names given to them, slot by slot. gifts: (id, words)."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, done = [], set()
            for key in zip(pdf["id"], pdf["slots"], pdf["words"], strict=True):
                if key in done:
                    continue
                done.add(key)
                slots, words = of_text(key[1]), key[2].split("|")
                at = assignment([[slot_cost(w, slot) for slot in slots] for w in words])[1]
                out += [(key[0], j, words[k]) for k, j in enumerate(at)]
            yield pd.DataFrame(out, columns=["id", "slot", "word"])

    fat = gifts.join(heads.select("id", "slots"), "id").where("size(words) = size(slots)")
    fat = fat.select("id", as_text("slots").alias("slots"), F.array_join("words", "|").alias("words"))
    new = fat.mapInPandas(align, "id long, slot int, word string").distinct().groupBy("id", "slot").agg(F.collect_set("word").alias("ws"))
    lists = new.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "ws"))).alias("more"))
    merged = F.expr("transform(slots, (s, k) -> array_distinct(concat(slice(s, 1, 1), array_sort(array_union(s, coalesce(more[k], array()))))))")
    return heads.join(lists, "id", "left").withColumn("slots", F.when(F.col("more").isNull(), F.col("slots")).otherwise(merged)).drop("more")


def partial_matches(part: DataFrame, part_keys: DataFrame, profiles: DataFrame, keys: DataFrame) -> DataFrame:
    """(form, id, d, missing): typed names with initials, without a middle name or without a line of business, against the profiles that have
    the keys. part_keys: the keys of the typed names. missing: what the typed name leaves open, "" if nothing."""
    cand = part_keys.join(keys, "key").select("form", "id").distinct()
    fat = cand.join(part, "form").join(profiles.select("id", "slots", F.col("kind").alias("pkind"), F.col("trade").alias("ptrade")), "id")
    fat = fat.where("size(initials) > 0 OR size(slots) > size(words) OR (kind = 'c' AND size(ptrade) > 0)")

    fat = fat.where("IF(kind = 'c', size(trade) = 0 AND size(ptrade) > 0 AND size(initials) = 0, size(ptrade) = 0 OR kind = 'e')")
    fat = fat.select("form", "id", "kind", *[F.array_join(c, "|").alias(c) for c in ("words", "initials", "ptrade")], as_text("slots").alias("slots"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for form, i, kind, words, initials, ptrade, text in pdf.itertuples(index=False, name=None):
                slots, words, initials = of_text(text), words.split("|"), initials.split("|") if initials else []
                if kind == "c":
                    d, missing = slot_distance(words, slots), ptrade
                else:
                    d, whole = fits(words, initials, slots)
                    missing = "" if whole else str(len(slots))
                    if not whole and initials:
                        continue
                if d <= MAX_TOTAL:
                    out.append((form, i, d, missing))
            yield pd.DataFrame(out, columns=["form", "id", "d", "missing"])

    return fat.mapInPandas(match, "form long, id long, d int, missing string")


def unambiguous(met: DataFrame) -> DataFrame:
    """(form, id, d): what is missing must be the same in all profiles that fit, and a missing middle name leaves one of them."""
    given = met.where("missing = ''")
    open_ = met.where("missing <> ''")
    sole = open_.groupBy("form").agg(F.countDistinct("missing").alias("m"), F.countDistinct("id").alias("k"), F.max(F.col("missing").rlike("^[0-9]+$")).alias("middle"))
    sole = sole.where("m = 1 AND (NOT middle OR k = 1)").select("form")
    return given.union(open_.join(sole, "form", "left_semi")).select("form", "id", "d")


def attach_joined(asked: DataFrame, listed: DataFrame, owner: DataFrame) -> DataFrame:
    """(form, id, d): names whose words one side runs together, as written or as sounded. Joined forms share their first or last five letters.

    Only pairs with a name of one word on a side are joined. Of what follows the five letters, cut into three pieces, two edits leave one piece as it
    is: the side that may have any number of words is filed by its pieces, the name of one word looks for them where edits can have moved them."""

    def spelled(df: DataFrame, words: str) -> DataFrame:
        s = df.where("size(initials) = 0").where(f"size(words) {words}").dropDuplicates(["form"]).select("form", "kind", "trade", "words", F.array_sort("sounds").alias("sounds"))
        one = lambda col, tag: s.select("form", F.xxhash64(F.lit(tag), "kind", "trade").alias("as"), F.explode(joined_spelling(F.col(col))).alias("w")).where(F.length("w") >= JOINED_FROM)
        both = one("sounds", "sounded").withColumn("w", F.regexp_replace("w", r"(.)\1+", "$1")).union(one("words", "written"))
        ends = both.select("form", "as", F.explode(F.array(F.struct(F.lit("<").alias("end"), "w"), F.struct(F.lit(">").alias("end"), F.reverse("w").alias("w")))).alias("t"))
        return ends.select("form", F.xxhash64("as", "t.end", F.substring("t.w", 1, 5)).alias("as"), F.expr("substring(t.w, 6)").alias("rest"))

    # pieces 0, 1 and 2 of m letters begin at 0, m div 3 and 2 * (m div 3); the last one ends with the letters
    filed = lambda m, k, piece: f"xxhash64(as, {m}, {k}, {piece})"
    held = [filed("length(rest)", k, p) for k, p in enumerate(("substring(rest, 1, length(rest) div 3)", "substring(rest, 1 + length(rest) div 3, length(rest) div 3)", "substring(rest, 1 + 2 * (length(rest) div 3))"))]
    looked = []
    for more in range(-MAX_TOTAL, MAX_TOTAL + 1):  # letters that the other side has more; moved: of the middle piece to the right
        m = f"(length(rest) + {more})"
        looked.append(filed(m, 0, f"substring(rest, 1, {m} div 3)"))
        looked += [filed(m, 1, f"IF({m} div 3 + {moved} < 0, NULL, substring(rest, 1 + {m} div 3 + {moved}, {m} div 3))") for moved in range(-MAX_TOTAL, MAX_TOTAL + 1) if abs(moved) + abs(more + moved) <= MAX_TOTAL]
        looked.append(filed(m, 2, f"IF(2 * ({m} div 3) - {more} < 0, NULL, substring(rest, 1 + 2 * ({m} div 3) - {more}))"))
    keyed = lambda df, keys, *named: df.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), *named)
    x = lambda words, keys: keyed(spelled(asked, words), keys, "form", "rest")
    y = lambda words, keys: keyed(spelled(listed, words), keys, F.col("form").alias("other"), F.col("rest").alias("spelt"))
    met = x("= 1", looked).join(y("> 0", held), "key").unionByName(x("> 1", held).join(y("= 1", looked), "key"))
    met = met.withColumn("d", F.levenshtein("rest", "spelt", MAX_TOTAL)).where("d >= 0")
    met = met.groupBy("form", "other").agg(F.min("d").cast("int").alias("d"))
    return met.join(owner.select(F.col("form").alias("other"), "id"), "other").select("form", "id", "d")


def linked_items(items: DataFrame, entities: DataFrame) -> DataFrame:
    """(item_id, record_id): the item's name is a spelling, exact or not, of that record's name or of one of its alt_names.

    Null, blank and filler names name nobody, and one word of a person's name neither; one word that reads as the name of something else, a
    vessel or a company, is linked to it. Items sent again are linked alike; an empty table on either side gives an empty result. Equal
    strings are read and matched once, however many rows hold them.
    """
    held = written(names_of(entities, "entity_type").select("record_id", "name", (~F.coalesce(F.lower(F.trim("entity_type")).isin("person", "individual"), F.lit(False))).alias("alone")).distinct())
    known = held.groupBy("name").agg(F.max("alone").alias("alone"))
    listed, typed, _ = resolve(known, items.select("name"))
    records = held.join(listed, "name").select("record_id", "profile").distinct()
    asked = items.select("item_id", "name").join(typed, "name").select("item_id", "profile").distinct()
    return asked.join(records, "profile").select("item_id", "record_id").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Search items linked to every record that carries the name meant."""
    return linked_items(table(spark, folder, "search_items"), table(spark, folder, "entities"))
