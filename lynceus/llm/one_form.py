"""Visually identical text with different characters: one consistent form by a Viterbi search of look-alike lattices.

After compatibility normalisation and deletion of ignorable characters every letter of a token becomes a column of the
letters that share its glyph. The column depends on the glyph alone, not on the letter typed, so tokens that look the
same have the same lattice and therefore the same best path. Paths are scored by character bigrams of each script,
counted over all tokens that are surely of one script, and by a price on changing script inside a token.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.script import LOOK_LATIN, _script, clean

SWITCH = 12.0
MIN_SHARE = 1 / 20_000
GLYPH: dict[str, list[str]] = {}
for _c, _l in LOOK_LATIN.items():
    GLYPH.setdefault(_l, [_l]).append(_c)
Bigrams = dict[tuple[str, str], float]


def columns(token: str) -> list[list[str]]:
    """For each letter of a token the letters with its glyph, accents kept."""
    out = []
    for c in token:
        base, *marks = unicodedata.normalize("NFD", c)
        same = GLYPH.get(LOOK_LATIN.get(base, base))
        out.append([unicodedata.normalize("NFC", x + "".join(marks)) for x in same] if same else [c])
    return out


def sure_script(token: str) -> str | None:
    """The script of a token that can be of one script only; None if it mixes scripts or any letter could be another's."""
    scripts = {_script(c) for c in token} - {""}
    if len(scripts) == 1 and any(len(col) == 1 for c, col in zip(token, columns(token), strict=True) if _script(c)):
        return scripts.pop()
    return None


def viterbi(token: str, bits: dict[str, Bigrams]) -> str:
    """The cheapest path through the token's lattice; ties go to the order of ``GLYPH``, Latin first."""
    lattice = columns(token)
    if all(len(col) == 1 for col in lattice):
        return token
    none = 18.0
    best: dict[tuple[str, str], tuple[float, str]] = {("^", ""): (0.0, "")}  # (letter, script so far) -> cost, path
    for col in lattice:
        ahead: dict[tuple[str, str], tuple[float, str]] = {}
        for (last, script), (cost, path) in best.items():
            for c in col:
                own = _script(c)
                now = own or script
                step = bits.get(now, {}).get((last, c), none) if own else 0.0
                step += SWITCH if own and script and own != script else 0.0
                x = (cost + step, path + c)
                k = (c, now)
                if k not in ahead or x[0] < ahead[k][0]:
                    ahead[k] = x
        best = ahead
    return min(best.values(), key=lambda x: x[0])[1]


def one_form(text: str, bits: dict[str, Bigrams], known: dict[str, str] | None = None) -> str:
    known = {} if known is None else known
    out = []
    for t in clean(unicodedata.normalize("NFC", text)).split(" "):
        if t not in known:
            known[t] = viterbi(t, bits)
        out.append(known[t])
    return " ".join(out)


def bigram_bits(texts: DataFrame, column: str) -> dict[str, Bigrams]:
    """Bits of character bigrams by script, counted over all texts. Only shares of at least MIN_SHARE of a script come
    to the driver: at most 1 / MIN_SHARE a script, whatever the size of the data."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for text in pdf[column].dropna():
                for t in clean(text).split(" "):
                    if s := sure_script(t):
                        last = "^"
                        for c in t:
                            n[s, last, c] += 1
                            last = c
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["s", "a", "b", "n"])

    sums = texts.select(column).mapInPandas(counted, "s string, a string, b string, n long").groupBy("s", "a", "b").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("s").agg(F.sum("n").alias("all"))
    rows = sums.join(F.broadcast(totals), "s").where(F.col("n") >= F.col("all") * MIN_SHARE).collect()  # scripts are few
    bits: dict[str, Bigrams] = {}
    after: Counter = Counter()
    for r in rows:
        after[r.s, r.a] += r.n
    for r in rows:
        bits.setdefault(r.s, {})[r.a, r.b] = math.log2((after[r.s, r.a] + 40) / (r.n + 0.5))
    return bits


def with_one_form(df: DataFrame, column: str, output: str = "one_form", bits: dict[str, Bigrams] | None = None) -> DataFrame:
    """Adds the consistent form of a text column. Null stays null, blank becomes ""; texts of any length are read whole."""
    model = bigram_bits(df, column) if bits is None else bits

    @F.pandas_udf(T.StringType())
    def form(s: pd.Series) -> pd.Series:
        tokens: dict[str, str] = {}
        texts: dict[str, str] = {}
        return s.map(lambda x: None if x is None else texts[x] if x in texts else texts.setdefault(x, one_form(x, model, tokens)))

    return df.withColumn(output, form(column))


def names_of(entities: DataFrame, *more: str) -> DataFrame:
    """(record_id, name_pos, name): the name at 0, the elements of alt_names from 1, and further columns; nulls and blanks are no names."""
    alts = F.coalesce(F.col("alt_names"), F.array().cast("array<string>"))
    return (
        entities.select("record_id", *more, F.posexplode(F.concat(F.array("name"), alts)).alias("name_pos", "name"))
        .where(F.col("name").isNotNull() & (F.trim("name") != ""))
    )


def same_look_pairs(names: DataFrame) -> DataFrame:
    """Pairs of places whose strings differ but look the same, ordered by (record_id, name_pos).

    names: (record_id, name_pos, name). Variants of one form are paired once, as strings; only the strings that have a
    look-alike are joined to the places that hold them, so copies of a frequent name cost nothing.
    """
    strings = with_one_form(names.select("name").distinct(), "name", bits=bigram_bits(names, "name"))
    variants = strings.groupBy("one_form").agg(F.count("*").alias("n")).where("n > 1").select("one_form")
    from ..session import written

    strings = written(strings.join(variants, "one_form"))
    pairs = strings.alias("a").join(strings.alias("b"), F.col("a.one_form") == F.col("b.one_form")).where("a.name <> b.name").select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
    left = names.select(F.col("record_id").alias("record_id_a"), F.col("name_pos").cast("int").alias("name_pos_a"), F.col("name").alias("name_a"))
    right = names.select(F.col("record_id").alias("record_id_b"), F.col("name_pos").cast("int").alias("name_pos_b"), F.col("name").alias("name_b"))
    return (
        pairs.join(left, "name_a").join(right, "name_b")
        .where(F.struct("record_id_a", "name_pos_a") < F.struct(F.col("record_id_b").alias("record_id_a"), F.col("name_pos_b").alias("name_pos_a")))
        .select("record_id_a", "name_pos_a", "record_id_b", "name_pos_b")
    )


def p5_found(spark, folder: str) -> DataFrame:
    """Different strings among entities.name and alt_names that look the same when displayed."""
    from ..session import table

    return same_look_pairs(names_of(table(spark, folder, "entities")))
