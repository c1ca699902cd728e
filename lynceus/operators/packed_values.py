"""Several values packed in one field: dialects selected by minimum description length.

A dialect is a set of delimiters with or without quoting. A field's description under a dialect is the dialect's own
cost, the code of each delimiter and the code of each value. Value codes are learned from all fields: the first word of a value, a word
inside one and the signs after a word cost minus log2 of their share, anything else its letters. Where the values of a field are listed, each has a
whole code. Each field is parsed with its cheapest dialect; counting and parsing alternate, so codes sharpen.

Codes are distributed: the values and words that a text could hold under any of its dialects are joined to the counts of all texts, so a text
is parsed with the very codes it needs and no table of codes is broadcast or cut. What stands in few texts has a code only if that pays:
what it saves where it stands must exceed stating it once. Every distinct text is parsed once a round, however many rows hold it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, written

ROUNDS = 3
LETTER_BITS = 4.2
# The delimiters, as patterns that also take the white space around them.
DELIMITERS = {";": r"\s*;\s*", ",": r"\s*,\s*", "|": r"\s*\|\s*", " / ": r"\s+/\s+", "/": r"\s*/\s*", "\n": r"[ \t]*[\r\n]+[ \t]*", "\t": r" *\t+ *", "  ": r" {2,}", " ": r" +", "[]": ""}
MIXABLE = (";", ",", "|", " / ", "\n", "\t")
BLANK = frozenset(("", "-0-", "n/a", "null", "none", "-"))


def strip_value(text: str) -> str:
    """Trimmed, without enclosing quotes or brackets; doubled quotes inside enclosing quotes become single."""
    text = text.strip()
    while True:
        if len(text) > 1 and text[0] == text[-1] == '"' and '"' not in text[1:-1].replace('""', ""):
            text = text[1:-1].replace('""', '"').strip()
        elif len(text) > 1 and text[0] == "[" and _closing(text, 0) == len(text) - 1:
            text = text[1:-1].strip()
        else:
            return text


def _closing(text: str, at: int) -> int:
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "[") - (text[k] == "]")
        if depth == 0:
            return k
    return -1


@lru_cache(maxsize=512)
def _splitter(delimiters: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(DELIMITERS[d] for d in sorted(delimiters, key=len, reverse=True)))


def parse(text: str, delimiters: tuple[str, ...], quoted: bool) -> list[str] | None:
    """Raw pieces in order, None where the text isn't of this dialect."""
    if delimiters == ("[]",):
        out, at = [], 0
        while at < len(text):
            if text[at] == "[" and (end := _closing(text, at)) > 0:
                out.append(text[at : end + 1])
                at = end + 1
            elif text[at].isspace():
                at += 1
            else:
                return None
        return out
    split = _splitter(delimiters)
    if not quoted:
        return split.split(text)
    out, start, at, n = [], 0, 0, len(text)
    while True:
        while at < n and text[at] == " ":
            at += 1
        end = None
        if at < n and text[at] == '"':  # the quote that ends the piece is followed by a delimiter, a full stop or the end
            k = at + 1
            while (k := text.find('"', k)) >= 0:
                if text[k : k + 2] == '""':
                    k += 2
                    continue
                rest = k + 1
                m = split.match(text, rest)
                if m and m.end() > rest or not text[rest:].strip(" ."):
                    end = rest
                    break
                k += 1
        m = split.search(text, end if end is not None else at)
        while m and m.end() == m.start():
            m = None
        if not m:
            out.append(text[start:])
            return out
        out.append(text[start : m.start()])
        start = at = m.end()


def dialects(text: str) -> list[tuple[tuple[str, ...], bool]]:
    """The dialects that differ on this text: sets of delimiters that occur in it, quoting only where there are quotes."""
    there = [d for d, p in DELIMITERS.items() if d != "[]" and re.search(p, text.strip())]
    sets: list[tuple[str, ...]] = [()]
    sets += [(d,) for d in there]
    mixed = [d for d in there if d in MIXABLE]
    for n in range(2, len(mixed) + 1):
        sets += combinations(mixed, n)
    if text.lstrip()[:1] == "[":
        sets.append(("[]",))
    return [(s, q) for s in sets for q in ((False, True) if '"' in text and s and s != ("[]",) else (False,))]


def values_of(text: str, dialect: tuple[tuple[str, ...], bool]) -> list[str] | None:
    text = text.strip()
    if not dialect[0]:
        return [strip_value(text)] if text else []
    pieces = parse(text, *dialect)
    if pieces is None:
        return None
    out = [strip_value(p) for p in pieces]
    return [v for v in out if v]


def end_remark(text: str) -> str:
    """Without the full stop that ends a remark; one that closes an abbreviation of one letter stays."""
    text = text.rstrip()
    return text[:-1].rstrip() if text.endswith(".") and not re.search(r"(?:^|[\s.])\w\.$", text) else text


WORD = re.compile(r"(\S+)(\s*)")


def words_of(value: str) -> list[tuple[str, str]]:
    """Words with the signs that follow them, which have codes of their own; white space other than one blank is such a sign."""
    out = []
    for w, space in WORD.findall(value):
        bare = w.rstrip(",;|/.:)\"'")
        out.append((bare or w, (w[len(bare) :] if bare else "") + ("" if space in ("", " ") else space)))
    return out


def code_key(field: str, kind: str, text: str) -> int:
    """64 bits that stand for a value or word in counts; a collision changes the length of a code, never a value."""
    return xxhash.xxh3_64_intdigest(f"{field}\0{kind}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def keys_of(field: str, values: list[str]) -> Counter:
    """How often (kind, key) stands in values: values, their words and signs."""
    out: Counter = Counter()
    for v in values:
        out["whole", code_key(field, "whole", v)] += 1
        for k, (w, signs) in enumerate(words_of(v)):
            kind = "in" if k else "first"
            out[kind, code_key(field, kind, w)] += 1
            out["sign", code_key(field, "sign", signs)] += 1
    return out


class Codes:
    """Code lengths in bits of one text's values: their first words, the words inside them and, where they are listed, whole values. In an open
    field a whole value has no code of its own: a text delivered twice would make one value of all that it holds.

    counts: how often a key stands in all distinct texts; totals: the sums of the counts by kind; listed: keys of whole values that the field can have, None where
    any value can stand.
    """

    ESCAPE = 8.0

    def __init__(self, field: str, counts: dict[int, int], totals: dict[str, float], listed: set[int] | None = None) -> None:
        self.name, self.counts, self.totals, self.listed = field, counts, totals, listed

    def coded(self, kind: str, text: str, spelt: float) -> float:
        """The cost of a code if that pays, else of spelling it out."""
        n = self.counts.get(code_key(self.name, kind, text), 0)
        if n < 2:
            return spelt
        bits = -math.log2(n / max(self.totals.get(kind, 0), n))
        return bits if n * (spelt - bits) > spelt else spelt

    def word(self, kind: str, w: str, signs: str) -> float:
        return 1 + self.coded("sign", signs, self.ESCAPE + 2 * len(signs)) + self.coded(kind, w, self.ESCAPE + LETTER_BITS * len(w))

    def value(self, v: str) -> float:
        spelt = sum(self.word("in" if k else "first", w, signs) for k, (w, signs) in enumerate(words_of(v)))
        spelt += self.ESCAPE * (v[-1] in ";,|")  # a delimiter at the end of a value is one that the dialect should have
        if self.listed is not None:  # where a field's values are listed each has a code of its own, others are rare
            if code_key(self.name, "whole", v) not in self.listed:
                return 2 * self.ESCAPE + spelt
            share = max(self.totals.get("whole", 0) / 50, self.counts.get(code_key(self.name, "whole", v), 0), 1.0) / max(self.totals.get("whole", 0), 1.0)
            return min(spelt, 1 - math.log2(min(1.0, share)))
        return spelt

    def field(self, text: str, dialect: tuple[tuple[str, ...], bool]) -> float:
        values = values_of(text, dialect)
        if values is None:
            return math.inf
        delimiters, quoted = dialect
        return 3.0 * len(delimiters) + quoted + sum(self.value(v) + 1 + math.log2(len(delimiters) + 1) for v in values)


def first_guess(text: str) -> list[str]:
    """Before any code is known: the single delimiter, other than a blank where there is one, that makes most pieces."""
    options = [(d, p) for d in dialects(text) if len(d[0]) <= 1 and d[1] == ('"' in text and d[0] not in ((), ("[]",))) and (p := values_of(text, d)) is not None]
    hard = [x for x in options if x[0][0] and x[0][0][0] not in (" ", "  ", "/")] or options
    return max(hard, key=lambda x: (len(x[1]), x[0]))[1]


def best(text: str, codes: Codes) -> list[str]:
    options = dialects(text)
    if len(options) == 1:
        return values_of(text, options[0]) or []
    return values_of(text, min(options, key=lambda d: (codes.field(text, d), len(d[0]), d))) or []


def packed_values(rows: DataFrame, key: str, fields: list[str], lexicon: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, at_least: int = 2) -> DataFrame:
    """(key, field_name, pos, value_text): one row a value of every field that holds ``at_least`` values, pos from 1.

    lexicon: for a field, a one-column frame of the values it can have, of any size; each has a code of its own, others are rare. Null, blank and
    marker fields have no values; repeated rows give repeated results; an empty table gives an empty result; further columns are
    ignored. Long texts are parsed whole.
    """
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("text")) for f in fields]))
    long = rows.select(F.col(key).alias("_key"), named.alias("x")).select("_key", "x.f", "x.text").where(F.trim("text") != "")
    ident = [F.xxhash64("f", "text").alias("t1"), F.xxhash64(F.length("text"), "text", "f").alias("t2")]
    # a third of all rows may hold one text: every text is handled once
    texts = written(long.select("f", "text").distinct().select("f", "text", *ident))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, f, text in zip(pdf["t1"], pdf["f"], pdf["text"], strict=True):
                text = end_remark(text)
                options = dialects(text)
                if len(options) > 1 and text.strip().lower() not in BLANK:
                    all_: set = set()
                    for d in options:
                        all_ |= keys_of(f, values_of(text, d) or []).keys()
                    out += [(t, k) for _, k in all_]
            yield pd.DataFrame(out, columns=["t1", "k"])

    asked = written(spread(texts).mapInPandas(wanted, "t1 long, k long"))
    listed = None
    closed = set(lexicon or {})
    for f, frame in (lexicon or {}).items():
        named_values = frame.select(F.col(frame.columns[0]).cast("string").alias("v")).where("v IS NOT NULL")
        hashed = named_values.mapInPandas(lambda bs, f=f: (pd.DataFrame({"k": [code_key(f, "whole", v) for v in pdf["v"]]}, dtype="int64") for pdf in bs), "k long").distinct()
        listed = hashed if listed is None else listed.union(hashed)
    known = None if listed is None else written(asked.join(listed, "k", "left_semi").groupBy("t1").agg(F.collect_set("k").alias("listed")))  # bounded by one text

    def parse(counts: DataFrame | None, totals: dict[str, dict[str, float]], act, schema) -> DataFrame:
        """act on every text and its values, parsed with the codes of the counts, or by a first guess without any."""
        if counts is None:
            read = texts.withColumn("codes", F.lit(None).cast("array<struct<k:long,n:long>>")).withColumn("listed", F.lit(None).cast("array<long>"))
        else:
            own = asked.join(counts.where("n > 1"), "k").groupBy("t1").agg(F.collect_list(F.struct("k", "n")).alias("codes"))  # bounded by one text
            read = texts.join(own, "t1", "left")
            read = read.join(known, "t1", "left") if known is not None else read.withColumn("listed", F.lit(None).cast("array<long>"))

        guess = counts is None

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out: list = []
                for t1, t2, f, text, codes, some in zip(pdf["t1"], pdf["t2"], pdf["f"], pdf["text"], pdf["codes"], pdf["listed"], strict=True):
                    text = end_remark(text)
                    if text.strip().lower() in BLANK:
                        continue
                    if guess:
                        values = first_guess(text)
                    else:
                        have = {} if codes is None else {c["k"]: c["n"] for c in codes}
                        values = best(text, Codes(f, have, totals.get(f, {}), (set() if some is None else set(some)) if f in closed else None))
                    act(out, t1, t2, f, values)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        return spread(read.select("t1", "t2", "f", "text", "codes", "listed")).mapInPandas(each, schema)

    def count(out: list, t1: int, t2: int, f: str, values: list[str]) -> None:
        out += [(f, kind, k, n) for (kind, k), n in keys_of(f, values).items()]

    counts, totals = None, {}
    for _ in range(rounds):
        counts = written(parse(counts, totals, count, "f string, kind string, k long, n long").groupBy("f", "kind", "k").agg(F.sum("n").alias("n")))
        totals = {}
        for r in counts.groupBy("f", "kind").agg(F.sum("n").alias("n")).collect():  # four rows a field
            totals.setdefault(r.f, {})[r.kind] = float(r.n)

    def keep(out: list, t1: int, t2: int, f: str, values: list[str]) -> None:
        if len(values) >= at_least:
            out.append((t1, t2, f, values))

    parsed = parse(counts, totals, keep, "t1 long, t2 long, f string, values array<string>")
    kind = rows.schema[key].dataType.simpleString()
    out = long.select("_key", *ident).join(parsed, ["t1", "t2"]).select("_key", "f", F.posexplode("values").alias("p", "v"))
    return out.select(F.col("_key").cast(kind).alias(key), F.col("f").alias("field_name"), (F.col("p") + 1).cast("int").alias("pos"), F.col("v").alias("value_text"))
