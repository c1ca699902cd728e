"""Name similarity: a tuned Jaro-Winkler on words, as plain Python on memoised word pairs, called from Arrow batches.

Word pairs repeat far more often than names do, so each worker keeps the scores of the pairs it has seen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, ZERO, Similarity
from .normalize import accents
from .words import FIRST_LETTERS, PAIR_STOPWORDS, SOUND_CODES, WRITTEN_OUT

CODE = {c: d for d, letters in SOUND_CODES.items() for c in letters}
SWAPS = {frozenset(p) for p in FIRST_LETTERS}
_ACCENTS = str.maketrans(*accents())
_SPACES = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")


@lru_cache(maxsize=1 << 14)
def plain(text: str | None) -> str:
    """The same reading as normalize.plain."""
    if not text:
        return ""
    low = "".join(" " if c in ".,-" else c for c in text).lower()
    for a, b in WRITTEN_OUT.items():
        low = low.replace(a, b)
    out = []
    for c in low.translate(_ACCENTS):
        kind = unicodedata.category(c)
        if ord(c) > 0xFFFF or 0x300 <= ord(c) <= 0x36F:
            continue
        if kind[0] == "L" or kind == "Nd":
            out.append(c)
        elif kind[0] in "PS" or c in _SPACES or (kind[0] == "Z" and c not in "\xa0\u2007\u202f"):
            out.append(" ")
    return " ".join(x for x in "".join(out).split(" ") if x)


def jaro(a: str, b: str) -> float:
    """Share of matching letters with half of the misplaced ones deducted, not rounded."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken = [False] * m
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    k = len(mine)
    if not k:
        return 0.0
    theirs = [b[j] for j in range(m) if taken[j]]
    half = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2.0
    return (k / n + k / m + (k - half) / k) / 3.0


@lru_cache(maxsize=1 << 16)
def word_score(a: str, b: str, config: Similarity = DEFAULT) -> float:
    """Jaro with a boost for a common beginning and penalties for differing lengths and first letters."""
    s = jaro(a, b)
    common = 0
    for x, y in zip(a[: config.prefix], b[: config.prefix], strict=False):
        if x != y:
            break
        common += 1
    s += common * 0.1 * (1.0 - s)
    longest = max(len(a), len(b))
    ratio = min(len(a), len(b)) / longest if longest else 1.0
    if ratio < config.length_cutoff:
        s *= 1.0 - (1.0 - ratio) * config.length_penalty
    if a and b and a[0] != b[0]:
        s *= config.letter_penalty
    return s


def words_score(a: list[str], b: list[str], config: Similarity = DEFAULT) -> float:
    """Words of the shorter name are paired, in order, with the best free word of the longer one; the mean of the pairs counts
    0.6 and Jaro on the whole names 0.4. Without any pair the whole names count alone."""
    if not a or not b:
        return 0.0
    if len(a) == len(b) == 1:
        return word_score(a[0], b[0], config)
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    free = {j: w for j, w in enumerate(many) if w not in PAIR_STOPWORDS}
    got = []
    for w in few:
        if w in PAIR_STOPWORDS:
            continue
        top, at = 0.0, None
        for j, v in free.items():
            s = word_score(w, v, config)
            if s > top:
                top, at = s, j
        if at is not None:
            del free[at]
            got.append(top)
    whole = jaro(" ".join(a), " ".join(b))
    return 0.6 * (sum(got) / len(got)) + 0.4 * whole if got else whole


def merged_words(words: list[str]) -> list[list[str]]:
    """The words; with short ones joined to the next; and, where that changed anything, with short ones joined to the one before."""
    out = [list(words)]
    if len(words) < 2:
        return out
    ahead, k = [], 0
    while k < len(words):
        if k + 1 < len(words) and len(words[k]) <= 3:
            ahead.append(words[k] + words[k + 1])
            k += 2
        else:
            ahead.append(words[k])
            k += 1
    if len(ahead) == len(words):
        return out
    out.append(ahead)
    behind: list[str] = []
    for w in words:
        if behind and len(w) <= 3:
            behind[-1] += w
        else:
            behind.append(w)
    if len(behind) < len(words) and behind != ahead:
        out.append(behind)
    return out


def merged_score(a: list[str], b: list[str], config: Similarity = DEFAULT) -> float:
    return max(words_score(x, y, config) for x in merged_words(a) for y in merged_words(b))


@lru_cache(maxsize=1 << 14)
def sound_key(word: str) -> str:
    w = plain(word)
    if not w:
        return ""
    key, last = w[0].upper(), CODE.get(w[0], "0")
    for c in w[1:]:
        code = CODE.get(c, "0")
        if code != "0" and code != last:
            key += code
        last = code
        if len(key) == 4:
            break
    return key.ljust(4, "0")


def first_letters_fit(a: str, b: str) -> bool:
    x, y = plain(a)[:1], plain(b)[:1]
    return not x or not y or x == y or frozenset((x, y)) in SWAPS or (x.isdigit() and y.isdigit())


def text_score(a: str | None, b: str | None, config: Similarity = DEFAULT) -> float:
    """Similarity of two texts: first letters that can't sound alike score nothing, short words may be merged."""
    x, y = plain(a), plain(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if config.phonetic_filter and not first_letters_fit(x, y):
        return 0.0
    return min(1.0, max(0.0, merged_score(x.split(), y.split(), config)))


def read_name_score(a: str, b: str, config: Similarity = DEFAULT) -> float:
    """Similarity of two normalised names: 1 if they have as many words and the same set of sounds."""
    x, y = a.split(), b.split()
    if len(x) == len(y) and {sound_key(w) for w in x} == {sound_key(w) for w in y}:
        return 1.0
    return words_score(x, y, config)


def name_score(a: str | None, b: str | None, config: Similarity = DEFAULT) -> float:
    """As read_name_score, of names as they are written; null and empty names score nothing."""
    return read_name_score(plain(a), plain(b), config) if a and b else 0.0


def prepared_score(query: str | None, names: list[str] | None, config: Similarity = DEFAULT) -> float:
    """The best of a query against names that are normalised already; only the query is read here."""
    q = plain(query)
    return max((read_name_score(q, n, config) for n in names or [] if n), default=0.0) if q else 0.0


def favoured_score(indexed: str | None, query: str | None, favour: float = 0.05, config: Similarity = ZERO) -> float:
    """Mean of each indexed word's best match among the query's words nearby, perfect matches favoured; at most 1."""
    own, asked = (indexed or "").split(), (query or "").split()
    if not own or not asked:
        return 0.0
    n, m = len(own), len(asked)
    got = []
    for i, w in enumerate(own):
        top, term = 0.0, ""
        for q in asked[max(0, i - 3) : i + 3]:
            s = text_score(w, q, config)
            if s > top:
                top, term = s, q
        if top >= 1.0:
            if m > n and max(n, m) > 3:
                top *= n / m
            elif n == 1 and m > 1:
                top *= 0.9
            else:
                top += favour
        elif m > n:
            top *= n / m
        else:
            room = len(term) - 1.0
            top *= min(abs(len(w) / (room if room > 0 else 1.0)), 1.0)
        got.append(top)
    got.sort()
    if n > m > 5:
        got = got[-m:]
    return min(1.0, sum(got) / len(got))


def pair_column(f: Callable[..., float], config: Similarity = DEFAULT) -> Callable:
    """An Arrow column function of two string columns; equal pairs of a batch are scored once."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for p in zip(a, b, strict=True):
            if p not in known:
                known[p] = f(*p, config)
            out.append(known[p])
        return pd.Series(out, dtype="float64")

    return score


jaro_column = pair_column(lambda a, b, _: jaro(a, b) if a is not None and b is not None else 0.0)
name_score_column = pair_column(name_score)
text_score_column = pair_column(text_score)
words_score_zero = pair_column(lambda a, b, c: words_score((a or "").split(), (b or "").split(), c), ZERO)
favoured_column = pair_column(lambda a, b, c: favoured_score(a, b, 0.05, c), ZERO)


@F.pandas_udf(T.StringType())
def merged_words_column(names: pd.Series) -> pd.Series:
    """All word forms of a normalised name, one after the other, with bars between."""
    return names.map(lambda n: "|".join(" ".join(ws) for ws in merged_words((n or "").split())))


def register(spark) -> None:
    """The scorers as SQL functions."""
    for name, f in {"jaro": jaro_column, "name_score": name_score_column, "text_score": text_score_column, "favoured_score": favoured_column}.items():
        spark.udf.register(name, f)
