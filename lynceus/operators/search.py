"""Screening of names against an index: a fuzzy join with a threshold and the best k of each name.

The names asked are a stated set. Both sides are spread over a grid: asked names in blocks, index names in parts, one task a cell. It is one
job whatever the number of names; nothing comes to the driver and nothing is broadcast. Pairs of a cell are cut before they are scored by bounds
that lose nothing:

* names with as many words and the same set of sounds score 1, whatever else;
* else 0.6 T + 0.4 F, or F alone, must reach the threshold. T is a mean of word scores, so at most the largest of any word of one name with any of
  the other. So whole names are alike, or words are near enough for names that aren't, or no two words score at all: the different words of both sides are
  compared first, and names meet by near words. Jaro is at most (c / n + c / m + 1) / 3 with c common letters, which cuts words and whole names
  before Jaro is taken of many pairs at once;
* T and F of what is left are computed of many pairs at once too, so that the scorer only sees pairs that reach the threshold (but for rounding).

The bounds hold for settings whose boosts and penalties are within [0, 1]; for others every pair is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BATCH_LEAST_MATCH, BATCH_LIMIT, BATCH_MOST, DEFAULT, BadRequest, Similarity
from ..functions import similarity as S
from ..functions.normalize import plain
from ..functions.words import PAIR_STOPWORDS
from ..session import width, written

BLOCK_NAMES = 32_768
PART_NAMES = 16_384
CHUNK_NAMES = 16_384
CELL_ROWS, CELL_COLS = 64, 2048
#: Names are alike from this share of the way between the threshold and 1: the more, the fewer names and the more words are compared.
ALIKE = 0.25
PAIRS_AT_ONCE = 1 << 18
JARO_PAIRS = 8192
#: Longer texts are compared one by one, and so are those with letters beyond the most frequent.
LONG_TEXT, ALPHABET = 64, 256
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def source_filter(c: Column) -> Column:
    """A source as single searches name it; unknown names filter nothing."""
    up = F.upper(F.trim(c))
    return F.when(up.isin("OFAC", "US_OFAC"), "US_OFAC").when(up.isin("CSL", "US_CSL"), "US_CSL").when(up.isin("EU_CSL", "UK_CSL"), up)


def type_filter(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("person", "individual"), "PERSON").when(low.isin("business", "entity"), "BUSINESS").when(low.isin("organization", "vessel", "aircraft"), F.upper(low))


def strict(c: Column, values: list[str]) -> Column:
    """A value of the list in any case, else null."""
    return F.when(F.upper(c).isin(values), F.upper(c))


def clamped(limit: int, min_match: float) -> tuple[int, float]:
    """Bounds of single searches."""
    return min(100, max(1, limit)), min(1.0, max(0.0, min_match))


def prunable(c: Similarity) -> bool:
    return 0 <= c.prefix <= 4 and 0 <= c.length_penalty <= 1 and 0 <= c.letter_penalty <= 1 and c.length_cutoff >= 0


def letters_in_row(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, letter) of all letters of some texts."""
    size = np.array([len(x) for x in texts], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)


COLUMN = np.array([LETTERS.find(chr(c)) % (len(LETTERS) + 1) for c in range(129)])


def letter_counts(names: list[str]) -> np.ndarray:
    """Counts of letters of each name; other signs share one column, which can only raise a bound."""
    row, _, letter = letters_in_row(names)
    wide = len(LETTERS) + 1
    return np.bincount(row * wide + COLUMN[np.minimum(letter, 128)], minlength=len(names) * wide).reshape(len(names), wide)


class Signs:
    """Letters of texts as bits: each letter's first, second and third time have one each, what goes beyond is counted."""

    def __init__(self, texts: list[str]) -> None:
        self._last: tuple[Signs, np.ndarray] | None = None
        n = letter_counts(texts)
        bits = np.zeros((len(texts), 128), dtype=bool)
        for k in range(3):
            bits[:, k * n.shape[1] : (k + 1) * n.shape[1]] = n > k
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        self.more = np.maximum(n - 3, 0).sum(axis=1, dtype=np.int32)
        self.texts = texts
        self.size = np.array([len(x) for x in texts], dtype=np.int64)
        self.length = np.maximum(self.size, 1).astype(np.float32)

    @cached_property
    def codes(self) -> np.ndarray:
        out = np.zeros((len(self.texts), max(1, int(self.size[self.size <= LONG_TEXT].max(initial=0)))), dtype=np.int32)
        row, place, letter = letters_in_row(self.texts)
        short = self.size[row] <= LONG_TEXT
        out[row[short], place[short]] = letter[short] + 1
        return out

    @cached_property
    def alphabet(self) -> np.ndarray:
        """The most frequent letters, at most ``ALPHABET``, in order; nought, which stands behind a text's end, first."""
        found, n = np.unique(self.codes, return_counts=True)
        return np.union1d([0], found[np.argsort(-n, kind="stable")[:ALPHABET]])

    def read_in(self, alphabet: np.ndarray) -> np.ndarray:
        """The letters as places in an alphabet, nought for those that aren't in it."""
        at = np.minimum(np.searchsorted(alphabet, self.codes), len(alphabet) - 1)
        return np.where(alphabet[at] == self.codes, at, 0)

    @cached_property
    def masks(self) -> np.ndarray:
        """Where a text has each letter of the alphabet, as bits."""
        out = np.zeros((len(self.texts), len(self.alphabet)), dtype=np.uint64)
        rows, own = np.arange(len(self.texts)), self.read_in(self.alphabet)
        for i in range(own.shape[1]):
            out[rows, own[:, i]] |= np.uint64(1 << i)
        out[:, 0] = 0
        return out

    @cached_property
    def alone(self) -> np.ndarray:
        """Texts that are too long, or have letters beyond the alphabet."""
        return (self.size > LONG_TEXT) | ((self.codes > 0) & (self.read_in(self.alphabet) == 0)).any(axis=1)

    def letters_of(self, other: Signs) -> np.ndarray:
        """The letters as places in the other's alphabet, kept for the last other."""
        if self._last is None or self._last[0] is not other:
            self._last = other, self.read_in(other.alphabet)
        return self._last[1]

    def common(self, other: Signs, a: np.ndarray | slice, b: np.ndarray | None = None) -> np.ndarray:
        """Letters that texts have in common at most: of rows a with rows b of the other, or with all of its rows."""
        at = lambda x: x[a] if b is not None else x[a][:, None]
        its = (lambda x: x[b]) if b is not None else (lambda x: x)
        out = (np.bitwise_count(at(self.bits[:, 0]) & its(other.bits[:, 0])) + np.bitwise_count(at(self.bits[:, 1]) & its(other.bits[:, 1]))).astype(np.float32)
        if self.more.any() and other.more.any():
            out += np.minimum(at(self.more), its(other.more))
        return out


class Words:
    """The different words of some names, with what bounds of their scores need."""

    def __init__(self, names: list[str]) -> None:
        at: dict[str, int] = {}
        split = [[at.setdefault(w, len(at)) for w in n.split()] for n in names]
        #: the words of name r are ids[start[r] : start[r] + count[r]]
        self.count = np.array([len(x) for x in split], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.ids = np.array([w for x in split for w in x], dtype=np.int64)
        self.words = list(at)
        self.signs = Signs(self.words)
        self.start = np.array([[ord(c) for c in w[:4].ljust(4, "\0")] for w in self.words], dtype=np.int32).reshape(len(self.words), 4)
        self.stop = np.array([w in PAIR_STOPWORDS for w in self.words], dtype=bool)
        #: the names of word w are names[heads[w] : heads[w + 1]]
        pair = np.unique(self.ids * max(1, len(names)) + np.repeat(np.arange(len(names)), self.count))
        word, self.names = np.divmod(pair, max(1, len(names)))
        self.heads = np.searchsorted(word, np.arange(len(self.words) + 1))

    def places(self, most: int) -> np.ndarray:
        """Of each name, which letters its words that are no stopwords have at their first ``most`` places, at most four, as bits."""
        at = {c: k for k, c in enumerate(LETTERS)}
        bits = np.zeros((len(self.words), 192), dtype=bool)
        for i, w in enumerate(self.words):
            if not self.stop[i]:
                for k, c in enumerate(w[:most]):
                    if c in at:
                        bits[i, k * len(LETTERS) + at[c]] = True
        word = np.packbits(bits, axis=1).view(np.uint64)
        out = np.zeros((len(self.count), 3), dtype=np.uint64)
        np.bitwise_or.at(out, np.repeat(np.arange(len(self.count)), self.count), word[self.ids])
        return out


def jaros(a: Signs, b: Signs, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """similarity.jaro of texts x of one side with texts y of the other, many pairs at once: what is taken of a text is one bit a letter."""
    n, m = a.size[x], b.size[y]
    out = ((n == 0) & (m == 0)).astype(float)
    some = (n > 0) & (m > 0)
    slow = (n > LONG_TEXT) | b.alone[y]
    for k in np.nonzero(some & slow)[0]:
        out[k] = S.jaro(a.texts[x[k]], b.texts[y[k]])
    order = np.nonzero(some & ~slow)[0]
    order = order[np.argsort(n[order], kind="stable")]  # texts of like length together
    letters, masks, wide = a.letters_of(b), b.masks.ravel(), b.masks.shape[1]
    one = np.uint64(1)
    for lo in range(0, len(order), JARO_PAIRS):
        k = order[lo : lo + JARO_PAIRS]
        p, q = n[k], m[k]
        reach = np.maximum(np.maximum(p, q) // 2 - 1, 0)
        near = (one << (reach + 1).astype(np.uint64)) - one
        left, row = np.ascontiguousarray(letters[x[k], : p.max()].T), y[k] * wide
        taken, where, got = np.zeros(len(k), dtype=np.uint64), [], []
        for i in range(len(left)):
            at = masks[row + left[i]]
            hit = at & near & ~taken
            hit &= -hit
            taken |= hit
            where.append(at)
            got.append(hit != 0)
            near = (near << one) | (reach > i)
        c = np.bitwise_count(taken).astype(np.int64)
        half = np.zeros(len(k))
        for at, mine in zip(where, got, strict=True):
            bit = taken & -taken & np.where(mine, ~np.uint64(0), np.uint64(0))
            half += mine & ((at & bit) == 0)
            taken ^= bit
        out[k] = np.where(c > 0, (c / p + c / q + (c - half / 2.0) / np.maximum(c, 1)) / 3.0, 0.0)
    return out


def word_scores(a: Words, b: Words, i: np.ndarray, j: np.ndarray, config: Similarity, least: float = 0.0) -> np.ndarray:
    """similarity.word_score of words i of one side with words j of the other, many at once; nought where letters in common show that it is below ``least``."""
    shared = np.zeros(len(i))
    if config.prefix:
        same = (a.start[i] == b.start[j]) & (b.start[j] > 0)
        shared = np.logical_and.accumulate(same[:, : config.prefix], axis=1).sum(axis=1) * 0.1
    x, y = a.signs.size[i], b.signs.size[j]
    ratio = np.minimum(x, y) / np.maximum(x, y)
    factor = np.where(ratio < config.length_cutoff, 1.0 - (1.0 - ratio) * config.length_penalty, 1.0) * np.where(a.start[i, 0] == b.start[j, 0], 1.0, config.letter_penalty)
    out, some = np.zeros(len(i)), slice(None)
    if least > 0:
        top = (a.signs.common(b.signs, i, j) * (1 / x + 1 / y) + 1) / 3
        some = np.nonzero((top + shared * (1.0 - top)) * factor >= least - 1e-4)[0]
        i, j, shared, factor = i[some], j[some], shared[some], factor[some]
    s = jaros(a.signs, b.signs, i, j)
    out[some] = (s + shared * (1.0 - s)) * factor
    return out


def letters_needed(n: np.ndarray, m: np.ndarray, jaro: np.ndarray | float) -> np.ndarray:
    """Common letters that texts of n and of m letters need at least for that Jaro; 255 if none are enough."""
    jaro = np.asarray(jaro, dtype=float)
    c = np.maximum(1, np.ceil((3 * jaro - 1) / (1 / n + 1 / m) - 1e-4))
    return np.where(c > np.minimum(n, m), 255, np.minimum(c, 254)).astype(np.uint8)


def enough_letters(a: Signs, b: Signs, need: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one side and of the other that have as many letters in common as their lengths need."""
    rows, cols = rows[np.argsort(a.size[rows], kind="stable")], cols[np.argsort(b.size[cols], kind="stable")]
    n, m = a.size[rows], b.size[cols]
    lengths, at = np.unique(m, return_inverse=True)
    more = bool(a.more[rows].any() and b.more[cols].any())
    left, right = np.ascontiguousarray(a.bits[rows].T), np.ascontiguousarray(b.bits[cols].T)
    for size in np.unique(n):
        few = need(np.full(len(lengths), size), lengths)
        fit = np.nonzero(few < 255)[0]
        if not len(fit):
            continue
        begin, end = np.searchsorted(m, [lengths[fit[0]], lengths[fit[-1]] + 1])
        least = few[at]
        r0, r1 = np.searchsorted(n, [size, size + 1])
        for q in range(begin, end, CELL_COLS):
            c = slice(q, min(end, q + CELL_COLS))
            for p in range(r0, r1, CELL_ROWS):
                r = slice(p, min(r1, p + CELL_ROWS))
                got = np.bitwise_count(left[0, r, None] & right[0, c])
                got += np.bitwise_count(left[1, r, None] & right[1, c])
                if more:
                    got = np.minimum(got + np.minimum(a.more[rows[r], None], b.more[cols[c]]), 254)
                k = np.flatnonzero(got >= least[c])
                if len(k):
                    x, y = np.divmod(k, c.stop - c.start)
                    yield rows[p + x], cols[q + y]


def near_words(a: Words, b: Words, config: Similarity, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score): the words i of one side and j of the other whose score reaches ``least``."""

    def need(boost: float, penalty: float) -> Callable:
        def letters(n: np.ndarray, m: np.ndarray) -> np.ndarray:
            ratio = np.minimum(n, m) / np.maximum(n, m)
            factor = penalty * np.where(ratio < config.length_cutoff, 1.0 - (1.0 - ratio) * config.length_penalty, 1.0)
            return letters_needed(n, m, np.where(factor > 0, ((least - 1e-4) / np.maximum(factor, 1e-9) - boost) / (1 - boost), 9.0))

        return letters

    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]

    def take(i: np.ndarray, j: np.ndarray) -> None:
        s = word_scores(a, b, i, j, config, least)
        ok = s >= least - 1e-5
        out.append((i[ok], j[ok], s[ok]))

    for c in np.intersect1d(a.start[:, 0], b.start[:, 0]):
        for i, j in enough_letters(a.signs, b.signs, need(0.1 * config.prefix, 1.0), np.nonzero(a.start[:, 0] == c)[0], np.nonzero(b.start[:, 0] == c)[0]):
            take(i, j)
    for i, j in enough_letters(a.signs, b.signs, need(0.0, config.letter_penalty), np.arange(len(a.words)), np.arange(len(b.words))):
        other = a.start[i, 0] != b.start[j, 0]
        take(i[other], j[other])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Block:
    """Names asked, read once for all the index."""

    def __init__(self, rows: list[tuple], config: Similarity, min_match: float) -> None:
        self.rows, self.config, self.least = rows, config, min_match
        self.names = [r[1] for r in rows]

    @cached_property
    def words(self) -> Words:
        return Words(self.names)

    @cached_property
    def signs(self) -> Signs:
        return Signs(self.names)

    @cached_property
    def sounds(self) -> dict[tuple, list[int]]:
        out: dict[tuple, list[int]] = {}
        for k, n in enumerate(self.names):
            out.setdefault(self.sound(n), []).append(k)
        return out

    @staticmethod
    def sound(name: str) -> tuple:
        w = name.split()
        return len(w), frozenset(S.sound_key(x) for x in w)

    def pairs(self, names: list[str]) -> Iterator[tuple[int, int]]:
        """(asked, indexed) positions that can reach the threshold."""
        if not prunable(self.config) or self.least <= 0.6:
            yield from ((a, b) for b in range(len(names)) for a in range(len(self.names)))
            return
        for lo in range(0, len(names), CHUNK_NAMES):
            some = names[lo : lo + CHUNK_NAMES]
            words, signs = Words(some), Signs(some)
            kept = {x * len(some) + y for y, n in enumerate(some) for x in self.sounds.get(self.sound(n), ())}
            for a, b, f in self.near_names(words, signs):
                kept.update((a * len(some) + b)[self.words_reach(words, a, b, f)].tolist())
            yield from ((k // len(some), lo + k % len(some)) for k in sorted(kept))

    def near_names(self, words: Words, signs: Signs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(asked, indexed, Jaro of the names): pairs that have near words, are alike or have words that may score nothing, and whose letters are enough."""
        alike = self.least + (1 - self.least) * ALIKE  # Jaro of whole names from which no near word is asked for
        i, j, s = near_words(self.words, words, self.config, (self.least - 0.4 * alike) / 0.6)
        wide = np.diff(words.heads)[j]
        ends = np.cumsum(np.diff(self.words.heads)[i] * wide)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
            t = np.arange(lo, min(int(ends[-1]), lo + PAIRS_AT_ONCE))
            k = np.searchsorted(ends, t, side="right")
            p, q = np.divmod(t - np.where(k > 0, ends[k - 1], 0), wide[k])
            a, b = self.words.names[self.words.heads[i[k]] + p], words.names[words.heads[j[k]] + q]
            single = (self.words.count[a] == 1) & (words.count[b] == 1)
            whole = (self.signs.common(signs, a, b) * (1 / self.signs.length[a] + 1 / signs.length[b]) + 1) / 3
            keep = (0.6 * s[k] + 0.4 * whole >= self.least - 1e-4) | single
            a, b, top, single = a[keep], b[keep], s[k[keep]], single[keep]
            f = jaros(self.signs, signs, a, b)
            keep = (0.6 * top + 0.4 * f >= self.least - 1e-5) | single
            yield a[keep], b[keep], f[keep]
        # names that are less alike and have no near words can only reach the threshold if no two words score at all, by the whole names alone
        most = 4 if self.config.letter_penalty > 0 else 1  # without it, only words of one first letter score
        mine, its = self.words.places(most), words.places(most)
        for a, b in enough_letters(self.signs, signs, lambda n, m: letters_needed(n, m, self.least - 1e-4), np.arange(len(self.names)), np.arange(len(words.count))):
            whole = (self.signs.common(signs, a, b) * (1 / self.signs.length[a] + 1 / signs.length[b]) + 1) / 3
            keep = whole >= alike - 1e-4
            rest = np.nonzero(~keep)[0]
            keep[rest] = ~(mine[a[rest]] & its[b[rest]]).any(axis=1)
            a, b = a[keep], b[keep]
            f = jaros(self.signs, signs, a, b)
            keep = f >= self.least - 1e-5
            yield a[keep], b[keep], f[keep]

    def words_reach(self, words: Words, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """similarity.words_score of many pairs of names, Jaro of whole names given: whether it reaches the threshold."""
        out = np.zeros(len(a), dtype=bool)
        shape = self.words.count[a] * (1 << 20) + words.count[b]
        for kind in np.unique(shape):
            k, m = divmod(int(kind), 1 << 20)
            rows = np.nonzero(shape == kind)[0]
            step = max(1, PAIRS_AT_ONCE // (k * m))
            for lo in range(0, len(rows), step):
                r = rows[lo : lo + step]
                left, right = self.words.ids[self.words.first[a[r], None] + np.arange(k)], words.ids[words.first[b[r], None] + np.arange(m)]
                pair, at = np.unique(left[:, :, None] * len(words.words) + right[:, None, :], return_inverse=True)
                i, j = np.divmod(pair, len(words.words))
                s = word_scores(self.words, words, i, j, self.config)
                if k == m == 1:
                    out[r] = s[at.ravel()] >= self.least - 1e-6
                    continue
                s[self.words.stop[i] | words.stop[j]] = 0.0
                s = s[at.reshape(len(r), k, m)]
                if k > m:
                    s = s.transpose(0, 2, 1)
                free, total, n, here = np.ones((len(r), s.shape[2])), np.zeros(len(r)), np.zeros(len(r)), np.arange(len(r))
                for w in range(s.shape[1]):
                    row = s[:, w] * free
                    j = row.argmax(axis=1)
                    top = row[here, j]
                    free[here[top > 0], j[top > 0]] = 0.0
                    total, n = total + np.maximum(top, 0.0), n + (top > 0)
                out[r] = np.where(n > 0, 0.6 * total / np.maximum(n, 1) + 0.4 * whole[r], whole[r]) >= self.least - 1e-6
        return out


def first_entities(rows: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
    """The first ``most`` entities of (less score, position), each once, in order."""
    seen: dict[int, float] = {}
    for s, pos in sorted(rows):
        if pos not in seen:
            seen[pos] = s
            if len(seen) == most:
                break
    return [(s, pos) for pos, s in seen.items()]


def first_best(cell: Block, names: list[str], own_rows: list[list[tuple]], min_match: float, scorer: Callable, most: int, failed: dict[int, str]) -> tuple[dict[int, list[tuple[float, int]]], int]:
    """The best ``most`` entities of each asked name by a scorer with ``ready`` and ``top``, and the pairs that were scored: entities are tried in order of the
    index, and once ``most`` of them have the greatest score there is, no later one is before them. What fails all the same is added to ``failed``."""
    held: dict[tuple, list[tuple[int, int]]] = {}
    best: dict[int, list[tuple[float, int]]] = {}
    scored = 0
    for a, (_, text, fs, ft) in enumerate(cell.rows):
        if a in failed:
            continue
        if (fs, ft) not in held:
            held[fs, ft] = sorted((pos, b) for b, rows in enumerate(own_rows) for pos, source, kind in rows if (fs is None or fs == source) and (ft is None or ft == kind))
        rows, full, known = [], set(), {}
        for pos, b in held[fs, ft]:
            if b not in known:
                scored += 1
                try:
                    known[b] = scorer(text, names[b], cell.config)
                except Exception as e:  # noqa: BLE001
                    failed[a] = str(e) or type(e).__name__
                    break
            if known[b] >= min_match:
                rows.append((-known[b], pos))
                if known[b] >= scorer.top:
                    full.add(pos)
                    if len(full) >= most:
                        break
        if a not in failed:
            best[a] = first_entities(rows, most)
    return best, scored


def name_scores(asked: DataFrame, index_names: DataFrame, min_match: float, config: Similarity = DEFAULT, block_names: int = BLOCK_NAMES, scorer: Callable = S.read_name_score, tally=None, most: int | None = None) -> DataFrame:
    """(q, index_pos, score, error): the best score of each asked name against each entity, from ``min_match`` on.

    asked: (q, text, source_f, type_f), distinct, normalised, filters null for all; index_names: (index_pos, source, entity_type, text), one row a
    name. Empty texts score nothing. A name whose scoring fails has one row with the message and no score. tally: an accumulator of the
    pairs that are scored. most: as many entities of each name and cell are kept, which holds those of the best ``most`` of all cells, ties in order of the index.
    scorer: may have ``ready(name, config)``, which raises for the asked names that can't be scored, and ``top``, the greatest score there is. One that has both
    fails for no other name, so with ``most`` not all pairs need be scored; any other scorer sees all pairs that the threshold leaves.
    """
    spark = asked.sparkSession
    asked = written(asked.where("text <> ''"))
    held = index_names.where("text <> ''").select("index_pos", "source", "entity_type", "text")
    n, m, cells = asked.count(), held.count(), 2 * width(spark)
    blocks, parts = max(1, -(-n // block_names)), max(1, -(-m // PART_NAMES))
    if blocks * parts < cells:  # of as many cells, those that read both sides the fewest times
        blocks = min(max(n, 1), max(blocks, round((cells * n / max(m, 1)) ** 0.5)))
        parts = max(parts, -(-cells // blocks))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")  # equal names together, so that they are scored once
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("q", "text", "source_f", "type_f", block.alias("block"), every(parts).alias("part"))
    right = held.select("*", part.alias("part"), every(blocks).alias("block"))

    def score(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        got: list[tuple] = []
        if len(ask) and len(own):
            cell = Block(list(ask[["q", "text", "source_f", "type_f"]].itertuples(index=False, name=None)), config, min_match)
            unique = {x: i for i, x in enumerate(dict.fromkeys(own["text"]))}
            names = list(unique)
            hits: dict[int, list[tuple[int, float]]] = {}
            failed: dict[int, str] = {}
            own_rows: list[list[tuple]] = [[] for _ in names]
            for pos, source, kind, text in zip(own["index_pos"], own["source"], own["entity_type"], own["text"], strict=True):
                own_rows[unique[text]].append((pos, source, kind))
            best: dict[int, list[tuple[float, int]]] = {}
            floor: dict[int, tuple[float, int]] = {}
            scored = 0
            ready, top = getattr(scorer, "ready", None), getattr(scorer, "top", None)
            for a, n in enumerate(cell.names if ready else []):
                try:
                    ready(n, config)
                except Exception as e:  # noqa: BLE001
                    failed[a] = str(e) or type(e).__name__
            ends = most is not None and ready is not None and top is not None
            if ends:
                best, scored = first_best(cell, names, own_rows, min_match, scorer, most, failed)
            for a, b in () if ends else cell.pairs(names):
                if most is not None and a in failed:
                    continue  # its row is the message, whatever else scores
                scored += 1
                try:
                    s = scorer(cell.names[a], names[b], config)
                except Exception as e:  # noqa: BLE001
                    failed.setdefault(a, str(e) or type(e).__name__)
                    continue
                if not s >= min_match:
                    continue
                if most is None:
                    hits.setdefault(b, []).append((a, s))
                    continue
                _, _, fs, ft = cell.rows[a]
                for pos, source, kind in own_rows[b]:
                    if (fs is None or fs == source) and (ft is None or ft == kind) and (a not in floor or (-s, pos) < floor[a]):
                        rows = best.setdefault(a, [])
                        rows.append((-s, pos))
                        if len(rows) >= 4 * most + 64:
                            best[a] = rows = first_entities(rows, most)
                            if len(rows) == most:
                                floor[a] = rows[-1]
            if tally is not None:
                tally.add(scored)
            for b, own_hits in hits.items():
                for pos, source, kind in own_rows[b]:
                    for a, s in own_hits:
                        q, _, fs, ft = cell.rows[a]
                        if (fs is None or fs == source) and (ft is None or ft == kind):
                            got.append((q, pos, s, None))
            got += [(cell.rows[a][0], pos, -s, None) for a, rows in best.items() if a not in failed for s, pos in first_entities(rows, most)]
            got += [(cell.rows[a][0], None, None, e) for a, e in failed.items()]
        return pd.DataFrame(got, columns=["q", "index_pos", "score", "error"]).astype({"index_pos": "Int64"})

    grid = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(score, "q long, index_pos long, score double, error string")
    return grid.groupBy("q", "index_pos").agg(F.max("score").alias("score"), F.min("error").alias("error"))


def index_names(index: DataFrame, mode: str = "raw") -> DataFrame:
    """(index_pos, source, entity_type, text): names as a search compares them. raw: as they are written, only normalised; prepared: the prepared fields."""
    if mode == "raw":
        all_ = F.transform(F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>"))), plain)
    elif mode == "prepared":
        all_ = F.concat(F.array(F.col("prepared.name")), F.col("prepared.alt_names"))
    else:
        raise BadRequest(f"no such mode: {mode}")
    return index.select("index_pos", "source", "entity_type", F.explode(F.array_distinct(all_)).alias("text")).where("text IS NOT NULL AND text <> ''")


def screened(requests: DataFrame, index: DataFrame, min_match: float, limit: int, mode: str, config: Similarity, scorer: Callable = S.read_name_score) -> tuple[DataFrame, DataFrame]:
    """(item_pos, rank, index_pos, score) of ``screen``, and (item_pos, error) of the requests whose scoring failed."""
    read = written(requests.select("item_pos", plain(F.col("name")).alias("text"), F.col("source_f"), F.col("type_f")).withColumn("q", F.xxhash64("text", F.coalesce("source_f", F.lit("")), F.coalesce("type_f", F.lit("")))))
    asked = read.select("q", "text", "source_f", "type_f").distinct()
    scores = written(name_scores(asked, index_names(index, mode), min_match, config, scorer=scorer, most=max(limit, 1)))
    failed = scores.where("error IS NOT NULL").groupBy("q").agg(F.min("error").alias("error"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "index_pos")
    top = scores.where("error IS NULL").where(~F.isnan("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    top = top.join(failed, "q", "left_anti")
    return read.select("item_pos", "q").join(top, "q").select("item_pos", "rank", "index_pos", "score"), read.select("item_pos", "q").join(failed, "q").select("item_pos", "error")


def screen(requests: DataFrame, index: DataFrame, min_match: float = BATCH_LEAST_MATCH, limit: int = BATCH_LIMIT, mode: str = "raw", config: Similarity = DEFAULT) -> DataFrame:
    """(item_pos, rank, index_pos, score): the best ``limit`` entities of each request, ties in order of the index.

    requests: (item_pos, name, source_f, type_f). Null and blank names have no rows; a name asked by many requests is scored once and
    joined back to them. Scores that aren't numbers reach no threshold.
    """
    return screened(requests, index, min_match, limit, mode, config)[0]


def name_search(index: DataFrame, name: str, min_match: float, limit: int = 10, source: str | None = None, entity_type: str | None = None, mode: str = "raw", config: Similarity = DEFAULT) -> DataFrame:
    """The entities nearest to one name, best first."""
    if not name or not name.strip():
        raise BadRequest("a name is required")
    limit, min_match = clamped(limit, min_match)
    one = index.sparkSession.createDataFrame([(0, name, source, entity_type)], "item_pos long, name string, source string, entity_type string")
    one = one.select("item_pos", "name", source_filter(F.col("source")).alias("source_f"), type_filter(F.col("entity_type")).alias("type_f"))
    return screen(one, index, min_match, limit, mode, config).drop("item_pos").join(index, "index_pos").orderBy("rank")


def guarded(requests: DataFrame, most: int | None) -> None:
    """The guard of size of interactive batches; None, for bulk, has none."""
    if most is not None:
        n = requests.limit(most + 1).count()
        if not 1 <= n <= most:
            raise BadRequest(f"a batch has 1 to {most} items")


def filters(requests: DataFrame) -> DataFrame:
    """(item_pos, name, source_f, type_f) of a batch; filters that are no value of their list filter nothing."""
    from ..functions import words as W

    return requests.select("item_pos", "name", strict(F.col("source"), W.SOURCES).alias("source_f"), strict(F.col("entity_type"), W.ENTITY_TYPES).alias("type_f"))


def answered(requests: DataFrame, top: DataFrame, failed: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of a batch: top (item_pos, rank, index_pos, score[, breakdown]) joined to what is shown of the entities."""
    more = ["breakdown"] if "breakdown" in top.columns else []
    hit = top.join(index.select("index_pos", "id", "name", "entity_type", "source", "remarks"), "index_pos")  # only the winners meet the wide entity
    match = F.struct("rank", F.col("id").alias("entity_id"), "name", "entity_type", "source", "score", "remarks", *more)
    lists = hit.groupBy("item_pos").agg(F.array_sort(F.collect_list(match)).alias("matches"))  # at most ``limit`` a request
    out = requests.join(lists, "item_pos", "left").join(failed, "item_pos", "left")
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.size(F.coalesce("matches", F.array())) > 0, "SUCCESS").otherwise("NO_MATCHES")
    return out.select("item_pos", "request_id", requests["name"], status.alias("status"), "matches", "error")


def batch(
    requests: DataFrame, index: DataFrame, min_match: float = BATCH_LEAST_MATCH, limit: int = BATCH_LIMIT, most: int | None = BATCH_MOST, mode: str = "raw", config: Similarity = DEFAULT, scorer: Callable = S.read_name_score
) -> DataFrame:
    """One row a request, in order: item_pos, request_id, name, status, matches (rank, entity_id, name, entity_type, source, score, remarks), error.

    requests: (item_pos, request_id, name, entity_type, source). A request without matches, a null or a blank name has status
    NO_MATCHES; one whose scoring fails has status ERROR and the message, and the others go on.
    """
    guarded(requests, most)
    top, failed = screened(filters(requests), index, min_match, limit, mode, config, scorer)
    return answered(requests, top, failed, index)


def statistics(results: DataFrame) -> DataFrame:
    """Totals of a batch; results: (status, scores array)."""
    n = F.size(F.coalesce("scores", F.array().cast("array<double>")))
    score = F.explode_outer("scores").alias("score")
    per = results.agg(F.count("*").alias("total_items"), F.sum(n).alias("total_matches"), F.count_if(n > 0).alias("items_with_matches"), F.count_if(F.col("status") == "NO_MATCHES").alias("items_without_matches"), F.count_if(F.col("status") == "ERROR").alias("items_with_errors"))
    s = results.select(score).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"), F.count_if(F.col("score") >= 0.9).alias("high"), F.count_if((F.col("score") >= 0.75) & (F.col("score") < 0.9)).alias("medium"), F.count_if(F.col("score") < 0.75).alias("low"))
    rate = lambda a: F.when(F.col("total_items") == 0, 0.0).otherwise(F.try_divide(a, F.col("total_items")) * 100.0)
    both = per.withColumn("k", F.lit(1)).join(s.withColumn("k", F.lit(1)), "k").drop("k")
    return both.fillna(0, ["total_matches"]).withColumn("success_rate", rate(F.col("total_items") - F.col("items_with_errors"))).withColumn("match_rate", rate(F.col("items_with_matches")))
