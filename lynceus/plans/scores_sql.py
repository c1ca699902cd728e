"""The name scores as SQL expressions, written from their formulas: what the scorers must give, in another language.

Every function takes SQL expressions and gives one. ``let`` binds a value to a name, by a list of one element.
"""

from __future__ import annotations

import re
from itertools import count

from ..config import DEFAULT, Similarity
from ..functions import words as W

_fresh = count()


def name() -> str:
    return f"v{next(_fresh)}"


def let(value: str, body) -> str:
    if re.fullmatch(r"\w+", value):
        return body(value)
    v = name()
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def plain(c: str) -> str:
    x = f"lower(regexp_replace({c}, '[.,-]', ' ', 'g'))"
    for a, b in W.WRITTEN_OUT.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace(strip_accents({x}), '[\\x{{0300}}-\\x{{036f}}]|[\\x{{10000}}-\\x{{10ffff}}]', '', 'g')"
    x = f"regexp_replace({x}, '[\\p{{P}}\\p{{S}}\\s\\x1c-\\x1f\\x{{1680}}\\x{{2000}}-\\x{{2006}}\\x{{2008}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')"
    return f"coalesce(trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}} ]', '', 'g'), ' +', ' ', 'g')), '')"


def tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def sound(w: str) -> str:
    codes = {ch: d for d, ls in W.SOUND_CODES.items() for ch in ls}
    alphabet = "".join(sorted(codes))
    x = f"translate(translate({w}, '0123456789', 'aaaaaaaaaa'), '{alphabet}', '{''.join(codes[c] for c in alphabet)}')"
    x = f"regexp_replace({x}, '[^1-6]', '0', 'g')"
    for d in W.SOUND_CODES:
        x = f"regexp_replace({x}, '{d}+', '{d}', 'g')"
    return f"rpad(upper(substr({w}, 1, 1)) || replace(substr({x}, 2), '0', ''), 4, '0')"


def sounds(ws: str) -> str:
    v = name()
    return f"list_sort(list_distinct(list_transform({ws}, lambda {v}: {sound(v)})))"


def jaro(a: str, b: str) -> str:
    """The state of the greedy walk is a text: a flag for each letter of b, then the letters of a that were matched."""

    def scored(x: str, y: str) -> str:
        i, j, s, reach = name(), name(), name(), f"greatest(greatest(length({x}), length({y})) // 2 - 1, 0)"
        near = f"range(greatest(1, {i}::bigint - {reach}), least(length({y}), {i}::bigint + {reach}) + 1)"
        hit = f"list_filter({near}, lambda {j}: substr({y}, {j}, 1) = substr({x}, {i}::bigint, 1) AND substr({s}, {j}, 1) = '0')[1]"
        k = name()
        step = f"list_transform([{hit}], lambda {k}: CASE WHEN {k} IS NULL THEN {s} ELSE substr({s}, 1, {k} - 1) || '1' || substr({s}, {k} + 1) || substr({x}, {i}::bigint, 1) END)[1]"
        e = name()
        walk = f"list_reduce(list_transform(range(1, length({x}) + 1), lambda {e}: {e}::varchar), lambda {s}, {i}: {step}, repeat('0', length({y})))"

        def total(t: str) -> str:
            p, q = name(), name()
            theirs = f"array_to_string(list_transform(list_filter(range(1, length({y}) + 1), lambda {p}: substr({t}, {p}, 1) = '1'), lambda {q}: substr({y}, {q}, 1)), '')"
            mine = f"substr({t}, length({y}) + 1)"
            r = name()
            ratio = lambda m, th: f"(length({m}) / length({x})::double + length({m}) / length({y})::double + (length({m}) - len(list_filter(range(1, length({m}) + 1), lambda {r}: substr({m}, {r}, 1) <> substr({th}, {r}, 1))) / 2.0::double) / length({m})) / 3.0::double"
            return let(mine, lambda m: f"CASE WHEN {m} = '' THEN 0.0::double ELSE {let(theirs, lambda th: ratio(m, th))} END")

        return f"CASE WHEN {x} = {y} THEN 1.0::double WHEN {x} = '' OR {y} = '' THEN 0.0::double ELSE {let(walk, total)} END"

    return let(a, lambda x: let(b, lambda y: scored(x, y)))


def word_score(a: str, b: str, c: Similarity = DEFAULT) -> str:
    """Jaro boosted for a common beginning, cut for differing lengths and first letters."""
    same = " + ".join(f"(length({a}) >= {k} AND length({b}) >= {k} AND substr({a}, 1, {k}) = substr({b}, 1, {k}))::int" for k in range(1, c.prefix + 1)) or "0"
    boosted = lambda s: f"{s} + ({same}) * 0.1::double * (1 - {s})"
    ratio = f"least(length({a}), length({b})) / greatest(length({a}), length({b}), 1)::double"
    short = f"CASE WHEN {ratio} < {c.length_cutoff}::double THEN 1 - (1 - {ratio}) * {c.length_penalty}::double ELSE 1.0::double END"
    first = f"CASE WHEN {a} <> '' AND {b} <> '' AND substr({a}, 1, 1) <> substr({b}, 1, 1) THEN {c.letter_penalty}::double ELSE 1.0::double END"
    return let(jaro(a, b), lambda s: f"({boosted(s)}) * {short} * {first}")


def words_score(a: str, b: str, c: Similarity = DEFAULT) -> str:
    """Greedy pairs: the words of the shorter list in order, each with the best free word of the other."""

    def scored(x: str, y: str) -> str:
        stop = quoted(sorted(W.PAIR_STOPWORDS))

        def paired(few: str, many: str) -> str:
            f, m, k, acc, j, o = (name() for _ in range(6))
            row = f"list_transform({many}, lambda {m}: CASE WHEN {m} IN ({stop}) THEN -1.0::double ELSE {word_score(f, m, c)} END)"
            rows = f"list_transform(list_filter({few}, lambda {k}: {k} NOT IN ({stop})), lambda {f}: {{'r': {row}, 'used': []::bigint[], 's': 0.0::double, 'n': 0}})"
            e, z = name(), name()
            free = f"list_filter(range(1, len({e}.r) + 1), lambda {j}: {e}.r[{j}] > 0 AND NOT list_contains({acc}.used, {j}))"
            best = lambda fr: f"list_filter({fr}, lambda {o}: {e}.r[{o}] = list_max(list_transform({fr}, lambda {z}: {e}.r[{z}])))[1]"
            step = let(free, lambda fr: let(best(fr), lambda at: f"CASE WHEN {at} IS NULL THEN {acc} ELSE {{'r': {e}.r, 'used': list_append({acc}.used, {at}), 's': {acc}.s + {e}.r[{at}], 'n': {acc}.n + 1}} END"))
            return f"list_reduce({rows}, lambda {acc}, {e}: {step}, {{'r': []::double[], 'used': []::bigint[], 's': 0.0::double, 'n': 0}})"

        whole = jaro(f"array_to_string({x}, ' ')", f"array_to_string({y}, ' ')")
        few, many = f"CASE WHEN len({x}) <= len({y}) THEN {x} ELSE {y} END", f"CASE WHEN len({x}) <= len({y}) THEN {y} ELSE {x} END"
        pairs = let(few, lambda p: let(many, lambda q: paired(p, q)))
        both = let(pairs, lambda g: let(whole, lambda h: f"CASE WHEN {g}.n > 0 THEN 0.6::double * ({g}.s / {g}.n) + 0.4::double * {h} ELSE {h} END"))
        one = word_score(f"{x}[1]", f"{y}[1]", c)
        return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::double WHEN len({x}) = 1 AND len({y}) = 1 THEN {one} ELSE {both} END"

    return let(a, lambda x: let(b, lambda y: scored(x, y)))


def read_name_score(a: str, b: str, c: Similarity = DEFAULT) -> str:
    """Of normalised names: 1 for as many words with one set of sounds."""
    return let(tokens(a), lambda x: let(tokens(b), lambda y: f"CASE WHEN len({x}) = len({y}) AND {sounds(x)} = {sounds(y)} THEN 1.0::double ELSE {words_score(x, y, c)} END"))


def read_words_score(x: str, y: str, c: Similarity = DEFAULT) -> str:
    """The same of word lists that are columns."""
    return f"CASE WHEN len({x}) = len({y}) AND {sounds(x)} = {sounds(y)} THEN 1.0::double ELSE {words_score(x, y, c)} END"


def name_score(a: str, b: str, c: Similarity = DEFAULT) -> str:
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0::double ELSE {let(plain(a), lambda x: let(plain(b), lambda y: read_name_score(x, y, c)))} END"


def merged_words(ws: str) -> str:
    """A list of word lists: as they are; short words joined to the next; if that changed anything, short words joined to the one before."""
    acc, e, v = name(), name(), name()
    boxed = f"list_transform({ws}, lambda {v}: [{v}])"
    # ahead: "open" says that the last piece is a short word that takes the next one
    a = f"list_reduce(list_transform({ws}, lambda {v}: {{'out': [{v}], 'open': length({v}) <= 3}}), lambda {acc}, {e}: CASE WHEN {acc}.open THEN {{'out': list_append({acc}.out[1:len({acc}.out) - 1], {acc}.out[len({acc}.out)] || {e}.out[1]), 'open': false}} ELSE {{'out': list_concat({acc}.out, {e}.out), 'open': {e}.open}} END).out"
    b = f"list_reduce({boxed}, lambda {acc}, {e}: CASE WHEN length({e}[1]) <= 3 THEN list_append({acc}[1:len({acc}) - 1], {acc}[len({acc})] || {e}[1]) ELSE list_concat({acc}, {e}) END)"
    return let(ws, lambda w: f"CASE WHEN len({w}) < 2 THEN [{w}] ELSE {let(a.replace(ws, w), lambda x: f'CASE WHEN len({x}) = len({w}) THEN [{w}] ELSE {let(b.replace(ws, w), lambda y: f"CASE WHEN len({y}) < len({w}) AND {y} <> {x} THEN [{w}, {x}, {y}] ELSE [{w}, {x}] END")} END')} END")


def text_score(a: str, b: str, c: Similarity = DEFAULT) -> str:
    """Of two texts as they are written, with merged short words, after the test of first letters."""
    swaps = quoted([x + y for x, y in W.FIRST_LETTERS] + [y + x for x, y in W.FIRST_LETTERS])

    def scored(x: str, y: str) -> str:
        f, g = f"substr({x}, 1, 1)", f"substr({y}, 1, 1)"
        fit = f"({f} = {g} OR {f} || {g} IN ({swaps}) OR (regexp_matches({f}, '\\p{{Nd}}') AND regexp_matches({g}, '\\p{{Nd}}')))"
        p, q = name(), name()
        all_ = f"list_max(flatten(list_transform({merged_words(tokens(x))}, lambda {p}: list_transform({merged_words(tokens(y))}, lambda {q}: {words_score(p, q, c)}))))"
        test = f"WHEN NOT {fit} THEN 0.0::double" if c.phonetic_filter else ""
        return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0::double WHEN {x} = {y} THEN 1.0::double {test} ELSE least(1.0::double, greatest(0.0::double, {all_})) END"

    return let(plain(a), lambda x: let(plain(b), lambda y: scored(x, y)))
