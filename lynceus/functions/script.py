"""Characters that look alike: cleaning of text and script-consistent folding of tokens, context-free and table-driven.

The tables are stated once and used by the snapshot comparison of the core.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts whose usual glyph is that of a Latin letter of the same case.
LOOK_LATIN = {
    # Cyrillic capitals
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small letters
    "ο": "o", "ν": "v", "ϳ": "j", "ρ": "p",
    # Armenian
    "Օ": "O", "օ": "o", "Տ": "S", "հ": "h", "ց": "g", "ո": "n", "ս": "u",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # further Cyrillic
    "Ү": "Y", "ѵ": "v", "Ѵ": "V",
}
# Characters that have no width of their own and can be ignored.
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
SPACES = re.compile(r"\s+")


def clean(text: str) -> str:
    """Compatibility form without ignorable characters, every run of white space one space, ends trimmed."""
    text = IGNORABLE.sub("", unicodedata.normalize("NFKC", IGNORABLE.sub("", text)))
    return SPACES.sub(" ", text.replace("‐", "-").replace("‑", "-")).strip()


def _script(c: str) -> str:
    o = ord(c[0])
    if not c[0].isalpha():
        return ""
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    return "C" if 0x400 <= o < 0x530 else "G" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "O"


def _alone(c: str) -> bool:
    """A letter of another script that no Latin letter, in either case, looks like."""
    base = unicodedata.normalize("NFD", c)[0]
    return _script(base) in ("C", "G") and base not in LOOK_LATIN and base.upper() not in LOOK_LATIN


LATIN_LOOK = {s: {b: a for a, b in LOOK_LATIN.items() if _script(a) == s} for s in "CG"}


def fold_token(token: str) -> str:
    """One script for one token: Latin, unless it has letters that only Cyrillic or Greek has."""
    scripts = {_script(c) for c in token} - {""}
    if scripts <= {"L"}:
        return token
    own = {_script(c) for c in token if _alone(c)}
    if not own:
        return "".join(LOOK_LATIN.get(c) or (LOOK_LATIN[c.upper()].lower() if _script(c) in ("C", "G") and c.upper() in LOOK_LATIN else c) for c in token)
    if len(own) == 1 and "L" in scripts:
        look = LATIN_LOOK[own.pop()]
        return "".join(look.get(c, c) for c in token)
    return token


def same_look(text: str | None) -> str:
    """Form that is equal for texts that differ only in letter case, white space and look-alike characters."""
    if text is None:
        return ""
    return unicodedata.normalize("NFKC", "".join(fold_token(t).casefold() for t in clean(text).split(" ")))
