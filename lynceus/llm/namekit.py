"""Reading of one typed name: scripts, accents, titles, legal forms, trade words and initials.

Everything here is plain Python on one string, called from Arrow batches over *distinct* strings only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ..functions.script import SPACES, clean, fold_token

# Cyrillic letters and their usual Latin transcription.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Latin letters that have no decomposition.
LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"}
# Words before a person's name.
TITLES = frozenset("mr mrs ms miss dr prof gen general col colonel capt captain sheikh sheik sir hon eng haji mullah".split())
# Words before a ship's name; "m/v" and "m.v." are read as "mv".
SHIP = frozenset("mv mt ms ss mts".split())
# Legal forms, longest first; all mean that the name is a company's.
LEGAL = [
    "limited liability company", "gesellschaft mit beschrankter haftung", "gesellschaft mbh", "gesellschaft m b h",
    "sociedad anonima", "societe anonyme", "joint stock company", "free zone establishment", "free zone company",
    "public limited company", "incorporated", "corporation", "limited", "company", "g m b h", "l l c", "j s c",
    "o o o", "f z e", "fz e", "s a r l", "p l c", "s a", "gmbh", "corp", "inc", "ltd", "llc", "jsc", "ooo", "fze", "plc",
    "sarl", "co", "sa", "ag", "llp", "llcc", "jsc", "ojsc", "pjsc", "korporation",
]
# Trade words and their short forms.
TRADE = {
    "aviation": "aviation avn aviat av", "chemical": "chemical chem chemicals chm", "commercial": "commercial comm coml com cml",
    "bank": "bank bk bnk", "construction": "construction constr const cons constrn", "electronics": "electronics elec electr electron elect",
    "engineering": "engineering eng engr engg engin engrg", "foundation": "foundation found fdn fndn fnd", "group": "group grp gp gr",
    "holdings": "holdings hldg hldgs holding hold", "industries": "industries ind inds industry indus", "international": "international intl int intern internat",
    "investment": "investment inv invest invt invmt investments", "logistics": "logistics lgstcs logist log logis", "manufacturing": "manufacturing mfg manuf mfrg manu",
    "marine": "marine mar mrn", "services": "services serv svcs svc srv service", "petroleum": "petroleum petr petrol petro pet",
    "shipping": "shipping ship shpg shipp shpng", "technologies": "technologies tech techn technology technol", "trading": "trading trdg trd trad tr",
}
TRADE_OF = {short: full for full, shorts in TRADE.items() for short in shorts.split()}
# Given names and their short forms, each line one person.
NICK = """alexander alex alec alek sasha aleksandr sandro xander
alexandra sasha sandra aleksandra
andrew andy drew andrei
anthony tony antonio anton
anatoly tolya anatoli
grigori grisha grigory gregory
barbara barb babs
benjamin ben benny
catherine kate cathy katya katherine kathryn katie ekaterina
charles charlie chuck carlos
christopher chris kit
daniel dan danny
david dave davy
deborah debbie deb
dmitri dima dmitry mitya
donald don donnie
dorothy dot dottie
edward ed eddie ted ned eduard
elizabeth liz beth betty eliza lizzie
enrique quique kike henry
eugene gene evgeni zhenya evgeny yevgeny
francisco paco pancho francis frank
gabriel gabe
george georgie yuri georgy
gerald jerry gerry
gregory greg grisha
guadalupe lupe
henry hank harry heinz heinrich
giuseppe beppe peppe joseph
ignacio nacho
ivan vanya ivo
jacob jake jakub
james jim jimmy jamie
jennifer jen jenny
jesus chuy
joseph joe joey jose pepe iosif
john jack johnny jon
jonathan jon
joshua josh
kenneth ken kenny
konstantin kostya
lawrence larry
leonard leo len lenny
leonid lenya
manuel manolo manny
margaret maggie peggy meg greta rita
maria masha mary
matthew matt
michael mike mick mikhail misha
mikhail misha michael
mohammed mo mohamed muhammad mohammad muhammed
natalia natasha nataliya
nicholas nick nicolas
nikolai kolya nikolay nicholas
patricia pat patty trish
patrick pat paddy
pavel pasha paul
peter pete pyotr petya pedro
pyotr petya peter petr
philip phil
rafael rafa
raymond ray
rebecca becky
richard dick rick rich ricky
robert bob rob bobby roberto
ronald ron ronnie
roman roma
samuel sam sammy
santiago santi
sergei seryozha sergey serge
stanislav stas
stephen steve steven
susan sue suzy
svetlana sveta
tatiana tanya
theodore ted teddy theo fyodor
thomas tom tommy
timothy tim
valentina valya
vasily vasya
victor vic viktor
victoria vicky tori viktoria
vladimir vova volodya vlad
vyacheslav slava
walter walt wally
william bill will billy liam
yekaterina katya
yevgeny zhenya
yuri yura george
zachary zach zack"""
NICK_OF: dict[str, set[int]] = {}
for _n, _line in enumerate(NICK.split("\n")):
    for _w in _line.split():
        NICK_OF.setdefault(_w, set()).add(_n)
# What stands for "no name".
FILLER = frozenset("test unknown none null na nil tbd xxx asdf name dummy sample anonymous".split())
WORD = re.compile(r"[a-z]+")
#: Cyrillic letters that no Latin letter looks like.
CYRILLIC_ONLY = re.compile(r"[бвгджзийклнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ]")
LATIN_LETTER = re.compile(r"[A-Za-z]")
SOUND = [
    ("sch", "sh"), ("zh", "j"), ("kh", "h"), ("ph", "f"), ("ck", "k"), ("ch", "c"), ("ou", "u"), ("oo", "u"), ("ee", "i"), ("q", "k"), ("w", "v"), ("y", "i"),
]
DOUBLED = re.compile(r"(.)\1+")


def latin(text: str) -> str:
    """Lower-case Latin letters of a name, scripts and accents gone; other signs stay. A word of look-alike Cyrillic letters only is Cyrillic in
    a name that is."""
    if text.isascii():
        return SPACES.sub(" ", text).strip().lower()
    tokens = clean(text).split(" ")
    cyrillic = any(CYRILLIC_ONLY.search(t) for t in tokens)
    text = " ".join(t if cyrillic and not LATIN_LETTER.search(t) else fold_token(t) for t in tokens).lower()
    text = "".join(CYRILLIC.get(c, c) for c in unicodedata.normalize("NFC", text))
    text = "".join(LETTERS.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 14)
def sound(token: str) -> str:
    """Spelling-tolerant form: transcription variants made one, doubled letters single."""
    for a, b in SOUND:
        token = token.replace(a, b)
    return DOUBLED.sub(r"\1", token)


#: Each with its first word, which a name must hold.
_LEGAL = [(x.split(" ")[0], re.compile(rf"(?<![a-z]){x.replace(' ', r'[ .-]*')}(?![a-z])")) for x in LEGAL]


def read(name: str | None) -> tuple[str, list[str], list[str], list[str]]:
    """(kind, words, initials, trade): kind "c" company, "n" other name, "" nobody.

    words: whole words that tell the name apart, as written; initials: single letters; trade: the line of business.
    """
    if not name:
        return "", [], [], []
    text = re.sub(r"['’`]", "", latin(name))
    text = re.sub(r"\bm\s*[/.]\s*([vt])\b\.?", r"m\1", text)
    low = re.sub(r"[^a-z]+", " ", text).strip()
    kind, legal = "n", False
    for first, p in _LEGAL:
        if first not in low:
            continue
        shorter, n = p.subn(" ", low)
        if n and shorter.strip():
            low, legal = shorter, True
    low = re.sub(r"^a c (?=[a-z]{2})", "", low)
    tokens = WORD.findall(low)
    if tokens[:1] == ["eng"] and not legal and len(tokens) > 2:  # an engineer, or a company with its trade in front
        kind, tokens = "e", tokens[1:]
    trade = []
    words = []
    for k, t in enumerate(tokens):
        full = TRADE_OF.get(t)
        if full and (len(t) > 2 or t in ("bk", "gp", "gr")) and len(tokens) > 1:
            trade.append(full)
        else:
            words.append(t)
    if legal or trade:
        kind, trade = "c", trade + ["engineering"] * (kind == "e")
    while len(words) > 1 and (words[0] in TITLES or words[0] in SHIP or words[0] == "the"):
        words = words[1:]
    words = [w for w in words if w != "the"]
    if not words or all(w in FILLER for w in words):
        return "", [], [], []
    initials = [w for w in words if len(w) == 1]
    return kind, [w for w in words if len(w) > 1], initials, sorted(set(trade))
