"""Word lists and lookup tables that results depend on."""

from __future__ import annotations

# Stopwords by language.
STOPWORDS = {
    "en": (
        "a an and are as at be by for from has he in is it its of on or that the to was were will with about above after all also am any "
        "because been but can could did do does each had have her here him his how if into me more most my no not now only other our out "
        "over said she so some such than them then there these they this through up very we what when where which who why would you your"
    ),
    "es": (
        "el la de del los las un una unos unas y o pero por para en con sin sobre entre a al como cuando donde que cual quien se su sus mi "
        "mis tu tus le les lo me te nos es son está están ser estar ha han fue fueron era eran más muy todo todos toda todas este esta estos "
        "estas ese esa esos esas aquel aquella aquellos aquellas ya si no ni"
    ),
    "fr": (
        "le la les l un une des du de d et ou mais car donc ni or pour par dans en sur sous avec sans chez vers parmi pendant au aux à a ce "
        "cet cette ces mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs qui que qu quoi où se s y il elle on nous vous ils "
        "elles je tu me te lui est sont était étaient être avoir ont avait avaient eu fait faire dit dire tout tous toute toutes autre autres "
        "même mêmes tel telle tels telles si plus moins très bien ne pas"
    ),
    "de": (
        "der die das den dem des ein eine einer eines einem einen und oder aber denn für von mit zu bei in an auf aus um nach vor über unter "
        "durch gegen ohne bis seit während als wie wenn weil dass ob ich du er sie es wir ihr mein dein sein unser euer ist sind war waren "
        "haben hat hatte hatten wird werden wurde wurden dieser diese dieses jener jene jenes welcher welche welches alle aller alles einige "
        "einiger einiges manche mancher manches mehr viel viele vieler vieles wenig wenige weniger weniges nicht kein keine keiner keines "
        "nichts nie niemals doch schon noch auch nur sehr so dann hier da dort wo wann wer was"
    ),
    "ru": (
        "в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь "
        "когда даже ну и для или ни быть был была были будет можно при без до под над об если они мы тебя тебе себя себе этот эта эти это "
        "тот та те весь вся всё который которая которое которые какой какая какое какие"
    ),
    "ar": (
        "في من إلى على هذا هذه ذلك التي الذي التى هو هي أن كان قد لم ما لا إن أو عن مع أي كل بعض غير حتى منذ بعد قبل عند فوق تحت أمام خلف "
        "بين ضد نحو لدى سوى هل لن لو كي ليس ليست كأن إذا ال و ف ب ل ك"
    ),
    "zh": (
        "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 里 那个 这个 他 她 它 们 之 与 及 于 但 或 则 "
        "而 且 因 为 以 所 其 并 从 对 由 此 让 给 把 被 又 将 更 已 等 些"
    ),
}
# The words that pairing of name tokens passes over.
PAIR_STOPWORDS = frozenset("a an and are as at be by for from has he in is it its of on or that the to was were will with".split())
# Main languages of countries.
COUNTRY_LANGUAGES = {
    "en": "united states, usa, us, united kingdom, uk, gb, canada, australia, new zealand, ireland, south africa",
    "es": "spain, mexico, argentina, colombia, chile, peru, venezuela, ecuador, guatemala, cuba, bolivia, dominican republic, honduras, paraguay, el salvador, nicaragua, costa rica, panama, uruguay",
    "fr": "france, belgium, switzerland, luxembourg, monaco, haiti, senegal, ivory coast, mali, niger, burkina faso, madagascar",
    "de": "germany, austria, liechtenstein",
    "ru": "russia, belarus, kazakhstan, kyrgyzstan, tajikistan",
    "ar": "saudi arabia, egypt, uae, united arab emirates, iraq, syria, jordan, lebanon, kuwait, yemen, oman, qatar, bahrain, libya, tunisia, algeria, morocco, sudan",
    "zh": "china, taiwan, hong kong, macau, singapore",
    "ja": "japan", "ko": "korea, south korea", "pt": "portugal, brazil", "it": "italy", "nl": "netherlands", "pl": "poland", "tr": "turkey", "fa": "iran", "th": "thailand",
    "vi": "vietnam", "el": "greece", "sv": "sweden", "no": "norway", "da": "denmark", "fi": "finland", "cs": "czech republic", "hu": "hungary", "ro": "romania",
}
# Names that replace the locale data's for some country codes.
COUNTRY_OVERRIDES = {
    "CZ": "Czech Republic", "GB": "United Kingdom", "IR": "Iran", "KP": "North Korea", "KR": "South Korea", "MD": "Moldova", "MF": "Saint Martin", "RU": "Russia", "SX": "Saint Martin",
    "SY": "Syria", "TR": "Turkey", "TW": "Taiwan", "UK": "United Kingdom", "US": "United States", "USA": "United States", "VE": "Venezuela", "VG": "Virgin Islands", "VI": "Virgin Islands", "VN": "Vietnam",
}
# Short forms in titles.
TITLE_WORDS = {
    "ceo": "chief executive officer", "cfo": "chief financial officer", "coo": "chief operating officer", "pres": "president", "vp": "vice president", "dir": "director",
    "exec": "executive", "mgr": "manager", "sr": "senior", "jr": "junior", "asst": "assistant", "assoc": "associate", "tech": "technical", "admin": "administrator", "eng": "engineer", "dev": "developer",
}
# Kinds of affiliation that are near each other.
AFFILIATION_GROUPS = {
    "ownership": ["owned by", "subsidiary of", "parent of", "holding company", "owner", "owned", "subsidiary", "parent"],
    "control": ["controlled by", "controls", "managed by", "manages", "operated by", "operates"],
    "association": ["linked to", "associated with", "affiliated with", "related to", "connection to", "connected with"],
    "leadership": ["led by", "leader of", "directed by", "directs", "headed by", "heads"],
}
# Endings of business names that affiliations drop, the first that fits.
AFFILIATION_SUFFIXES = [" corporation", " inc", " ltd", " llc", " corp", " co", " company"]
# Endings of company names, in the order in which they are tried.
COMPANY_TITLES = [" incorporated", " corporation", " l l c", " limited", " company", " llc", " inc", " corp", " ltd", " co", " sa", " srl", " gmbh"]
# Name particles that are merged with their neighbours.
PARTICLES = frozenset("de la el du van von der da di dos das".split())
# Parts of names that tell a business.
COMPANY_NEEDLES = [
    "academy", "aviation", "bank", "business", "co.", "commission", "committee", "company", "corporation", "defense", "electronics", "equipment", "export", "group", "guard", "holding", "import",
    "industrial", "industries", "industry", "institute", "intelligence", "international", "investment", "lab", "limited", "llc", "logistics", "ltd", "ltd.", "partnership", "revolutionary",
    "solutions", "subsidiary", "supply", "technology", "trading", "university",
]
# Letter codes of the phonetic key; letters without a code separate.
SOUND_CODES = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
# First letters that can stand for each other.
FIRST_LETTERS = [("c", "k"), ("c", "s"), ("s", "z"), ("f", "p"), ("g", "j")]
# Letters that are written out before accents are stripped.
WRITTEN_OUT = {"ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ß": "ss"}
# Sources and their names.
SOURCES = ["US_OFAC", "US_CSL", "US_NON_SDN", "EU_CSL", "UK_CSL"]
ENTITY_TYPES = ["PERSON", "BUSINESS", "ORGANIZATION", "AIRCRAFT", "VESSEL", "UNKNOWN"]
