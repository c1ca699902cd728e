"""SQL of the text queries that read words, languages and countries."""

from __future__ import annotations

from ..functions import words as W
from .scores_sql import plain, quoted

_PARTICLES = quoted(sorted(W.PARTICLES))


def _joined(test: str) -> str:
    """The words of t with the blank after word i left out where the test holds."""
    return f"array_to_string(list_transform(t, lambda x, i: x || CASE WHEN i = len(t) OR ({test}) THEN '' ELSE ' ' END), '')"


_FORMS = "list_filter([c, CASE WHEN o <> c THEN o END, CASE WHEN a <> c THEN a END], lambda x: x IS NOT NULL)"
_ONCE, _ALL = _joined(f"x IN ({_PARTICLES}) AND t[i + 1] IN ({_PARTICLES})"), _joined(f"x IN ({_PARTICLES})")
_GUESS = """CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'en|0.0' WHEN regexp_matches({c}, '[\\x{{0400}}-\\x{{052f}}]') THEN 'ru|0.9' WHEN regexp_matches({c}, '[\\x{{0600}}-\\x{{06ff}}\\x{{0750}}-\\x{{077f}}\\x{{08a0}}-\\x{{08ff}}]') THEN 'ar|0.9'
      WHEN regexp_matches({c}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]') THEN 'zh|0.9' WHEN length({c}) < 3 THEN 'en|0.5' WHEN length({c}) < 30 AND regexp_matches(lower({c}), '(^| )(the|a|of)( |$)') THEN 'en|0.8' WHEN length({c}) < 30 AND regexp_matches(lower({c}), '(^| )(el|la|de|del)( |$)') THEN 'es|0.8' ELSE 'en|0.5' END"""
_OWN = "CASE lower(trim(country)) " + " ".join(f"WHEN '{n.strip()}' THEN '{lang}'" for lang, names in W.COUNTRY_LANGUAGES.items() for n in names.split(",")) + " END"


def _stopped(lang: str, w: str) -> str:
    return f"CASE {lang} " + " ".join(f"WHEN '{k}' THEN {w} IN ({quoted(v.split())})" for k, v in W.STOPWORDS.items()) + " ELSE false END"


def _read(c: str) -> str:
    c = f"coalesce({c}, '')"
    return plain(f"replace(replace(CASE WHEN contains({c}, ',') THEN trim(regexp_replace({c}, '^[^,]*,', '')) || ' ' || trim(split_part({c}, ',', 1)) ELSE {c} END, chr(39), ''), chr(8217), '')")


def _unstopped(c: str, lang: str) -> str:
    return f"array_to_string(list_filter(string_split({c}, ' '), lambda w: w <> '' AND NOT {_stopped(lang, 'lower(w)')}), ' ')"


def _seen(values: str) -> str:
    """The elements that aren't empty, each where it first stands."""
    return f"list_transform([{values}], lambda l: list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i))[1]"


_LINE = "coalesce(lower(translate(nullif(a.{f}, ''), ',.', '')), '')"
_ADDRESS = "trim(concat_ws(' ', " + ", ".join(_LINE.format(f=f) for f in ("line1", "city", "state")) + ", coalesce(lower(a.postal_code), ''), coalesce(lower(a.country), '')))"
_ENDINGS = "|".join(t.replace(" ", "\\s") for t in W.COMPANY_TITLES)
# English names of the countries of the given addresses with their codes, as the JVM's locale data and the stated overrides have them.
_COUNTRIES = {
    "Belarus": "BY BLR", "China": "CN CHN", "Colombia": "CO COL", "Cuba": "CU CUB", "Cyprus": "CY CYP", "France": "FR FRA", "Germany": "DE DEU", "Iran": "IR IRN", "Latvia": "LV LVA", "Lebanon": "LB LBN", "Libya": "LY LBY", "Malta": "MT MLT", "Mexico": "MX MEX",
    "Myanmar (Burma)": "MM MMR", "Nigeria": "NG NGA", "Pakistan": "PK PAK", "Panama": "PA PAN", "Russia": "RU RUS", "Serbia": "RS SRB", "Singapore": "SG SGP", "South Korea": "KR KOR", "Spain": "ES ESP", "Sudan": "SD SDN", "Switzerland": "CH CHE", "Syria": "SY SYR",
    "Turkey": "TR TUR", "United Arab Emirates": "AE ARE", "United Kingdom": "GB GBR UK", "Venezuela": "VE VEN", "Yemen": "YE YEM",
}
_NAME = "CASE upper(trim(country)) " + " ".join(f"WHEN '{k}' THEN '{n}'" for n, codes in _COUNTRIES.items() for k in dict.fromkeys([n.upper(), *codes.split()])) + " ELSE coalesce(trim(country), '') END"

SQL = {
    "particle_forms": f"SELECT doc_id, len(f) AS forms, md5(array_to_string(f, '|')) AS forms_md5 FROM (SELECT doc_id, {_FORMS} AS f FROM (SELECT doc_id, c, {_ONCE} AS o, {_ALL} AS a FROM (SELECT doc_id, c, string_split(c, ' ') AS t FROM (SELECT doc_id, {plain('text')} AS c FROM documents))))",
    "country_names": f"SELECT address_id, country, {_NAME} AS country_name FROM prepared_addresses",
    "country_languages": f"""SELECT address_id, own AS language, CASE WHEN split_part(g, '|', 2)::double >= 0.5 THEN CASE WHEN split_part(g, '|', 2)::double < 0.7 AND own IS NOT NULL AND own <> split_part(g, '|', 1) THEN own ELSE split_part(g, '|', 1) END ELSE coalesce(own, 'en') END AS chosen
      FROM (SELECT address_id, {_OWN} AS own, {_GUESS.format(c='line1')} AS g FROM prepared_addresses)""",
    "prepared_fields": f"""WITH n AS MATERIALIZED (SELECT record_id, split_part({_GUESS.format(c='name')}, '|', 1) AS lang, {_read('name')} AS first, addresses, coalesce(alt_names, []) AS alts FROM entities),
      al AS MATERIALIZED (SELECT record_id, i, {_read('x')} AS x FROM (SELECT record_id, unnest(alts) AS x, unnest(range(1, len(alts) + 1)) AS i FROM n)), ag AS MATERIALIZED (SELECT record_id, i, x, split_part({_GUESS.format(c='x')}, '|', 1) AS lang FROM al),
      ad AS MATERIALIZED (SELECT *, {_unstopped('x', 'lang')} AS y FROM ag), l AS MATERIALIZED (SELECT record_id, list(x ORDER BY i) FILTER (x <> '') AS before, list(y ORDER BY i) FILTER (x <> '') AS after FROM ad GROUP BY record_id),
      p AS MATERIALIZED (SELECT n.record_id, lang, addresses, {_unstopped('first', 'lang')} AS name, {_seen('coalesce(after, [])')} AS alts, list_concat(CASE WHEN first <> '' THEN [first] ELSE [] END, {_seen('coalesce(before, [])')}) AS written FROM n LEFT JOIN l USING (record_id)),
      t AS MATERIALIZED (SELECT record_id, i, regexp_replace(x, '(?:(?:{_ENDINGS})\\s*)+$', '') AS bare FROM (SELECT record_id, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x FROM (SELECT record_id, list_concat(CASE WHEN name <> '' THEN [name] ELSE [] END, alts) AS xs FROM p))),
      b AS (SELECT record_id, list(bare ORDER BY i) AS bares FROM t GROUP BY record_id),
      w AS (SELECT record_id, flatten(list(f ORDER BY i)) AS forms FROM (SELECT record_id, i, {_FORMS} AS f FROM (SELECT record_id, i, c, {_ONCE} AS o, {_ALL} AS a FROM (SELECT record_id, i, c, string_split(c, ' ') AS t FROM (SELECT record_id, unnest(range(1, len(written) + 1)) AS i, unnest(written) AS c FROM p)))) GROUP BY record_id)
      SELECT record_id, name, array_to_string(alts, '|') AS alt_names, coalesce(array_to_string({_seen('forms')}, '|'), '') AS word_forms, coalesce(array_to_string({_seen('bares')}, '|'), '') AS without_company_titles,
      array_to_string({_seen(f"list_transform(coalesce(addresses, []), lambda a: {_ADDRESS})")}, '|') AS addresses, lang AS language FROM p LEFT JOIN b USING (record_id) LEFT JOIN w USING (record_id)""",
}
