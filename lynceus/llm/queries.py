"""Queries of the problems tagged llm and their oracle SQL."""

from __future__ import annotations

from .addresses import p4_found
from .matching import p7_found, p7_matches
from .mixing import p9_selection, p9_shares
from .one_form import p5_found
from .packing import p8_packing, p8_report
from .shared_spans import p10_coverage, p10_found, p10_passages
from .spellings import p1_found
from .survivors import p2_found, p2_masked

QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_masked": p2_masked, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p7_matches": p7_matches, "p8_packing": p8_packing, "p8_report": p8_report, "p9_selection": p9_selection, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_coverage": p10_coverage, "p10_passages": p10_passages,
}
_ID = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(source_id)), '^(\\d+)\\.0+$', '\\1'), '[\\s._/-]+', '.', 'g'), '^([a-z]+)\\.?(\\d)', '\\1.\\2'), '^([a-z]+\\.)?0+(\\d)', '\\1\\2')"
_FILLED = " + ".join(f"(a.{p} IS NOT NULL AND lower(trim(a.{p})) NOT IN ('', '-0-', 'n/a', 'na', 'null', 'none', 'unknown', '-'))::int" for p in ("line1", "line2", "city", "state", "postal_code", "country"))
SQL: dict[str, str] = {
    "p2_found": f"""SELECT min(record_id) AS group_record_id, arg_max(record_id, row(updated_at, fa, -record_id)) FILTER (fa > 0) AS addresses_record_id, arg_max(record_id, row(updated_at, fr, -record_id)) FILTER (fr > 0) AS remarks_record_id
      FROM (SELECT record_id, updated_at, source_list, {_ID} AS k, coalesce(list_sum(list_transform(addresses, lambda a: {_FILLED})), 0) AS fa,
      CASE WHEN remarks IS NULL OR lower(trim(remarks)) IN ('', '-0-', 'n/a', 'na', 'null', 'none', 'unknown', '-') THEN 0 ELSE length(trim(remarks)) END AS fr FROM entities WHERE source_id IS NOT NULL)
      WHERE k <> '' GROUP BY source_list, k HAVING count(*) > 1""",
    "p10_found": """WITH g AS (SELECT DISTINCT doc_id, hash(substr(text, i::bigint, 240)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS i FROM documents WHERE length(text) >= 240)),
      m AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), k AS (SELECT g.* FROM g JOIN m USING (h))
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
