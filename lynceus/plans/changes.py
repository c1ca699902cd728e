"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.script import LOOK_LATIN
from ..operators.snapshot_diff import code_set, same_look_column, snapshot_changes
from ..session import table, written


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Source ids added, removed or changed in name or programs since the same list's snapshot before."""
    rows = table(spark, folder, "list_snapshots").select("snapshot_no", "source_list", "source_id", "name", "programs")
    names = written(rows.select("name").distinct().withColumn("look", same_look_column("name")))
    rows = rows.join(names, rows["name"].eqNullSafe(names["name"]), "left").drop(names["name"])
    states = {"name": F.col("look"), "programs": code_set(F.col("programs"))}
    return snapshot_changes(rows, "source_list", "source_id", "snapshot_no", states)


def _fold_sql(c: str) -> str:
    """Look-alike letters, full-width forms and case made one; white space and ignorable characters gone."""
    wide = {chr(o + 0xFEE0): chr(o) for o in range(0x21, 0x7F)}
    pairs = LOOK_LATIN | wide
    src, dst = "".join(pairs), "".join(pairs.values()).replace("'", "''")
    ignorable = "[\\x{00AD}\\x{034F}\\x{061C}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
    return f"lower(translate(regexp_replace(nfc_normalize(coalesce({c}, '')), '{ignorable}', '', 'g'), '{src}', '{dst}'))"


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {
    "p3_found": f"""WITH s AS (SELECT snapshot_no, source_list, source_id, list_sort(list_distinct(list({_fold_sql('name')}))) AS names,
      list_sort(list_distinct(list(array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(programs, []), lambda c: upper(trim(regexp_replace(c, '\\s+', ' ', 'g')))), lambda c: c IS NOT NULL AND c <> ''))), '|')))) AS codes
      FROM list_snapshots WHERE source_id IS NOT NULL AND source_list IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY ALL),
      n AS (SELECT source_list, snapshot_no, lag(snapshot_no) OVER (PARTITION BY source_list ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT source_list, snapshot_no FROM s)),
      a AS (SELECT s.*, n.before FROM s JOIN n USING (source_list, snapshot_no) WHERE n.before IS NOT NULL), b AS (SELECT n.snapshot_no, s.source_list, s.source_id, s.names, s.codes FROM s JOIN n ON s.source_list = n.source_list AND s.snapshot_no = n.before)
      SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.source_list, b.source_list) AS source_list, coalesce(a.source_id, b.source_id) AS source_id, CASE WHEN b.source_id IS NULL THEN 'added' WHEN a.source_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
      FROM a FULL JOIN b ON a.snapshot_no = b.snapshot_no AND a.source_list = b.source_list AND a.source_id = b.source_id WHERE a.source_id IS NULL OR b.source_id IS NULL OR a.names <> b.names OR a.codes <> b.codes""",
}
