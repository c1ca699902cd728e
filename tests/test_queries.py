"""Every registered query runs, and agrees with its SQL where it has one."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        if isinstance(v, (int, float)):
            return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
        return str(v)

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_agrees(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, sf, name):
    """Rows there are, no row twice, and the same rows again."""
    first = entry.queries()[name](spark, sf)
    rows = canonical(first.columns, [tuple(r) for r in first.collect()])
    assert rows and len(set(map(repr, rows))) == len(rows)
    second = entry.queries()[name](spark, sf)
    assert canonical(second.columns, [tuple(r) for r in second.collect()]) == rows


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_screening_of_all_items_is_brute_force(spark, sf):
    """Every item against every name of every entity, scored one by one."""
    from lynceus.functions import similarity as S

    names = [(r.record_id, r.source_list, (r.entity_type or "").upper(), {S.plain(n) for n in [r.name, *(r.alt_names or [])] if n}) for r in spark.read.parquet(f"{sf}/entities.parquet").collect()]
    known, want = {}, set()
    for r in spark.read.parquet(f"{sf}/search_items.parquet").collect():
        x = S.plain(r.name)
        if x not in known:
            known[x] = [(i, s, t, max((S.read_name_score(x, n) for n in ns if n), default=0.0)) for i, s, t, ns in names] if x else []
        from lynceus.functions import words as W

        source = r.source_list.upper() if r.source_list and r.source_list.upper() in W.SOURCES else None
        kind = r.entity_type.upper() if r.entity_type and r.entity_type.upper() in W.ENTITY_TYPES else None
        hits = sorted(((-v, i) for i, s, t, v in known[x] if v >= 0.88 and source in (None, s) and kind in (None, t)))[:10]
        want |= {(r.item_id, k, str(i), round(-v, 6)) for k, (v, i) in enumerate(hits, 1)}
    got = entry.queries()["screen_items"](spark, sf).where("rank IS NOT NULL")
    assert {(r.item_id, r.rank, r.entity_id, r.score) for r in got.collect()} == want and want


def test_core_does_not_import_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/lynceus/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert ".llm" not in open(path).read().replace("lynceus.llm import queries", ""), path
