"""Snapshot differences against a plain comparison; packed values; nulls, repeats, empty tables."""

import random

from pyspark.sql import functions as F

from lynceus.operators.packed_values import dialects, packed_values, parse, strip_value
from lynceus.operators.snapshot_diff import code_set, snapshot_changes

SCHEMA = "no int, list string, id string, name string, programs array<string>, extra string"


def diff(spark, rows, chunk=4):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = snapshot_changes(df, "list", "id", "no", {"name": F.lower("name"), "programs": code_set(F.col("programs"))}, chunk)
    return {tuple(r) for r in out.collect()}


def plain_diff(rows):
    state: dict = {}
    for no, space, key, name, programs in rows:
        if None in (no, space, key):
            continue
        n, p = state.setdefault((space, no), {}).setdefault(key, (set(), set()))
        n.add((name or "").lower() if name is not None else None)
        p.add(tuple(sorted({x.strip().upper() for x in programs or [] if x and x.strip()})))
    out = set()
    for space in {s for s, _ in state}:
        numbers = sorted(n for s, n in state if s == space)
        for a, b in zip(numbers, numbers[1:], strict=False):
            x, y = state[space, a], state[space, b]
            out |= {(b, space, k, "added" if k not in x else "removed" if k not in y else "changed") for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    return out


def test_against_plain_comparison(spark):
    rng = random.Random(1)
    rows = []
    for space in ("A", "B", None):
        for no in (1, 2, 4, 7):
            for k in range(120):
                if rng.random() < 0.95:
                    row = (no, space, f"id{k}" if k else None, f"name {k}{'x' if rng.random() < 0.03 else ''}", rng.choice([None, []]) if k % 9 == 0 else (["b", " A"] if rng.random() < 0.5 else ["A ", "B", "b"]))
                    rows += [row] * (2 if rng.random() < 0.1 else 1)
    want = plain_diff(rows)
    assert len(want) > 30 and diff(spark, rows) == want == diff(spark, rows, 64)


def test_edges(spark):
    assert diff(spark, []) == set()
    assert diff(spark, [(1, "A", "k", "n", None), (1, "A", "k", "n", [])]) == set()
    assert diff(spark, [(1, "A", "k", "n", None), (3, "A", "k", "N", []), (3, "A", "k", "N", [None, " "])]) == set()
    assert diff(spark, [(1, "A", "k", None, ["x"]), (2, "A", "k", "n" * 50_000, ["x"])]) == {(2, "A", "k", "changed")}


def test_parse():
    assert parse('a; "b; c"; d', (";",), True) == ["a", ' "b; c"'.strip(), "d"] or [strip_value(x) for x in parse('a; "b; c"; d', (";",), True)] == ["a", "b; c", "d"]
    assert [strip_value(x) for x in parse("[A][B [C]] [D]", ("[]",), False)] == ["A", "B [C]", "D"]
    assert parse("A [B]", ("[]",), False) is None
    assert strip_value('"also ""X""; see"') == 'also "X"; see' and strip_value('the "Broker"') == 'the "Broker"' and strip_value("") == ""
    assert ((";",), True) in dialects('a;"b"') and dialects("plain") == [((), False)]


def test_packed_values(spark):
    words = ["DOB 1 Jan 1950", "Gender Male", "Linked To: Acme Trading", "Passport A123, issued Town", "Tax ID No. 77"]
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(300):
        vs = rng.sample(words, rng.randint(1, 4))
        sep = rng.choice(["; ", ";", " | ", "\n"])
        rows.append((i, sep.join(vs) + ("." if i % 7 == 0 else ""), "A;B" if i % 2 else "A", 1))
        if len(vs) > 1:
            want.update({(i, "remarks", p): v for p, v in enumerate(vs, 1)})
        if i % 2:
            want.update({(i, "codes", 1): "A", (i, "codes", 2): "B"})
    rows += [(1000, None, None, 1), (1001, "", " ; ;", 1), (1002, "-0-", "-0-", 1), (1003, "Gender Male;;" * 1, "x" * 100_000, 1), (1003, "Gender Male;;", None, 1)]
    df = spark.createDataFrame(rows, "id long, remarks string, codes string, pos int")
    got = {(r.id, r.field_name, r.pos): r.value_text for r in packed_values(df, "id", ["remarks", "codes"]).collect()}
    assert got == want
    assert packed_values(df.limit(0), "id", ["remarks"]).count() == 0


def test_shared_folder(spark):
    import os

    from lynceus.session import shared_folder, written

    df = written(spark.range(10))
    assert df.count() == 10
    folder = shared_folder(spark).replace("file://", "")
    assert any(x.startswith("lynceus-") for x in os.listdir(folder))


def test_any_number_of_listed_codes(spark):
    """Six codes stand in three fields, however many others are listed; words of any length have codes."""
    from lynceus.operators.packed_values import packed_values

    rows = spark.createDataFrame([(1, "AAA BBB"), (2, "CCC DDD"), (3, "EEE FFF"), (4, None), (5, "-0-"), (6, " ")], "record_id long, programs string")
    six = ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF"]
    for more in (0, 5000):
        codes = spark.createDataFrame([(c,) for c in [*six, *[f"Z{k}" for k in range(more)]]], "code string")
        got = packed_values(rows, "record_id", ["programs"], {"programs": codes}).collect()
        assert sorted((r.record_id, r.pos, r.value_text) for r in got) == [(1, 1, "AAA"), (1, 2, "BBB"), (2, 1, "CCC"), (2, 2, "DDD"), (3, 1, "EEE"), (3, 2, "FFF")]
    word = "x" * 100
    texts = spark.createDataFrame([(k, f"{word} a{k}; {word} b{k}") for k in range(12)], "record_id long, remarks string")
    got = packed_values(texts, "record_id", ["remarks"]).collect()
    assert len(got) == 24 and all(r.value_text.startswith(word) for r in got)
