"""Screening: the pruned plan against every pair, order, limits, streams."""

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lynceus.config import DEFAULT, ZERO
from lynceus.functions import similarity as S
from lynceus.operators import scoring, search
from lynceus.operators import report as R
from lynceus.schema import as_entities
from lynceus.streaming.screen import request_stream, screened

WORD = st.text("abdeinorst", min_size=1, max_size=8)
NAME = st.lists(WORD | st.sampled_from(["the", "of", "ivan", "yvan", "bank"]), min_size=1, max_size=4).map(" ".join)


@settings(max_examples=120, deadline=None)
@given(st.lists(NAME, min_size=1, max_size=12, unique=True), st.lists(NAME, min_size=1, max_size=12, unique=True), st.sampled_from([0.65, 0.8, 0.88, 0.95]), st.sampled_from([DEFAULT, ZERO]))
def test_pruning_loses_nothing(asked, names, least, config):
    kept = set(search.Block([(i, n, None, None) for i, n in enumerate(asked)], config, least).pairs(names))
    for i, a in enumerate(asked):
        for j, b in enumerate(names):
            if S.read_name_score(a, b, config) >= least:
                assert (i, j) in kept


def entities(spark, names):
    df = spark.createDataFrame([(i, n, a) for i, (n, a) in enumerate(names)], "pos long, n string, a array<string>")
    return as_entities(df, index_pos=F.col("pos"), id=F.col("pos").cast("string"), name=F.col("n"), entity_type=F.lit("PERSON"), source=F.lit("US_OFAC"), alt_names=F.col("a"))


def test_ties_keep_the_order_of_the_index(spark):
    index = entities(spark, [("other", None), ("john smith", None), ("jane smyth", None), ("x", ["john smith"]), ("", None), (None, None)])
    got = search.name_search(index, "John Smith", 0.9, limit=2).collect()
    assert [(r.index_pos, r.rank) for r in got] == [(1, 1), (2, 2)]
    assert search.name_search(index, "John Smith", 0.9, limit=1000).count() == 3
    assert search.name_search(entities(spark, [("a", None)]).limit(0), "a", 0.5).count() == 0


def test_blocks_give_the_same(spark):
    index = entities(spark, [(f"name {a}{b}", [f"{b} {a}"]) for a in "abcdef" for b in "ghijkl"])
    req = spark.createDataFrame([(i, f"nam {x}g") for i, x in enumerate("abcdef")], "item_pos long, name string").select("*", F.lit(None).cast("string").alias("source_f"), F.lit(None).cast("string").alias("type_f"))
    asked = req.select(F.col("item_pos").alias("q"), F.col("name").alias("text"), "source_f", "type_f")
    names = search.index_names(index)
    few = search.name_scores(asked, names, 0.7, block_names=2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, search.name_scores(asked, names, 0.7).collect()))


def test_words_are_compared_before_names(monkeypatch):
    """Names are settled many at once: none is compared alone, and few are left to score."""
    asked, names = [f"mar{x}in {y}olk" for x in "abdegk" for y in "stuvwz"], [f"{y}erim {x}andol" for x in "abdegk" for y in "stuvwz"] + ["marain solk"]
    alone = []
    jaro = S.jaro
    monkeypatch.setattr(S, "jaro", lambda a, b: alone.append(1) or jaro(a, b))
    kept = list(search.Block([(i, n, None, None) for i, n in enumerate(asked)], DEFAULT, 0.8).pairs(names))
    assert not alone and (asked.index("marain solk"), len(names) - 1) in kept


def test_only_names_that_reach_are_scored():
    """Names with a frequent word in common are settled many at once; those that are left to score reach the threshold."""
    start = ["kos", "mar", "vel", "dru", "pit", "zan"]
    asked = [f"{a}{b}en {c}ak limited" for a in start for b in "lnrt" for c in start] + ["ab cd", "the limited"]
    names = [f"{c}{b}ik {a}or limited" for a in start for b in "lnrt" for c in start] + ["ba dc", "koslen velak limited", "of limited"]
    for config, least in ((DEFAULT, 0.8), (DEFAULT, 0.88), (ZERO, 0.88)):
        kept = list(search.Block([(i, n, None, None) for i, n in enumerate(asked)], config, least).pairs(names))
        scores = {(i, j): S.read_name_score(a, b, config) for j, b in enumerate(names) for i, a in enumerate(asked)}
        want = {k for k, v in scores.items() if v >= least}
        assert want <= set(kept) and len(kept) == len(set(kept)) and min(scores[k] for k in kept) >= least - 2e-6 and want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdé ", max_size=12) | st.sampled_from(["ab" * 60, "a" * 90]), min_size=1, max_size=8))
def test_jaro_of_many_pairs(texts):
    signs = search.Signs(texts)
    x, y = np.divmod(np.arange(len(texts) ** 2), len(texts))
    assert search.jaros(signs, signs, x, y).tolist() == [S.jaro(texts[i], texts[j]) for i, j in zip(x, y, strict=True)]


def test_cells_keep_what_the_best_need(spark):
    """A batch without a threshold keeps no more rows than it can answer with, and gives the same."""
    index = entities(spark, [(f"{a} {b}", [f"{b} {a}"]) for a in "abcdef" for b in "ghijkl"])
    asked = spark.createDataFrame([(i, x, None, None) for i, x in enumerate(["a g", "c", "b h k"])], "q long, text string, source_f string, type_f string")
    names = search.index_names(index)
    same = lambda a, b, _: (ord(b[0]) % 3) / 2
    rows = [sorted(map(tuple, search.name_scores(asked, names, 0.0, scorer=same, most=k).collect()), key=lambda r: (r[0], -r[2], r[1])) for k in (None, 2)]
    assert len(rows[1]) < len(rows[0]) == 3 * 36
    best = lambda r: [[x for x in r if x[0] == q][:2] for q in range(3)]
    assert best(rows[0]) == best(rows[1])


def test_scorers_that_say_their_top_end_early(spark):
    """A scorer that says which names fail, and what the greatest score is, sees few pairs; rows are those of one that doesn't say it."""
    index = entities(spark, [(f"{a} {b}", [f"{b} {a}"]) for a in "abcdef" for b in "ghijkl"]).withColumn("source", F.when(F.col("index_pos") % 5 == 4, "EU_CSL").otherwise("US_OFAC"))
    asked = spark.createDataFrame([(0, "a g x", None, None), (1, "c", "EU_CSL", None), (2, "b h", None, None), (3, "d", "UK_CSL", None)], "q long, text string, source_f string, type_f string")

    def ready(a, _):
        if len(a.split()) == 2:
            raise ValueError("two words")

    def plainly(a, b, config):
        ready(a, config)
        return 0.5 if ord(b[0]) % 3 else 1.0

    def said(a, b, config):
        return plainly(a, b, config)

    said.ready, said.top = ready, 1.0
    best, seen = [], []
    for scorer in (plainly, said):
        seen.append(spark.sparkContext.accumulator(0))
        rows = search.name_scores(asked, search.index_names(index), 0.0, scorer=scorer, tally=seen[-1], most=2).collect()
        best.append([sorted((-r.score, r.index_pos) for r in rows if r.q == q and r.error is None)[:2] for q in range(4)] + [{(r.q, r.error) for r in rows if r.error}])
    assert best[0] == best[1] and best[1][4] == {(2, "two words")} and [len(x) for x in best[1][:4]] == [2, 2, 0, 0]
    assert seen[1].value < seen[0].value / 2


def test_addresses_say_what_names_need(spark, monkeypatch):
    """With one address for all names, entities whose addresses are too far from it are not screened, and rows are those of every pair."""
    from lynceus.operators import trace

    where = [["minsk lenina"], ["oslo"], None, [], ["zz qq", "minsk"], ["xx"]]
    names = [f"{a}{b}" for a in ("ivan", "yvan", "petr") for b in (" smith", " smyth", "")]
    rows = [(k, n, x) for k, (n, x) in enumerate((n, x) for n in names for x in where)]
    place = "array<struct<line1:string,line2:string,city:string,state:string,postal_code:string,country:string>>"
    df = spark.createDataFrame([(k, n, None if x is None else [(None, None, c, None, None, None) for c in x]) for k, n, x in rows], f"pos long, n string, a {place}")
    index = as_entities(df, index_pos=F.col("pos"), id=F.col("pos").cast("string"), name=F.col("n"), entity_type=F.lit("PERSON"), source=F.lit("US_OFAC"), addresses=F.col("a"))
    people = [f"{a} {b}" for a in ("ivan", "ivam", "petra", "olga", "yvan", "iwan", "pjotr") for b in ("smith", "smit", "jones", "smyth", "miller", "smiht")]
    asked = spark.createDataFrame([(i, n, "Minsk" if i else " ", None, None) for i, n in enumerate(people)], "item_pos long, name string, address string, source_f string, type_f string")
    screened, scores = set(), search.name_scores

    def seen(asked, held, *args, **more):
        screened.update(r.index_pos for r in held.collect() if asked.count() > 1)
        return scores(asked, held, *args, **more)

    monkeypatch.setattr(search, "name_scores", seen)
    got = {(r.item_pos, r.index_pos): r.score for r in trace.address_screen(asked, index, 0.8, 1000).collect()}
    want = {}
    for i, a in enumerate(people):
        for k, n, x in rows:
            name = S.name_score(a, n)
            s = name if x is None or not i else (35 * name + 25 * max((S.name_score("minsk", c) for c in x), default=0.0)) / 60
            if s >= 0.8:
                want[i, k] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    assert screened and not screened & {k for k, _, x in rows if x in (["xx"], [])}


def test_breakdown_and_texts(spark):
    index = entities(spark, [("john smith", ["jack"]), ("mary jones", [])])
    wide = index.select(F.struct(*index.columns).alias("e"))
    pairs = wide.select(F.col("e").alias("q")).join(wide.select(F.col("e").alias("i")), F.lit(True))
    out = {(r.q.id, r.i.id): r for r in scoring.breakdown(pairs).withColumn("text", R.explained(F.col("breakdown"))).collect()}
    assert out["0", "0"].breakdown.total == 1.0 and out["0", "0"].text == "Score factors: Primary name match: 100%, Alternative names: " + f"{int(out['0', '0'].breakdown.alt_names * 100)}%. Final weighted score: 100%"
    assert out["0", "1"].breakdown.name < 0.7
    page = R.html_page({"session": "<x>"}, {"name": 0.9}, [{"phase": "<b>", "n": 1, "total_ms": 2}])
    assert "<x>" not in page and "&lt;x&gt;" in page


def test_stream(spark, tmp_path):
    index = entities(spark, [("john smith", None)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"item_pos": i, "request_id": "r", "name": n}) for i, n in enumerate(["John Smith", "Nobody Here", None])))
    q = screened(request_stream(spark, str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"item_pos": 7, "request_id": "r", "name": "  "}))
    import os

    from lynceus.session import shared_folder

    before = set(os.listdir(shared_folder(spark).removeprefix("file://")))
    q = screened(request_stream(spark, str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert set(os.listdir(shared_folder(spark).removeprefix("file://"))) == before  # what a micro-batch wrote is gone with it
    assert {r.item_pos: r.status for r in spark.read.parquet(str(tmp_path / "out")).where("item_pos < 7").collect()} == {0: "SUCCESS", 1: "NO_MATCHES", 2: "NO_MATCHES"}
