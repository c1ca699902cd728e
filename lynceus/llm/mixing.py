"""Mixing sources to target weights: entropy balancing.

Each document has a rate, its expected number of copies. Rates stay as near as can be, in relative entropy, to one common
rate while each source's tokens meet its target: the solution is an exponential tilt, rate = min(cap, base * exp(lambda *
tokens)), with one dual variable a source. The convex dual is solved by Newton steps, each one aggregation over a
table of (source, tokens) counts; a step that leaves the bracket of its variable is replaced by a bisection.
Rates become copies by systematic rounding within buckets sorted by size; what a few long documents then miss of a source's tokens is
made up by single copies of shorter ones, an equal part in each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread, table, written
from .tokens import sized

STEPS = 60
TOLERANCE = 1e-6
BUCKET_ROWS = 8192
#: The share of the largest feasible total that is aimed at: at 1.0 the scarcest source would need an endless tilt.
OF_FEASIBLE = 0.98


def balanced_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None, of_feasible: float = OF_FEASIBLE) -> tuple[dict[str, dict], float]:
    """Tilts per source and the total number of tokens aimed at.

    sizes: (source, n_tokens, n): counts; targets: (source, target_share, max_repeats), a few rows. Shares are scaled to sum
    to 1 over the sources that have tokens; rows of null or non-positive share or repeats take no part. Newton steps that leave their
    bracket, and all steps after STEPS, halve the bracket, so the iteration ends.
    """
    goal = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.collect() if r.source is not None and r.target_share and r.target_share > 0 and r.max_repeats and r.max_repeats > 0}
    sums = {r.source: r for r in sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("t")).where(F.col("source").isin(list(goal))).collect()}  # one row a target
    goal = {s: g for s, g in goal.items() if s in sums and sums[s].t > 0}
    if not goal:
        return {}, 0.0
    scale = sum(g[0] for g in goal.values())
    feasible = min(cap * sums[s].t / (share / scale) for s, (share, cap) in goal.items())
    aim = min(total or math.inf, feasible * of_feasible)
    base = aim / sum(sums[s].t for s in goal)
    state = {}
    for s, (share, cap) in goal.items():
        state[s] = {"want": aim * share / scale, "cap": cap, "base": min(base, cap), "mean": sums[s].t / sums[s].n, "lam": 0.0, "lo": -60.0, "hi": 60.0, "done": False}
    spark = sizes.sparkSession
    for turn in range(2 * STEPS):
        open_ = {s: x for s, x in state.items() if not x["done"]}
        if not open_:
            break
        now = spark.createDataFrame([(s, x["lam"], x["mean"], float(x["cap"]), x["base"]) for s, x in open_.items()], "source string, lam double, mean double, cap double, base double")
        raw = F.col("base") * F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.lit(500.0)))
        rate = F.least(F.col("cap"), raw)
        mass = F.col("n") * F.col("n_tokens") * rate
        got = sizes.join(F.broadcast(now), "source").groupBy("source").agg(
            F.sum(mass).alias("t"), F.sum(F.when(raw < F.col("cap"), mass * F.col("n_tokens") / F.col("mean")).otherwise(0.0)).alias("d")
        )
        for r in got.collect():  # one row a target
            x = state[r.source]
            miss = r.t - x["want"]
            if abs(miss) <= TOLERANCE * x["want"] or x["hi"] - x["lo"] < 1e-12:
                x["done"] = True
                continue
            x["hi" if miss > 0 else "lo"] = x["lam"]
            step = x["lam"] - miss / r.d if r.d > 0 else math.nan
            x["lam"] = step if turn < STEPS and x["lo"] < step < x["hi"] else (x["lo"] + x["hi"]) / 2
    late = [s for s, x in state.items() if not x["done"]]
    if late:
        raise ArithmeticError(f"no tilt found for {late}")
    return state, aim


def mixed(documents: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None, of_feasible: float = OF_FEASIBLE) -> DataFrame:
    """(key, source, n_tokens, rate, copies, mended): documents with at least one copy; mended: copies added (1) or taken (-1) after the rounding.

    documents: (key, source, n_tokens). Copies never exceed the source's max_repeats. Documents of null or unlisted source, or
    without tokens, are not used; repeated keys are documents of their own; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key), "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    sizes = written(rows.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    state, _ = balanced_rates(sizes, targets, total, of_feasible)
    if not state:
        return rows.where(F.lit(False)).select(key, "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"), F.lit(0).alias("mended"))
    tilt = spark.createDataFrame([(s, x["lam"], x["mean"], float(x["cap"]), x["base"]) for s, x in state.items()], "source string, lam double, mean double, cap double, base double")
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(F.col(key), "n_tokens"), F.lit(buckets))
    rate = F.least(F.col("cap"), F.col("base") * F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.lit(500.0))))
    rated = rows.join(F.broadcast(tilt), "source").withColumn("rate", rate).withColumn("_b", bucket)
    within = Window.partitionBy("source", "_b").orderBy("n_tokens", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.pmod(F.xxhash64("source", "_b"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    upto = F.sum("rate").over(within) + start
    copies = F.greatest(F.lit(0), F.least(F.floor(upto) - F.floor(upto - F.col("rate")), F.ceil("rate"), F.col("cap"))).cast("int")
    rounded = written(rated.select(key, "source", "n_tokens", "rate", "cap", "_b", copies.alias("copies")))
    got = {r.source: r.t for r in rounded.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}  # one row a target
    used = {r.source: r.k for r in rounded.groupBy("source").agg(F.countDistinct("_b").alias("k")).collect()}
    rooms = spark.createDataFrame([(x, (state[x]["want"] - t) / used[x]) for x, t in got.items()], "source string, room double")
    more = F.col("room") > 0
    # only documents well below what is missing, so that the last one that fits leaves little
    can = (F.col("n_tokens") * 4 <= F.abs("room")) & F.when(more, F.col("copies") < F.col("cap")).otherwise(F.col("copies") > 0)
    order = Window.partitionBy("source", "_b").orderBy(F.xxhash64(F.lit(1), F.col(key)), key, "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.sum(F.when(can, F.col("n_tokens")).otherwise(0)).over(order)
    step = F.when(can & (filled <= F.abs("room")), F.when(more, 1).otherwise(-1)).otherwise(0)
    mended = rounded.join(F.broadcast(rooms), "source").withColumn("mended", step.cast("int")).withColumn("copies", F.col("copies") + F.col("mended"))
    return mended.where("copies > 0").select(key, "source", "n_tokens", F.round("rate", 9).alias("rate"), "copies", "mended")


def share_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: documents, copies, tokens, documents mended after the rounding, the share reached and the share wanted."""
    got = selection.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"), F.sum(F.abs("mended")).alias("mended"))
    # one row a target, so the window is over a handful of rows
    out = targets.join(got, "source", "left").withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    zero = {c: 0 for c in ("documents", "copies", "tokens", "most_copies", "mended")}
    return out.fillna(zero).select("source", "target_share", "max_repeats", *zero, F.round(F.coalesce(F.try_divide("tokens", "_all"), F.lit(0.0)), 6).alias("actual_share"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return written(sized(spread(table(spark, folder, "documents").select("doc_id", "source", "text")), ["doc_id", "source"]))


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of each document of the mixture of the seven sources."""
    return mixed(_sized(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return share_report(written(p9_selection(spark, folder)), table(spark, folder, "mix_targets"))
