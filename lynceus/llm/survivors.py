"""Best representative of each duplicate group: currency reasoning.

The latest filled value of a field survives. From rows with timestamps the operator learns which states of a record follow which (how full each
field is, how the name is written), over consecutive rows of all groups. Rows of a group are reduced to one for each state and field, so a group is
never larger than the number of states. Known times make a chain of them, learned precedences place the rows without a time, the
surest first; the topologically latest filled element of this partial order gives the value. All groups go this way, whether times are missing
or not: where every time is known the order is that of the times.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written
from .matching import list_id

#: A precedence between two states counts if it is seen so many times as often as its reverse.
LEAST_ODDS = 1.5
MARKERS = ("", "-0-", "n/a", "na", "null", "none", "unknown", "-")
PARTS = ("line1", "line2", "city", "state", "postal_code", "country")


def meant(c: Column) -> Column:
    """The trimmed text, null for blanks and markers."""
    t = F.trim(c)
    return F.when(t.isNotNull() & ~F.lower(t).isin(*MARKERS), t)


def address_fill(addresses: Column) -> Column:
    """Number of filled parts of all addresses."""
    per = F.transform(addresses, lambda a: sum((F.when(meant(a[p]).isNotNull(), 1).otherwise(0) for p in PARTS), F.lit(0)))
    return F.coalesce(F.aggregate(per, F.lit(0), lambda x, y: x + y), F.lit(0))


def text_fill(text: Column) -> Column:
    return F.coalesce(F.length(meant(text)), F.lit(0))


def level(fill: Column) -> Column:
    """Six levels of fullness: logarithmic, so there are few states however long a value is."""
    return F.least(F.lit(5), F.floor(F.log2(fill + F.lit(1.0)))).cast("int")


def learned_precedence(rows: DataFrame, group: list[str], at: str, states: list[str]) -> dict[tuple[str, int, int], float]:
    """Log odds that state v of a field follows state u, from consecutive timestamped rows of one group."""
    timed = rows.where(F.col(at).isNotNull())
    # a group may hold a third of all rows: neighbours are found within a month of it, the months of a group are joined by their ends
    month = F.date_trunc("month", at)
    by = Window.partitionBy(*group, "_month").orderBy(at, "_id")
    inner = timed.withColumn("_month", month).select(*[F.struct(F.lag(s).over(by).alias("u"), F.col(s).alias("v")).alias(s) for s in states])
    ends = timed.withColumn("_month", month).groupBy(*group, "_month").agg(*[F.min_by(s, F.struct(at, "_id")).alias(f"first_{s}") for s in states], *[F.max_by(s, F.struct(at, "_id")).alias(f"last_{s}") for s in states])
    months = Window.partitionBy(*group).orderBy("_month")  # one row a month
    outer = ends.select(*[F.struct(F.lag(f"last_{s}").over(months).alias("u"), F.col(f"first_{s}").alias("v")).alias(s) for s in states])
    long = inner.union(outer).select(F.explode(F.array(*[F.struct(F.lit(s).alias("field"), F.col(s)["u"].alias("u"), F.col(s)["v"].alias("v")) for s in states])).alias("x")).select("x.*")
    n = {(r.field, r.u, r.v): r.n for r in long.where("u IS NOT NULL AND u <> v").groupBy("field", "u", "v").agg(F.count("*").alias("n")).collect()}  # at most 36 a field
    out = {}
    for (f, u, v), k in n.items():
        odds = (k + 0.5) / (n.get((f, v, u), 0) + 0.5)
        if odds >= LEAST_ODDS:
            out[f, u, v] = math.log(odds)
    return out


def topologically_latest(times: list, states: list[tuple[int, ...]], fields: list[str], precedence: dict, filled: list[bool], fullness: list[int], ids: list) -> int | None:
    """Position of the latest filled element: last level of the partial order, then the fullest, then the least id.

    Known times order their elements as a chain; elements without a time are ordered against all others by their learned log odds, the
    surest first; an order that would close a circle is left out. What is reachable is kept as bits, so an order that is implied costs nothing.
    """
    n = len(ids)
    reach = [0] * n  # bits of the elements after this one
    below = [1 << i for i in range(n)]  # this one and all before it

    def put(i: int, j: int) -> None:
        if i == j or reach[i] >> j & 1 or reach[j] >> i & 1:
            return
        after, before = reach[j] | 1 << j, below[i]
        for k in range(n):
            if before >> k & 1:
                reach[k] |= after
            if after >> k & 1:
                below[k] |= before

    levels: dict = defaultdict(list)
    for i, t in enumerate(times):
        if t is not None:
            levels[t].append(i)
    chain = [levels[t] for t in sorted(levels)]
    for earlier, later in zip(chain, chain[1:], strict=False):
        for i in earlier:
            for j in later:
                put(i, j)
    edges = []
    for i in range(n):
        for j in range(n):
            if i != j and (times[i] is None or times[j] is None):
                w = sum(precedence.get((f, states[i][k], states[j][k]), 0.0) - precedence.get((f, states[j][k], states[i][k]), 0.0) for k, f in enumerate(fields))
                if w > 0:
                    edges.append((w, i, j))
    for _, i, j in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        put(i, j)
    depth = [0] * n
    for i in sorted(range(n), key=lambda i: below[i].bit_count()):  # whatever is before an element has fewer before it
        for k in range(n):
            if k != i and below[i] >> k & 1:
                depth[i] = max(depth[i], depth[k] + 1)
    best = [i for i in range(n) if filled[i]]
    return max(best, key=lambda i: (depth[i], fullness[i], -ids[i])) if best else None


def survivors(rows: DataFrame, group: list[str], key: str, at: str, fills: dict[str, Column], further_states: dict[str, Column] | None = None) -> DataFrame:
    """(group columns, group_<key>, <field>_<key> for each field, members): one row a group of two or more rows.

    fills: for each surviving field how full it is, 0 if it isn't filled at all. group_<key> is the least key of the group; a field's
    key is that of the row whose value survives, null where no row has it filled. Rows with a null in a group column belong to
    no group; rows that repeat a key count once; ties in time go to the fullest, then to the least key, as do elements that nothing orders; an
    empty table gives an empty result.
    """
    names = list(fills)
    states = [f"_s_{k}" for k in range(len(fills) + len(further_states or {}))]
    base = rows.dropDuplicates([key]).select(
        *group, F.col(key).cast("long").alias("_id"), F.col(at).alias("_at"), *[c.cast("int").alias(f"_f_{n}") for n, c in fills.items()],
        *[level(c).alias(s) for s, c in zip(states, fills.values(), strict=False)], *[c.cast("int").alias(s) for s, c in zip(states[len(fills):], (further_states or {}).values(), strict=True)],
    )
    for g in group:
        base = base.where(F.col(g).isNotNull())
    base = written(base)
    groups = written(base.groupBy(*group).agg(F.count("*").alias("members"), F.min("_id").alias(f"group_{key}")).where("members > 1"))
    precedence = learned_precedence(base, group, "_at", states)
    some = base.join(groups.select(*group), group)
    # one row for each state of a group and field: the latest of those with a time, the fullest of those without
    per = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"_f_{n}").alias("full")) for n in names])).alias("x")
    long = some.select(*group, "_id", "_at", *states, per).select(*group, "_id", "_at", *states, "x.field", "x.full").where("full > 0")
    one = long.groupBy(*group, "field", *states, F.col("_at").isNull().alias("_none")).agg(F.max_by(F.struct("_id", "_at", "full"), F.struct("_at", "full", (-F.col("_id")).alias("i"))).alias("r"))
    small = one.select(*group, "field", *states, "r.*")

    def reason(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["_id"].tolist()
        times = [None if t is pd.NaT or t != t else t for t in pdf["_at"]]
        st = list(pdf[states].itertuples(index=False, name=None))
        full = pdf["full"].tolist()
        p = 0 if len(ids) == 1 else topologically_latest(times, st, states, precedence, [True] * len(ids), full, ids)
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in group}, "field": [pdf["field"].iloc[0]], "_best": [ids[p]]})

    kinds = ", ".join(f"`{g}` {rows.select(g).schema[0].dataType.simpleString()}" for g in group)
    # groups of a single state need no order
    lone = small.groupBy(*group, "field").agg(F.count("*").alias("n"), F.first("_id").alias("_best")).where("n = 1").drop("n")
    rest = small.join(lone.select(*group, "field"), [*group, "field"], "left_anti")
    best = lone.unionByName(rest.groupBy(*group, "field").applyInPandas(reason, f"{kinds}, field string, _best long"))
    chosen = best.groupBy(*group).agg(*[F.max(F.when(F.col("field") == n, F.col("_best"))).alias(f"{n}_{key}") for n in names])
    return groups.join(chosen, group, "left").select(*group, f"group_{key}", *[f"{n}_{key}" for n in names], "members")


def entity_survivors(entities: DataFrame) -> DataFrame:
    """Survivors of the groups of rows with one list and one id of that list, however it is formatted."""
    rows = entities.withColumn("_list_id", list_id(F.col("source_id"))).where("_list_id <> ''")
    letters = F.regexp_replace(F.coalesce("name", F.lit("")), r"[^\p{L}]", "")
    writing = {"case": F.when(letters == F.upper(letters), 2).when(letters == F.lower(letters), 0).otherwise(1), "programs": level(text_fill(F.col("programs")))}
    return survivors(rows, ["source_list", "_list_id"], "record_id", "updated_at", {"addresses": address_fill(F.col("addresses")), "remarks": text_fill(F.col("remarks"))}, writing)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each group of entities rows with the same list and the same source id."""
    return entity_survivors(table(spark, folder, "entities")).select("group_record_id", "addresses_record_id", "remarks_record_id")


def masked_agreement(entities: DataFrame, share: float = 0.3) -> DataFrame:
    """(field, groups, same, recall): how often the survivors are those that the full times give when a share of the times is taken away.

    What the times of a group say is held back by a hash of the record id; groups that keep all their times aren't counted.
    """
    hidden = F.pmod(F.xxhash64(F.lit("mask"), "record_id"), F.lit(1000)) < F.lit(int(share * 1000))
    names = ("addresses", "remarks")
    known = written(entity_survivors(entities))
    masked = entities.withColumn("updated_at", F.when(~hidden, F.col("updated_at")))
    told = written(entity_survivors(masked))
    keys = ["source_list", "_list_id"]
    open_ = masked.withColumn("_list_id", list_id(F.col("source_id"))).where("updated_at IS NULL").select(*keys).distinct()
    both = known.join(open_, keys, "left_semi").join(told.select(*keys, *[F.col(f"{n}_record_id").alias(f"{n}_told") for n in names]), keys)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}_record_id").alias("want"), F.col(f"{n}_told").alias("got")) for n in names])).alias("x")).select("x.*").where("want IS NOT NULL")
    out = long.groupBy("field").agg(F.count("*").alias("groups"), F.count_if(F.col("want") == F.col("got")).alias("same"))
    return out.withColumn("recall", F.round(F.try_divide("same", "groups"), 4))


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Survivors where three tenths of the times are hidden, against those of the full times."""
    return masked_agreement(table(spark, folder, "entities"))
