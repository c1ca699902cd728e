"""Filling fixed-capacity containers with items: minimum bin slack.

Items are spread over groups of about ``GROUP_ITEMS`` by hash. In a group, each container is opened by the largest item
left; a bitset subset-sum over the multiset of remaining lengths finds the filling nearest to capacity, and the counts
of each length are traced back. Only a group's last containers can stay open, so slack does not grow with the data.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table, width, written
from .tokens import TOKENIZERS, sized

GROUP_ITEMS = 4096


def nearest_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to ``room`` as can be without exceeding it.

    Bit s of an integer says that sum s can be reached. Each length enters as 1, 2, 4, ... copies; what was reachable
    before each step is kept, and the steps that the best sum needs are read backwards from it.
    """
    if room <= 0:
        return {}
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in counts if 0 < s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left > 0:
            n = min(take, left)
            steps.append((size, n, reach))
            reach |= (reach << size * n) & full
            left -= n
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for size, n, before in reversed(steps):
        if not before >> at & 1:
            used[size] += n
            at -= size * n
    return dict(used)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item positions; every size is from 1 to capacity."""
    by_size: dict[int, list[int]] = defaultdict(list)
    for k, s in enumerate(sizes):
        by_size[s].append(k)
    counts = {s: len(v) for s, v in by_size.items()}
    order = sorted(counts, reverse=True)
    out, first = [], 0
    while True:
        while first < len(order) and not counts.get(order[first]):
            first += 1
        if first == len(order):
            return out
        seed = order[first]
        took = Counter({seed: 1})
        counts[seed] -= 1
        took.update(nearest_filling(counts, capacity - seed))
        container = []
        for s, n in took.items():
            counts[s] -= n - (s == seed)
            container += [by_size[s].pop() for _ in range(n)]
            if counts[s] <= 0:
                counts.pop(s)
        out.append(container)


def packed(items: DataFrame, settings: DataFrame, key: str = "doc_id", size: str = "n_tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """(setting_id, group_no, container_no, key, piece_no, token_from, n_tokens): the content of each container.

    items: (key, size); settings: (setting_id, capacity_tokens), a few rows. An item larger than the capacity is cut into
    full containers and one rest, which is packed like any item; no other item is cut. Items of null or no size take no
    room and are in no container; settings of null or non-positive capacity are passed over; repeated keys are items
    of their own; an empty table gives an empty result.
    """
    chosen = [(int(r[0]), int(r[1])) for r in settings.select("setting_id", "capacity_tokens").distinct().collect() if r[1] and r[1] > 0]  # fixed small table
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("_key"), F.col(size).cast("int").alias("_size")).where("_size > 0")
    n = rows.count()
    groups = max(1, math.ceil(n / group_items))
    kind = items.schema[key].dataType.simpleString()
    schema = f"setting_id int, group_no int, container_no int, `{key}` {kind}, piece_no int, token_from int, n_tokens int"
    if not chosen:
        return spark.createDataFrame([], schema)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        group, out = int(pdf["_group"].iloc[0]), []
        pdf = pdf.sort_values(["_size", "_key"])
        for setting, capacity in chosen:
            whole, rest = [], []
            for k, s in zip(pdf["_key"], pdf["_size"], strict=True):
                full, left = divmod(s, capacity) if s > capacity else (0, s)
                whole += [(k, p, p * capacity, capacity) for p in range(full)]
                if left:
                    rest.append((k, full, full * capacity, left))
            containers = [[x] for x in whole] + [[rest[p] for p in c] for c in pack([x[3] for x in rest], capacity)]
            out += [(setting, group, c, *x) for c, content in enumerate(containers) for x in content]
        return pd.DataFrame(out, columns=["setting_id", "group_no", "container_no", key, "piece_no", "token_from", "n_tokens"])

    grouped = rows.withColumn("_group", F.pmod(F.xxhash64("_key", "_size"), F.lit(groups)).cast("int"))
    # few bytes but much work: a stated number of tasks isn't coalesced
    return grouped.repartition(min(groups, width(spark)), "_group").groupBy("_group").applyInPandas(fill, schema)


def fill_report(content: DataFrame, settings: DataFrame) -> DataFrame:
    """Per setting: containers, tokens and the share of their room that is filled."""
    per = content.groupBy("setting_id").agg(F.countDistinct("group_no", "container_no").alias("containers"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return per.join(settings.select("setting_id", "capacity_tokens"), "setting_id").withColumn("filled_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of documents in the containers of each pack setting."""
    items = written(sized(spread(table(spark, folder, "documents").select("doc_id", "text")), ["doc_id"], TOKENIZERS))
    return packed(items, table(spark, folder, "pack_settings"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p8_packing(spark, folder), table(spark, folder, "pack_settings"))
