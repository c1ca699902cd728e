"""What changed between consecutive full snapshots of a table.

Content-defined chunks: rows are key-sorted once; a key whose hash has its low bits zero opens a chunk, so a
chunk's borders depend on keys alone and an insertion moves none but its own. Each snapshot has one digest a chunk.
Chunks whose digest equals that of the snapshot before are discarded; only rows of the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.script import same_look
from ..session import written

CHUNK_KEYS = 64


@F.pandas_udf(T.StringType())
def same_look_column(s: pd.Series) -> pd.Series:
    known: dict = {}
    return s.map(lambda x: known[x] if x in known else known.setdefault(x, same_look(x)))


def code_set(codes: Column) -> Column:
    """Codes as a sorted set: case, white space, order and repetition don't matter; null and blank codes vanish."""
    tidy = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))))
    return F.array_sort(F.array_distinct(F.filter(tidy, lambda c: c.isNotNull() & (c != ""))))


def chunked(rows: DataFrame, space: str, key: str, snapshot: str, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """Adds ``chunk``, the key that opened the row's chunk; rows arrive sorted by (space, key) in their partition.

    A partition's first key opens a chunk too: all snapshots of a key are in one partition, so that border is theirs alike.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.StringType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, opened = None, None
        for pdf in batches:
            chunk = []
            for s, k, border in zip(pdf[space], pdf[key], pdf["_border"], strict=True):
                if s != at or border or opened is None:
                    at, opened = s, k
                chunk.append(opened)
            yield pdf.assign(chunk=chunk)

    marked = rows.withColumn("_border", F.pmod(F.xxhash64(space, key), F.lit(chunk_keys)) == 0)
    schema = T.StructType([*marked.schema.fields, T.StructField("chunk", T.StringType())])
    return marked.repartitionByRange(space, key).sortWithinPartitions(space, key, snapshot).mapInPandas(assign, schema).drop("_border")


def snapshot_changes(
    snapshots: DataFrame, space: str, key: str, snapshot: str, states: dict[str, Column], chunk_keys: int = CHUNK_KEYS
) -> DataFrame:
    """(snapshot, space, key, change_kind): keys added, removed or changed against the same space's snapshot before.

    snapshots: rows of all snapshots; several rows may share a key, their states then form a set. states: named
    canonical values; a key is changed where the set of any of them differs. A space has a snapshot where it has rows, so a
    skipped delivery is compared across. Rows without key, space or snapshot belong to nothing and are left out;
    an empty table gives an empty result; further columns are ignored.
    """
    base = snapshots.where(F.col(key).isNotNull() & F.col(space).isNotNull() & F.col(snapshot).isNotNull())
    state = F.xxhash64(*[F.to_json(F.struct(c.alias("v"))) for c in states.values()])
    rows = (
        base.select(F.col(snapshot).alias("_no"), F.col(space).alias("_space"), F.col(key).cast("string").alias("_key"), state.alias("_state"))
        .distinct()  # repeats vanish map-side, before the shuffle by key
        .groupBy("_space", "_key", "_no")
        .agg(F.sum(F.col("_state").cast("decimal(38,0)")).cast("string").alias("_sum"), F.bit_xor("_state").alias("_xor"))
        .select("_space", "_key", "_no", F.xxhash64("_sum", "_xor").alias("_state"))
    )
    rows = written(chunked(rows, "_space", "_key", "_no", chunk_keys))
    row_hash = F.xxhash64("_key", "_state")
    digests = rows.groupBy("_space", "chunk", "_no").agg(
        F.count("*").alias("n"), F.sum(row_hash.cast("decimal(38,0)")).cast("string").alias("s"), F.bit_xor(row_hash).alias("x")
    )
    # snapshots of one space: few numbers each, whatever the number of rows
    numbers = digests.select("_space", "_no").distinct()
    before = numbers.withColumn("_before", F.lag("_no").over(Window.partitionBy("_space").orderBy("_no"))).where("_before IS NOT NULL")
    new = digests.join(before, ["_space", "_no"])
    old = digests.withColumnRenamed("_no", "_before").join(before, ["_space", "_before"])
    digest = ["n", "s", "x"]
    same = new.join(old, ["_space", "chunk", "_no", "_before", *digest]).select("_space", "chunk", "_no", F.lit(True).alias("_same"))
    suspect = (
        new.select("_space", "chunk", "_no", "_before").union(old.select("_space", "chunk", "_no", "_before")).distinct()
        .join(same, ["_space", "chunk", "_no"], "left").where("_same IS NULL").drop("_same")
    )
    left = rows.join(suspect, ["_space", "chunk", "_no"]).select("_space", "_no", "_key", F.col("_state").alias("_new"))
    right = rows.withColumnRenamed("_no", "_before").join(suspect, ["_space", "chunk", "_before"]).select("_space", "_no", "_key", F.col("_state").alias("_old"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return (
        left.join(right, ["_space", "_no", "_key"], "full").withColumn("change_kind", kind).where("change_kind IS NOT NULL")
        .select(F.col("_no").alias(snapshot), F.col("_space").alias(space), F.col("_key").alias(key), "change_kind")
    )
