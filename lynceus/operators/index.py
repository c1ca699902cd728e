"""The entity index: an immutable table of entities with a stable position, swapped as a whole."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..schema import as_entities
from ..session import written


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], as_entities(spark.range(0)).schema)


def added(index: DataFrame, more: DataFrame | None) -> DataFrame:
    """Both tables, the new rows behind the old ones; double ids are kept. None adds nothing."""
    if more is None:
        return index
    top = index.agg(F.coalesce(F.max("index_pos"), F.lit(-1))).first()[0]
    low = more.agg(F.coalesce(F.min("index_pos"), F.lit(0))).first()[0]
    return index.unionByName(more.withColumn("index_pos", F.col("index_pos") + F.lit(top + 1 - low)))


def by_source(index: DataFrame, source: str | None) -> DataFrame:
    return index.where(F.lit(False)) if source is None else index.where(F.col("source") == source)


def by_type(index: DataFrame, entity_type: str | None) -> DataFrame:
    return index.where(F.lit(False)) if entity_type is None else index.where(F.col("entity_type") == entity_type)


def by_id(index: DataFrame, id_: str | None) -> DataFrame:
    """The first entity of that id, or none."""
    return index.where(F.lit(False)) if id_ is None else index.where(F.col("id") == id_).orderBy("index_pos").limit(1)


def removed(index: DataFrame, id_: str) -> DataFrame:
    return index.where(~F.col("id").eqNullSafe(F.lit(id_)))


def counts(rows: DataFrame, column: str, values: list[str], name: str = "source") -> DataFrame:
    """(name, n): rows for each of the stated values, noughts included."""
    dim = rows.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")
    n = rows.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    return dim.join(n, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def list_info(index: DataFrame) -> DataFrame:
    return counts(index, "source", W.SOURCES)


def cube_info(index: DataFrame) -> DataFrame:
    """Counts by source and type with subtotals."""
    return index.rollup("source", "entity_type").agg(F.count("*").alias("n"))


class Index:
    """Holds the present table. A refresh builds the new one completely, then swaps the reference: a failed refresh keeps the
    old table, a second refresh at the same time does nothing, and readers never see an empty index."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.table = empty(spark)
        self._busy = threading.Lock()

    def replace(self, entities: DataFrame) -> None:
        self.table = written(entities)

    def add(self, entities: DataFrame | None) -> None:
        self.table = added(self.table, entities)

    def remove(self, id_: str) -> bool:
        there = self.table.where(F.col("id") == id_).limit(1).count() > 0
        self.table = removed(self.table, id_)
        return there

    def clear(self) -> None:
        self.table = empty(self.spark)

    def size(self) -> int:
        return self.table.count()

    def refresh(self, paths: dict) -> bool:
        from ..sources.feeds import read_lists

        if not self._busy.acquire(blocking=False):
            return False
        try:
            self.replace(read_lists(self.spark, paths))
            return True
        finally:
            self._busy.release()
