"""Screening of incoming names: a stateless stream against the present index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.search import batch
from ..session import scratch

SCHEMA = "item_pos long, request_id string, name string, entity_type string, source string"


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Requests from JSON files as they arrive."""
    return spark.readStream.schema(SCHEMA).json(folder)


def screened(stream: DataFrame, index: DataFrame, out: str, checkpoint: str, min_match: float = 0.88, limit: int = 10):
    """Starts the query. Each micro-batch is screened like a bulk batch and written under its number, so a batch that is run again
    after a failure replaces its own output and nothing is written twice. What a micro-batch wrote to the shared folder is deleted with it."""

    def one(df: DataFrame, number: int) -> None:
        with scratch(df.sparkSession):
            batch(df, index, min_match, limit, most=None).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
