"""The request operators over a stream: they keep no state, so the same columns serve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.access import understood

SCHEMA = "request_id long, protocol string, query_string string, cookie string"


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as they arrive as parquet files."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def write_understood(requests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Parsed requests, appended as files; each run takes what is there."""
    rows = understood(requests).drop("cookies")
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
