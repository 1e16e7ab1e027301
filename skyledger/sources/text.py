"""Text tables: bar-delimited dumps and result files with a preamble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bar_dump(rows: DataFrame, path: str) -> None:
    """Bars between the values and behind the last."""
    line = F.concat(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit("|"))
    rows.select(line.alias("value")).write.text(path)


def scan_bar_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "|").schema(f"{schema}, _end string").csv(path).drop("_end")


def write_result_csv(rows: DataFrame, path: str, key: str) -> None:
    """A table with rows of types, units and null marks before the values, as the search server gives them."""
    text = rows.select([F.col(c).cast("string") for c in rows.columns])
    head = rows.sparkSession.createDataFrame([tuple(t for _, t in rows.dtypes), ("",) * len(rows.columns), ("null",) * len(rows.columns)], text.schema)
    head.unionByName(text).write.option("header", True).csv(path)


def scan_result_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows whose key is a number; those of the preamble are not."""
    rows = spark.read.option("header", True).csv(path)
    return rows.where(F.col(key).try_cast("long").isNotNull())
