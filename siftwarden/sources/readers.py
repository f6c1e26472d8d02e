"""Reading requests, corpora and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_SCHEMA = """
case_id string, category string, direction string, description string,
payload struct<messages: array<struct<role: string, content: string>>,
               tools: array<struct<type: string, function: struct<name: string, parameters: string>>>>,
response string,
expected_verdict string, expected_transformation string,
expected_reason_codes array<string>, expected_policy_hits array<string>,
_corrupt_record string
"""

REQUEST_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Nested chat requests, one JSON object per line; content and parameters stay open.

    Fields beyond the known ones are ignored, as they do not affect inspection.
    """
    return spark.read.schema(
        """txn_id string, model string,
        messages array<struct<role: string, content: variant>>,
        tools array<struct<type: string, function: struct<name: string, parameters: string>>>"""
    ).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus, one JSON case per line; broken lines are kept as such."""
    return (
        spark.read.schema(CORPUS_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A continuous feed of request events from a folder of parquet files."""
    rows = (
        spark.readStream.schema(REQUEST_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A continuous feed of conversation turns from a folder of parquet files."""
    return (
        spark.readStream.schema("conv_id bigint, turn bigint, role string, text string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
