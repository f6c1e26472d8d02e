"""Written intermediates, batch bounds and values kept in a Python worker."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

from siftwarden.session import checkpoint_root

BATCH_BYTES = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds by bytes as well as by rows, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def worker_cache(name: str) -> dict:
    """A dict that outlives a task in its Python worker.

    Functions travel by value, so their module's globals are new in every task.
    """
    module = sys.modules.setdefault("_siftwarden_worker", types.ModuleType("_siftwarden_worker"))
    return module.__dict__.setdefault(name, {})
