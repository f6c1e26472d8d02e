"""Writing findings, decisions and audit lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from siftwarden.session import checkpoint_root


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: worked out once, and safe from lost executors."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append a result table, optionally partitioned by a date column."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the output of one micro-batch so that doing it again changes nothing.

    Every batch has its own folder, which a retry overwrites.
    """
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_audit_jsonl(
    events: DataFrame, path: str, since: str | None = None, until: str | None = None
) -> None:
    """Export audit events as JSON lines in time order, as text files.

    The sort is a range sort over the cluster; file names follow the order.
    """
    from siftwarden.operators.audit import export_lines

    export_lines(events, since, until).write.mode("overwrite").text(path)
