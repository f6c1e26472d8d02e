"""Audit log jobs: hash chains, traces, export, completeness, retention."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwarden import domains as d
from siftwarden.functions.hashing import chained_hash, genesis_hash, json_string
from siftwarden.functions.ordered import with_previous

GENESIS = "sha256:" + sha256(b"").hexdigest()


def decision_payload() -> Column:
    """Canonical JSON payload of a ``decision`` event: sorted keys, ASCII only.

    Uses the columns of a decisions table; content never enters a payload.
    """

    def text_array(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(items), json_string), ","), F.lit("]"))

    rules = F.transform("policy_hits", lambda h: h["rule_id"])
    return F.concat(
        F.lit('{"degraded":'), F.col("degraded").cast("string"),
        F.lit(',"mode":'), json_string(F.col("mode")),
        F.lit(',"policy_hits":'), text_array(rules),
        F.lit(',"policy_version":'), json_string(F.col("policy_version")),
        F.lit(',"reason_codes":'), text_array(F.col("reason_codes")),
        F.lit(',"risk_level":'), json_string(F.col("risk_level")),
        F.lit(',"transformation":'), json_string(F.col("transformation")),
        F.lit(',"verdict":'), json_string(F.col("verdict")), F.lit("}"),
    )


def chain_hash(last: str, payload: str) -> str:
    return "sha256:" + sha256((last + payload).encode()).hexdigest()


def build_chain(
    events: DataFrame, stream: str = "stream_id", order: str = "event_id", seeds: DataFrame | None = None
) -> DataFrame:
    """Chain the events of each stream: adds prev_hash and event_hash.

    Each hash needs the one before it, so a stream is inherently sequential. It
    is read once in order and only the last hash is held, never the stream.
    ``seeds`` (stream, seed) holds the last hash of streams that go on.
    """
    if seeds is not None:
        events = events.join(seeds, stream, "left")
    else:
        events = events.withColumn("seed", F.lit(None).cast("string"))
    parts = events.repartition(stream).sortWithinPartitions(stream, order)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, GENESIS
        for batch in batches:
            before, after = [], []
            rows = zip(batch[stream], batch["payload"], batch["seed"], strict=True)
            for key, payload, seed in rows:
                if key != current:
                    current, last = key, seed or GENESIS
                before.append(last)
                last = chain_hash(last, payload)
                after.append(last)
            yield batch.drop(columns="seed").assign(prev_hash=before, event_hash=after)

    kept = [f for f in parts.schema.fields if f.name != "seed"]
    added = [T.StructField(n, T.StringType()) for n in ("prev_hash", "event_hash")]
    return parts.mapInPandas(chain, T.StructType(kept + added))


def broken_links(
    chained: DataFrame, stream: str = "stream_id", order: str = "event_id", slice_of: Column | None = None
) -> DataFrame:
    """Rows whose own hash or whose link to the row before does not hold.

    The own hash is checked row by row. For the link a stream is cut into slices
    (``slice_of``, growing with the order), so a hot stream is not sorted in one
    task; the last hash of each slice is carried over to the next one that has
    rows.
    """
    linked = with_previous(
        chained, [stream], [order], "event_hash", slice_of if slice_of is not None else F.lit(0), "_before"
    )
    bad_link = F.col("prev_hash") != F.coalesce("_before", genesis_hash())
    bad_hash = F.col("event_hash") != chained_hash(F.col("prev_hash"), F.col("payload"))
    return linked.where(bad_link | bad_hash).select(
        stream, order, bad_link.alias("bad_link"), bad_hash.alias("bad_hash")
    )


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(text: str) -> Column:
    """A time given as RFC 3339 with ``Z`` or as a bare ISO string."""
    bare = text.strip()
    return F.to_timestamp(F.lit(bare[:-1] if bare.endswith("Z") else bare))


def export_rows(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Audit events of a time range, bounds included, with stable columns."""
    rows = events
    if since is not None:
        rows = rows.where(F.col("created_at") >= parse_time(since))
    if until is not None:
        rows = rows.where(F.col("created_at") <= parse_time(until))
    return rows.select(*d.AUDIT_COLUMNS)


def export_lines(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """The export as ordered JSON lines with sorted keys.

    ``payload`` holds JSON text and is written as a nested object.
    """
    rows = export_rows(events, since, until).orderBy("created_at", "id")

    def value(name: str) -> Column:
        if name == "created_at":
            return json_string(rfc3339(F.col(name)))
        if name == "payload":
            return F.coalesce("payload", F.lit("null"))
        return json_string(F.col(name).cast("string"))

    parts = [
        F.concat(F.lit(f'"{name}": '), value(name)) for name in sorted(d.AUDIT_COLUMNS)
    ]
    return rows.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))


def trace(events: DataFrame) -> DataFrame:
    """One row per transaction: how many events of each kind and the time span."""
    return events.groupBy("transaction_id").agg(
        F.count_if(F.col("event_type") == "decision").alias("decisions"),
        F.count_if(F.col("approval_id").isNotNull()).alias("approval_events"),
        F.count_if(F.col("event_type").startswith("RESUME")).alias("resume_events"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def not_decided_once(transactions: DataFrame, events: DataFrame) -> DataFrame:
    """Transactions without exactly one ``decision`` event, with their count."""
    counts = (
        events.where(F.col("event_type") == "decision")
        .groupBy("transaction_id")
        .agg(F.count("*").alias("n_decisions"))
    )
    return (
        transactions.select("transaction_id")
        .join(counts, "transaction_id", "left")
        .withColumn("n_decisions", F.coalesce("n_decisions", F.lit(0)))
        .where(F.col("n_decisions") != 1)
    )


def keep_for_mode(mode: str) -> tuple[bool, bool, bool]:
    """What a retention mode keeps: (offsets and hashes, categories, content)."""
    return mode != "none", True, mode in ("encrypted", "full")


def project_retention(findings: DataFrame, mode: str) -> DataFrame:
    """Blank the columns a retention mode does not keep."""
    evidence, _, content = keep_for_mode(mode)
    out = findings
    for name in ("start", "end", "excerpt_hash"):
        if not evidence and name in out.columns:
            out = out.withColumn(name, F.lit(None).cast(dict(out.dtypes)[name]))
    if not content and "text" in out.columns:
        out = out.withColumn("text", F.lit(None).cast("string"))
    return out


DROPPED_AT_ONCE = 200
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def dated_table(df: DataFrame, name: str, created: str = "created_at", unit: str = "day") -> None:
    """Write rows as a table of partitions by ``day`` (or by ``month``, where days are small), for ``purge_dated``.

    A partition bears its first day; rows without a time are in the null day. Spark sizes
    the files, so that a day with very many rows is written by many tasks.
    """
    first = F.trunc(F.to_date(created), "MM") if unit == "month" else F.to_date(created)
    df.withColumn("day", first).hint("rebalance", "day").write.partitionBy("day").saveAsTable(name)


def purge_dated(spark: SparkSession, name: str, oldest: datetime.datetime, created: str = "created_at", unit: str = "day") -> int:
    """Drop what a table of ``dated_table`` holds from before ``oldest``: the number of partitions dropped.

    Partitions that end before it are dropped whole, without reading them. Only the one it
    falls in is read, and only that one's files are written anew; all others stay as they
    are. Rows without a time are kept. Doing it again changes nothing, and a purge that is
    cut short between its steps is made whole by the next one: the border is overwritten as
    one partition, and each drop stands by itself.
    """
    border = oldest.date().replace(day=1) if unit == "month" else oldest.date()
    day = F.col("day") == F.lit(border)
    keep = spark.table(name).where(day & (F.col(created) >= F.lit(oldest)))
    if not spark.table(name).where(day & (F.col(created) < F.lit(oldest))).isEmpty():
        if keep.isEmpty():
            border += datetime.timedelta(days=1)
        else:
            before = spark.conf.get(OVERWRITE)
            spark.conf.set(OVERWRITE, "dynamic")  # only the partition of these rows is replaced, when all is written
            try:
                keep.write.insertInto(name, overwrite=True)
            finally:
                spark.conf.set(OVERWRITE, before)
    # Names of partitions only: a few bytes for each there is.
    days = [r[0].removeprefix("day=") for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    gone = sorted(day for day in days if day < border.isoformat())
    for at in range(0, len(gone), DROPPED_AT_ONCE):
        specs = ", ".join(f"PARTITION (day = DATE '{day}')" for day in gone[at : at + DROPPED_AT_ONCE])
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {specs}")
    return len(gone)


def allowlist_fields(logs: DataFrame, fields: str = "fields") -> DataFrame:
    """Keep only the permitted keys of a map of log fields."""
    return logs.withColumn(fields, F.map_filter(fields, lambda k, _: k.isin(*d.LOG_FIELDS)))
