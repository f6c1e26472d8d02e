"""Streaming queries: a streaming read of the tables, run until it has caught up."""

from __future__ import annotations

import contextlib
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwarden.plans import inputs as src
from siftwarden.plans.aggregates import _CHAIN_SQL, _LIMIT, _WINDOW
from siftwarden.plans.approvals import _PAIRS_SQL
from siftwarden.plans.detection import SCAN_DECIDE_SQL, probes
from siftwarden.plans.registry import ORACLES, query
from siftwarden.plans.sources import scratch
from siftwarden.sources import readers
from siftwarden.streaming import jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def feed(spark, sf: str, name: str, schema: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: the pattern is on its own name."""
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def request_feed(spark, sf) -> DataFrame:
    return feed(spark, sf, "events", readers.REQUEST_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def caught_up(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream into a table until its input is used up, and read the table."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
    jobs.start(writer, f"{path}/checkpoint", True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("source_request_stream", "SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events")
def source_request_stream(spark, sf):
    rows = request_feed(spark, sf).select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("us"))
    return caught_up(rows, "requests")


def request_messages(spark, sf) -> DataFrame:
    """Conversations as nested requests, each with a phrase in front of its messages."""
    turns = probes(spark, sf)
    nested = turns.groupBy("txn_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return nested.select(
        "txn_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")
    )


BATCHES = 4


@query("stream_scan_decide", SCAN_DECIDE_SQL)
def stream_scan_decide(spark, sf):
    path = scratch(spark, "scan-decide")
    requests = request_messages(spark, sf)
    # A micro-batch is as many files as there are cores, and so as many tasks, however large the table.
    cores = spark.sparkContext.defaultParallelism
    requests.repartition(BATCHES * cores, "txn_id").write.parquet(f"{path}/requests")
    feed_ = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", cores).parquet(f"{path}/requests")
    jobs.scan_and_decide(feed_, src.POLICY, src.SALT, path, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/decisions").select("txn_id", "verdict")


@contextlib.contextmanager
def keyed_state(spark):
    """The state store that keyed state needs, set for as long as the streams run."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def arrivals(rows: DataFrame, slice_of: Column, slices: int, name: str, **streams) -> dict[str, DataFrame]:
    """Rows that arrive slice by slice, and what the streams over them have written in the end.

    After each slice every stream is run until it has caught up and stopped, and goes on
    from its checkpoint with the next: a micro-batch a slice, whatever the number of files.
    A stream is a function of the arriving rows that gives the rows to write, or starts a
    query of its own, given its folder and checkpoint.
    """
    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.select("*", F.coalesce(slice_of, F.lit(0)).alias("slice")).write.partitionBy("slice").parquet(f"{path}/whole")
    whole = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(f"{path}/whole")
    schemas = {}
    for k in range(slices):
        whole.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{path}/in")
        feed_ = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        for key, stream in streams.items():
            made = stream(feed_, f"{path}/{key}", f"{path}/{key}-checkpoint")
            if isinstance(made, DataFrame):
                schemas[key] = made.schema
                writer = made.writeStream.format("parquet").outputMode("append").option("path", f"{path}/{key}")
                made = jobs.start(writer, f"{path}/{key}-checkpoint", True)
            made.awaitTermination()
    return {k: spark.read.schema(schemas[k]).parquet(f"{path}/{k}") if k in schemas else f"{path}/{k}" for k in streams}


def by_time(rows: DataFrame, slices: int) -> Column:
    """The slice of a row when its time range is cut into equal parts."""
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return F.floor((F.unix_micros("ts") - F.lit(low or 0)) * F.lit(slices) / F.lit((high or 0) - (low or 0) + 1)).cast("int")


SLICES = 4
JUDGED = "request_id bigint, identity bigint, ts timestamp, window_start bigint, allowed boolean, remaining bigint, retry_after bigint"


@query("stream_rate_limit", ORACLES["win_rate_limit"])
def stream_rate_limit(spark, sf):
    rows = src.requests(spark, sf)
    made = arrivals(rows, by_time(rows, SLICES), SLICES, "rate-limit", judged=lambda r, out, cp: jobs.judge_rates(r, out, cp, _LIMIT, _WINDOW))
    return jobs.rows_below(spark, made["judged"], JUDGED).drop("ts")


LATE_SECONDS = 3 * 86_400
_SLICE_SQL = f"CASE WHEN event_id % 7 = 0 THEN {SLICES - 1} ELSE (event_id // 3) % {SLICES} END"


@query(
    "stream_late_rows",
    f"""WITH arrived AS (SELECT event_id, ts, {_SLICE_SQL} AS slice FROM events),
    newest AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM arrived GROUP BY slice)
    SELECT event_id, coalesce(ts <= seen - INTERVAL {LATE_SECONDS} SECOND, false) AS late FROM arrived JOIN newest USING (slice)""",
)
def stream_late_rows(spark, sf):
    """Rows in shuffled order of arrival: those on time, as the rate limiter has judged them, and those set aside."""
    slice_of = F.when(F.col("event_id") % 7 == 0, SLICES - 1).otherwise(F.floor(F.col("event_id") / 3) % SLICES).cast("int")
    rows = src.requests(spark, sf)

    def judged(_, out, checkpoint):
        taken = jobs.on_time(spark, f"{posixpath.dirname(out)}/split", rows.schema)
        return jobs.judge_rates(taken, out, checkpoint, _LIMIT, _WINDOW, LATE_SECONDS)

    made = arrivals(
        rows, slice_of, SLICES, "late",
        split=lambda r, out, checkpoint: jobs.split_late(r, out, checkpoint, LATE_SECONDS), judged=judged,
    )
    late = spark.read.schema(rows.schema).parquet(f"{made['split']}/late").select("event_id", F.lit(True).alias("late"))
    taken = jobs.rows_below(spark, made["judged"], JUDGED)
    return taken.select(F.col("request_id").alias("event_id"), F.lit(False).alias("late")).unionByName(late)


@query(
    "stream_idempotency",
    """WITH r AS (SELECT event_id AS request_id, user_id || '-' || event_type || '-' || strftime(ts, '%Y%m%d') AS idempotency_key,
      json_extract_string(props, '$.k')::BIGINT % 3 AS body, ts FROM events),
    f AS (SELECT *, first_value(request_id) OVER w AS owner_id, first_value(body) OVER w AS owned FROM r
      WINDOW w AS (PARTITION BY idempotency_key ORDER BY ts, request_id))
    SELECT request_id, idempotency_key, owner_id,
      CASE WHEN request_id = owner_id THEN 'first' WHEN body = owned THEN 'replayed' ELSE 'conflict' END AS outcome FROM f""",
)
def stream_idempotency(spark, sf):
    """Which request owns a key, and what the others with that key are; a key has the day in it and lives as long."""
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyyMMdd"))
    body = (F.get_json_object("props", "$.k").cast("bigint") % 3).cast("string")
    rows = src.requests(spark, sf).select(F.col("event_id").alias("request_id"), key.alias("idempotency_key"), body.alias("body"), "ts")
    made = arrivals(rows, by_time(rows, SLICES), SLICES, "keys", told=jobs.tell_owners)
    return jobs.rows_below(spark, made["told"], "request_id bigint, idempotency_key string, owner_id bigint, outcome string")


@query(
    "stream_metrics",
    """WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT epoch_us(s) // 1000000 AS start_s, event_type, n FROM w""",
)
def stream_metrics(spark, sf):
    """Every window, those still open at the end included: updates are kept and the last one counts."""
    path = scratch(spark, "metrics")
    jobs.updates(jobs.metrics(request_feed(spark, sf)), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{path}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch_id").alias("n"))
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query(
    "stream_metrics_sliding",
    """WITH w AS (SELECT unnest([epoch_us(ts) // 1800000000 - k FOR k IN range(0, 4)]) * 1800 AS start_s, event_type FROM events)
    SELECT start_s, event_type, count(*) AS n FROM w GROUP BY ALL""",
)
def stream_metrics_sliding(spark, sf):
    """Windows of two hours, one every half hour; the last update of each counts."""
    path = scratch(spark, "metrics")
    counted = jobs.metrics(request_feed(spark, sf), "2 hours", "30 minutes")
    jobs.updates(counted, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{path}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch_id").alias("n"))
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query(
    "stream_metrics_sessions",
    """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 3 HOUR, true)::INT AS fresh FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    closed AS (SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 3 HOUR AS last, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, epoch_us(first) AS start_us, epoch_us(last) AS end_us, n FROM closed
    WHERE last <= (SELECT make_timestamp(epoch_ms(max(ts)) * 1000) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_metrics_sessions(spark, sf):
    """Sessions of each user, closed by three hours without a request; those open at the end are not told."""
    told = caught_up(jobs.metrics(request_feed(spark, sf), gap="3 hours"), "sessions")
    return told.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


EXPIRY_HOUR = 15  # approvals of a day expire then

# A late event, or the watermark passing the deadline, expires an open approval.
_LIVE_SQL = f"""{src.APPROVAL_EVENTS_SQL},
seqs AS (SELECT approval_id, date_trunc('day', min(ts)) + INTERVAL {EXPIRY_HOUR} HOUR AS deadline, count(*) AS n_events,
  list_prepend('PENDING', list(CASE WHEN ts >= date_trunc('day', ts) + INTERVAL {EXPIRY_HOUR} HOUR THEN '!' ELSE '' END || to_state
    ORDER BY ts, seq)) AS path FROM approval_events GROUP BY 1),
folded AS (SELECT approval_id, deadline, n_events, list_reduce(path, lambda s, e:
  CASE WHEN starts_with(e, '!') AND s IN ('PENDING', 'APPROVED') THEN 'EXPIRED'
       WHEN (s || '>' || ltrim(e, '!')) IN ({_PAIRS_SQL}) THEN ltrim(e, '!') ELSE s END) AS state FROM seqs)"""


@query(
    "stream_approvals",
    f"""WITH {_LIVE_SQL} SELECT approval_id, n_events, CASE WHEN state IN ('PENDING', 'APPROVED')
      AND deadline <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE THEN 'EXPIRED' ELSE state END AS state FROM folded""",
)
def stream_approvals(spark, sf):
    rows = request_feed(spark, sf).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("approval_id"),
        "ts", F.col("event_id").alias("seq"), src.case_col("event_type", src.STATE_OF_EVENT).alias("to_state"),
        (F.date_trunc("day", "ts") + F.make_interval(hours=F.lit(EXPIRY_HOUR))).alias("expires_at"),
    )
    path = scratch(spark, "approvals")
    jobs.follow_approvals(rows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    schema = "approval_id string, at bigint, seq bigint, state string"
    changes = jobs.rows_below(spark, f"{path}/out", schema).unionByName(jobs.rows_below(spark, f"{path}/out", schema, "more"))
    return changes.groupBy("approval_id").agg(
        # An expiry row has no seq; nothing leaves the expired state.
        F.coalesce(F.max(F.when(F.col("state") == "EXPIRED", "EXPIRED")), F.max_by("state", F.struct("at", "seq"))).alias("state"),
        F.count("seq").alias("n_events"),
    )


@query("stream_audit_chain", f"{_CHAIN_SQL} SELECT user_id AS stream_id, event_id, prev_hash, event_hash FROM c")
def stream_audit_chain(spark, sf):
    rows = src.requests(spark, sf).select(
        F.col("user_id").alias("stream_id"), "event_id",
        F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("payload"), "ts",
    )
    slice_of = by_time(rows, SLICES)
    with keyed_state(spark):
        made = arrivals(rows, slice_of, SLICES, "chain", chained=lambda r, *_: jobs.audit_chain(r))
    return made["chained"].drop("payload")
