"""Approval workflow queries."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions.hashing import sha256_tag
from siftwarden.functions.regex import literal
from siftwarden.operators import approvals as ap
from siftwarden.operators import audit
from siftwarden.plans import inputs as src
from siftwarden.plans.joins import REQUESTS_SQL, decision_requests
from siftwarden.plans.registry import query
from siftwarden.session import checkpoint_root
from siftwarden.sources.readers import table


@query(
    "approvals_create",
    f"""WITH {src.DECISIONS_SQL} SELECT 'apr_' || txn_id AS approval_id, txn_id AS transaction_id, 'PENDING' AS state, risk_level, reasons,
      (SELECT string_agg(rule_id, ',' ORDER BY position) FROM hits h WHERE h.txn_id = d.txn_id AND h.verdict = 'NEED_APPROVAL') AS rules,
      o_custkey AS creator, epoch_us(o_orderdate) // 1000000 + {d.APPROVAL_TTL_SECONDS} AS expires_s
    FROM decisions d JOIN orders ON o_orderkey = txn_id WHERE verdict = 'NEED_APPROVAL'""",
)
def approvals_create(spark, sf):
    made = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("creator"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        sha256_tag(F.col("o_orderpriority")).alias("material_hash"),
    )
    held = ap.create(src.decisions(spark, sf).join(made, "txn_id"))
    return held.select(
        "approval_id", "transaction_id", "state", "risk_level", F.array_join("reason_codes", ",").alias("reasons"),
        F.array_join("policy_hits", ",").alias("rules"), "creator", F.unix_seconds("expires_at").alias("expires_s"),
    )


_PAIRS_SQL = ", ".join(f"'{a}>{b}'" for a, b in d.APPROVAL_EDGES)
_STEP_SQL = f"lambda s, e: CASE WHEN (s || '>' || e) IN ({_PAIRS_SQL}) THEN e ELSE s END"
_REPLAY_SQL = f"""{src.APPROVAL_EVENTS_SQL},
seqs AS (SELECT approval_id, list_prepend('PENDING', list(to_state ORDER BY ts, seq)) AS path, count(*) AS n_events
  FROM approval_events GROUP BY 1),
folded AS (SELECT approval_id, n_events, list_reduce(path, {_STEP_SQL}) AS state FROM seqs)"""


@query("approvals_replay", f"WITH {_REPLAY_SQL} SELECT approval_id, state, n_events FROM folded")
def approvals_replay(spark, sf):
    return ap.replay(src.approval_events(spark, sf)).drop("n_rejected")


@query(
    "approvals_illegal",
    f"""WITH {src.APPROVAL_EVENTS_SQL},
    k AS (SELECT approval_id, seq, to_state, list(to_state) OVER (PARTITION BY approval_id ORDER BY ts, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM approval_events),
    l AS (SELECT approval_id, seq, list_reduce(list_prepend('PENDING', coalesce(before, [])), {_STEP_SQL}) AS from_state, to_state FROM k)
    SELECT * FROM l WHERE (from_state, to_state) NOT IN ({src.EDGES_SQL})""",
)
def approvals_illegal(spark, sf):
    return ap.illegal_transitions(src.approval_events(spark, sf))


@query(
    "approvals_sweep",
    f"""WITH {src.APPROVALS_SQL} SELECT approval_id, CASE WHEN state IN ('PENDING', 'APPROVED')
      AND expires_at <= TIMESTAMP '{src.NOW}' THEN 'EXPIRED' ELSE state END AS state FROM approvals""",
)
def approvals_sweep(spark, sf):
    swept = ap.sweep(src.approvals(spark, sf), F.lit(src.NOW).cast("timestamp"))
    return swept.select("approval_id", "state")


def open_approvals(spark, sf):
    """Orders read as approvals of January 2024."""
    expires = F.timestamp_add("DAY", (F.col("o_orderkey") % 40).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("apr_"), F.col("o_orderkey").cast("string")).alias("approval_id"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderpriority") == "1-URGENT", "EXPIRED")
        .otherwise("PENDING").alias("state"),
        (F.col("o_custkey") % 150).alias("creator"), expires.alias("expires_at"),
        F.col("o_orderkey").alias("transaction_id"), sha256_tag(F.col("o_orderpriority")).alias("material_hash"),
    )


OPEN_SQL = """open_approvals AS (SELECT 'apr_' || o_orderkey AS approval_id,
  CASE WHEN o_orderstatus = 'F' THEN 'APPROVED' WHEN o_orderpriority = '1-URGENT' THEN 'EXPIRED' ELSE 'PENDING' END AS state,
  o_custkey % 150 AS creator, TIMESTAMP '2024-01-01' + to_days((o_orderkey % 40)::INT) AS expires_at,
  o_orderkey AS transaction_id, o_orderpriority FROM orders)"""


@query(
    "approvals_decide",
    f"""WITH {REQUESTS_SQL}, {OPEN_SQL}, c AS (SELECT r.*, CASE WHEN a.state IS NULL THEN 'unknown'
        WHEN a.state = 'EXPIRED' OR (a.state = 'PENDING' AND a.expires_at <= r.ts) THEN 'expired'
        WHEN a.state <> 'PENDING' THEN 'wrong_state' WHEN r.reviewer = a.creator THEN 'self_approval'
        WHEN r.decision = 'DENY' AND trim(r.note) = '' THEN 'note_required'
        WHEN r.decision NOT IN ('APPROVE', 'DENY') THEN 'bad_decision' END AS problem
      FROM requests r LEFT JOIN open_approvals a USING (approval_id)),
    w AS (SELECT * FROM c WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY approval_id ORDER BY ts, request_id) = 1)
    SELECT c.request_id, c.approval_id, CASE
      WHEN k.request_id IS NOT NULL AND (k.ts, k.request_id) < (c.ts, c.request_id)
        THEN CASE WHEN k.decision = c.decision AND k.note = c.note THEN 'replayed' ELSE 'conflict' END
      WHEN c.problem IN ('unknown', 'expired', 'wrong_state') THEN c.problem
      WHEN w.request_id IS NOT NULL AND (w.ts, w.request_id) < (c.ts, c.request_id) THEN 'wrong_state'
      ELSE coalesce(c.problem, 'applied') END AS outcome
    FROM c LEFT JOIN w ON w.approval_id = c.approval_id LEFT JOIN w k ON k.idempotency_key = c.idempotency_key""",
)
def approvals_decide(spark, sf):
    return ap.decide(decision_requests(spark, sf), open_approvals(spark, sf))


def resume_claims(spark, sf):
    return src.requests(spark, sf).select(
        F.col("event_id").alias("claim_id"),
        F.concat(F.lit("apr_"), (F.floor(F.col("event_id") / 10) * 15).cast("string")).alias("approval_id"), "ts",
    )


_CLAIMS_SQL = """claims AS (SELECT event_id AS claim_id, 'apr_' || (event_id // 10) * 15 AS approval_id, ts FROM events),
won AS (SELECT approval_id, claim_id FROM claims JOIN open_approvals a USING (approval_id) WHERE state = 'APPROVED' AND ts < expires_at
  QUALIFY row_number() OVER (PARTITION BY approval_id ORDER BY ts, claim_id) = 1)"""


@query("approvals_claim_once", f"WITH {OPEN_SQL}, {_CLAIMS_SQL} SELECT approval_id, claim_id FROM won")
def approvals_claim_once(spark, sf):
    return ap.claim_once(resume_claims(spark, sf), open_approvals(spark, sf))


def recomputed(spark, sf):
    """The hash at resume time; every thirteenth customer changed the request."""
    changed = F.when(F.col("o_custkey") % 13 == 0, F.lit("changed")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), sha256_tag(changed).alias("material_hash")
    )


@query(
    "approvals_args_changed",
    "SELECT 'apr_' || o_orderkey AS approval_id, o_orderkey AS transaction_id, 'DENIED' AS state, 'ARGUMENTS_CHANGED' AS note "
    "FROM orders WHERE o_custkey % 13 = 0",
)
def approvals_args_changed(spark, sf):
    return ap.arguments_changed(open_approvals(spark, sf), recomputed(spark, sf))


@query(
    "approvals_reconcile",
    f"""WITH {src.APPROVALS_SQL} SELECT approval_id, CASE WHEN state = 'RESUMING' AND resume_attempts < {d.MAX_RESUME_ATTEMPTS} THEN 'APPROVED'
      WHEN state = 'RESUMING' THEN 'FAILED' ELSE state END AS state FROM approvals""",
)
def approvals_reconcile(spark, sf):
    return ap.reconcile(src.approvals(spark, sf)).select("approval_id", "state")


@query(
    "approvals_resume_outcome",
    f"""WITH {src.DECISIONS_SQL}, {OPEN_SQL}, {_CLAIMS_SQL} SELECT c.claim_id, c.approval_id, CASE WHEN w.claim_id IS NULL THEN 'not_eligible'
      WHEN o_custkey % 13 = 0 THEN 'denied_arguments_changed' WHEN verdict = 'DENY' THEN 'denied_output_guard' ELSE 'completed' END AS outcome
    FROM claims c LEFT JOIN won w ON w.claim_id = c.claim_id LEFT JOIN orders ON 'apr_' || o_orderkey = c.approval_id
    LEFT JOIN decisions d ON d.txn_id = o_orderkey""",
)
def approvals_resume_outcome(spark, sf):
    return ap.resume_outcomes(
        resume_claims(spark, sf), open_approvals(spark, sf), recomputed(spark, sf), src.decisions(spark, sf)
    )


@query(
    "retention_purge",
    f"""SELECT 'transactions' AS kind, count(*) AS n_rows,
        count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{src.NOW}' - INTERVAL 400 DAY) AS n_content FROM orders
      UNION ALL SELECT 'audit', count(*), count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{src.NOW}' - INTERVAL 900 DAY""",
)
def retention_purge(spark, sf):
    """Rows left after a purge: contents and audit rows lie in tables of partitions by month, decisions in one of their own.

    The tables stand in a database of their own in the shared folder, as managed tables, so
    that a dropped partition takes its files along.
    """
    now = datetime.datetime.fromisoformat(src.NOW)
    home = f"retention_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {home} LOCATION {literal(checkpoint_root(spark).rstrip('/') + '/' + home)}")
    created = F.col("o_orderdate").cast("timestamp").alias("created_at")
    orders = table(spark, sf, "orders")
    content = orders.select("o_orderkey", created, F.col("o_orderpriority").alias("request_content"), F.col("o_orderstatus").alias("response_content"))
    audit.dated_table(content, f"{home}.content", unit="month")
    audit.dated_table(orders.select("o_orderkey", created), f"{home}.audit", unit="month")
    audit.purge_dated(spark, f"{home}.content", now - datetime.timedelta(days=400), unit="month")
    audit.purge_dated(spark, f"{home}.audit", now - datetime.timedelta(days=900), unit="month")
    left = orders.agg(F.count("*").alias("n_rows")).crossJoin(  # one row each
        spark.table(f"{home}.content").agg(F.count("request_content").alias("n_content"))
    )
    logs = spark.table(f"{home}.audit").agg(F.count("*").alias("n_rows"), F.count("*").alias("n_content"))
    return left.withColumn("kind", F.lit("transactions")).unionByName(logs.withColumn("kind", F.lit("audit")))
