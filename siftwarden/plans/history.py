"""Decisions under a policy that changed twice."""

from __future__ import annotations

import copy
import datetime as dt

from pyspark.sql import functions as F

from siftwarden.operators import history
from siftwarden.operators.policy import DEFAULT_DOCUMENT, Policy, leaf_rows
from siftwarden.plans import inputs as src
from siftwarden.plans.registry import query
from siftwarden.sources.readers import table


def changed(**rules: dict) -> Policy:
    """The default policy with parts of some rules replaced."""
    document = copy.deepcopy(DEFAULT_DOCUMENT)
    for rule in document["rules"]:
        rule.update(rules.get(rule["id"], {}))
    return Policy.from_document(document)


STRICT = changed(
    deny_prompt_injection={"when": {"category": "PROMPT_INJECTION", "score_gte": 0.40}},
    review_sensitive_topic={"verdict": "DENY", "transformation": "NONE"},
    redact_output_pii={"verdict": "NEED_APPROVAL"},
)
LENIENT = changed(
    deny_indirect_injection={"verdict": "NEED_APPROVAL", "hard_deny": False},
    deny_system_prompt_leak={"when": {"category": "SYSTEM_PROMPT_LEAK", "score_gte": 0.95}},
)
HISTORY = (
    (dt.datetime(1993, 1, 1), Policy.default()), (dt.datetime(1995, 7, 1), STRICT), (dt.datetime(1997, 1, 1, 12), LENIENT),
)


def dated(spark, sf):
    """Orders as transactions of their day."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))


def _versions_sql() -> str:
    """CTEs ending in ``versions(txn_id, v, verdict)`` and ``timed(txn_id, version)``."""
    values = ", ".join(
        f"({k}, {src.quote(r[2])}, {src.quote(r[3])}, {r[4]}::DOUBLE, {r[5]}::DOUBLE, {src.quote(r[6])})"
        for k, (_, policy) in enumerate(HISTORY) for r in leaf_rows(policy)
    )
    begun = " + ".join(f"(o_orderdate::TIMESTAMP >= TIMESTAMP '{at}')::INT" for at, _ in HISTORY)
    return f"""{src.FINDINGS_SQL}, rules(v, plane, category, score_gte, score_lt, verdict) AS (VALUES {values}),
    tops AS (SELECT txn_id, plane, category, max(score) AS score FROM findings WHERE category <> 'DETECTOR_TIMEOUT' GROUP BY ALL),
    ranks AS (SELECT txn_id, v, max({src.RANK_SQL}) AS rank FROM tops JOIN rules USING (plane, category)
      WHERE score >= score_gte AND score < score_lt GROUP BY ALL),
    timed AS (SELECT o_orderkey AS txn_id, nullif({begun}, 0) - 1 AS version FROM orders),
    versions AS (SELECT t.txn_id, n.v, {src.VERDICT_SQL} AS verdict FROM timed t CROSS JOIN (SELECT unnest(range({len(HISTORY)}))::INT AS v) n
      LEFT JOIN ranks r ON r.txn_id = t.txn_id AND r.v = n.v)"""


@query(
    "decide_as_of",
    f"""WITH {_versions_sql()} SELECT t.txn_id, version, verdict,
      {src.case_sql('version', {k: p.version for k, (_, p) in enumerate(HISTORY)})} AS policy_version
    FROM timed t LEFT JOIN versions w ON w.txn_id = t.txn_id AND w.v = version""",
)
def decide_as_of(spark, sf):
    found = history.decided_as_of(src.findings(spark, sf), dated(spark, sf), HISTORY)
    return found.select("txn_id", "version", "verdict", "policy_version")


@query(
    "agg_policy_change",
    f"""WITH {_versions_sql()} SELECT version, b.verdict AS verdict_before, a.verdict AS verdict_after, count(*) AS n
    FROM timed t JOIN versions b ON b.txn_id = t.txn_id AND b.v = version - 1 JOIN versions a ON a.txn_id = t.txn_id AND a.v = version
    GROUP BY ALL""",
)
def agg_policy_change(spark, sf):
    """What each change of policy did to the transactions after it."""
    found = history.what_changed(src.findings(spark, sf), dated(spark, sf), HISTORY)
    return found.groupBy("version", "verdict_before", "verdict_after").agg(F.count("*").alias("n"))
