"""Join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.operators import approvals as ap
from siftwarden.operators import audit, decide, leak
from siftwarden.operators import messages as ms
from siftwarden.operators.policy import governed_categories, rules_table
from siftwarden.plans import inputs as src
from siftwarden.plans.registry import query
from siftwarden.sources.readers import table


@query(
    "join_findings_rules",
    f"WITH {src.HITS_SQL} SELECT txn_id, plane, category, score, rule_id, verdict, reason_code FROM leaf_hits",
)
def join_findings_rules(spark, sf):
    hits = decide.rule_hits(src.findings(spark, sf), rules_table(spark, src.POLICY))
    return hits.select("txn_id", "plane", "category", "score", "rule_id", "verdict", "reason_code")


_POSITION = {r["id"]: i for i, r in enumerate(src.POLICY.rules)}
_ALLOW = src.sql_list(src.POLICY.tool_allowlist)


@query(
    "join_rule_conditions",
    f"""WITH {src.HITS_SQL}, {src.CALLS_SQL}, every AS (
      SELECT c.txn_id, h.position, h.rule_id FROM calls c JOIN hits h ON h.txn_id = c.txn_id
      UNION ALL SELECT txn_id, {_POSITION['high_value_transfer']}, 'high_value_transfer' FROM calls
        WHERE tool IN ('wire_transfer', 'create_payment', 'initiate_transfer') AND amount >= 1000
      UNION ALL SELECT txn_id, {_POSITION['agent_tool_allowlist']}, 'agent_tool_allowlist' FROM calls WHERE tool NOT IN ({_ALLOW})
      UNION ALL SELECT c.txn_id, {_POSITION['approve_external_pii_transfer']}, 'approve_external_pii_transfer'
        FROM calls c WHERE tool = 'send_email' AND EXISTS (SELECT 1 FROM tops t WHERE t.txn_id = c.txn_id
          AND t.plane = 'input' AND t.category = 'PII_DETECTED'))
    SELECT c.txn_id, coalesce(string_agg(e.rule_id, ',' ORDER BY e.position), '') AS rules
    FROM calls c LEFT JOIN every e ON e.txn_id = c.txn_id GROUP BY c.txn_id""",
)
def join_rule_conditions(spark, sf):
    board = decide.score_board(src.findings(spark, sf), src.POLICY)
    facts = src.calls(spark, sf).select("txn_id", "tool", "args").join(board, "txn_id", "left")
    decided = decide.decide(facts, src.POLICY)
    rules = F.transform("policy_hits", lambda h: h["rule_id"])
    return decided.select("txn_id", F.array_join(rules, ",").alias("rules"))


@query(
    "join_response_system",
    """WITH s AS (SELECT conv_id, arg_min(text, turn) AS system_prompt FROM conversations WHERE role = 'system' GROUP BY 1),
    r AS (SELECT conv_id, arg_max(text, turn) AS response FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT conv_id AS txn_id, system_prompt, response FROM r JOIN s USING (conv_id)""",
)
def join_response_system(spark, sf):
    msgs = src.conversations(spark, sf)
    answers = ms.responses(msgs).select("txn_id", F.col("text").alias("response"))
    return answers.join(ms.system_prompts(msgs), "txn_id")


@query(
    "join_tool_allow_semi",
    f"WITH {src.CALLS_SQL} SELECT txn_id, tool FROM calls WHERE tool IN ({_ALLOW})",
)
def join_tool_allow_semi(spark, sf):
    allowed = spark.createDataFrame([(t,) for t in src.POLICY.tool_allowlist], "tool string")
    return src.calls(spark, sf).select("txn_id", "tool").join(allowed, "tool", "left_semi")


@query(
    "join_approval_txn",
    f"""WITH {src.APPROVALS_SQL} SELECT approval_id, transaction_id, state,
      CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS txn_status
    FROM approvals JOIN orders ON transaction_id = o_orderkey""",
)
def join_approval_txn(spark, sf):
    txns = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("txn_status"),
    )
    return src.approvals(spark, sf).select("approval_id", "transaction_id", "state").join(txns, "transaction_id")


@query(
    "join_self_approval",
    f"""WITH {src.APPROVALS_SQL} SELECT approval_id, l_linenumber, l_suppkey AS reviewer
    FROM lineitem JOIN approvals ON approval_id = 'apr_' || l_orderkey AND creator = l_suppkey""",
)
def join_self_approval(spark, sf):
    taken = table(spark, sf, "lineitem").select(
        F.concat(F.lit("apr_"), F.col("l_orderkey").cast("string")).alias("approval_id"), "l_linenumber",
        F.col("l_suppkey").alias("reviewer"),
    )
    return ap.self_approvals(taken, src.approvals(spark, sf).select("approval_id", "creator"))


@query(
    "join_cross_identity",
    """SELECT o_orderkey AS txn_id, o_custkey AS identity FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def join_cross_identity(spark, sf):
    txns = table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("identity"))
    services = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return ap.readable_by_services(txns, services.select(F.col("c_custkey").alias("identity")))


def trace_events(spark, sf):
    """Events read as audit rows of one transaction per ten events."""
    return src.requests(spark, sf).select(
        F.floor(F.col("event_id") / 10).cast("bigint").alias("transaction_id"),
        F.when(F.col("event_type").isin("click", "error"), F.col("user_id")).alias("approval_id"),
        F.when(F.col("event_type") == "view", "decision").when(F.col("event_type") == "purchase", "RESUME_COMPLETED")
        .otherwise("APPROVAL_CREATED").alias("event_type"),
        F.col("ts").alias("created_at"),
    )


TRACE_SQL = """trace AS (SELECT event_id // 10 AS transaction_id,
  CASE WHEN event_type IN ('click', 'error') THEN user_id END AS approval_id,
  CASE event_type WHEN 'view' THEN 'decision' WHEN 'purchase' THEN 'RESUME_COMPLETED' ELSE 'APPROVAL_CREATED' END AS event_type,
  ts AS created_at FROM events)"""


@query(
    "join_audit_trace",
    f"""WITH {TRACE_SQL} SELECT transaction_id, count(*) FILTER (WHERE event_type = 'decision') AS decisions,
      count(approval_id) AS approval_events, count(*) FILTER (WHERE event_type LIKE 'RESUME%') AS resume_events,
      epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us FROM trace GROUP BY 1""",
)
def join_audit_trace(spark, sf):
    return audit.trace(trace_events(spark, sf)).select(
        "transaction_id", "decisions", "approval_events", "resume_events",
        F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"),
    )


@query(
    "agg_decision_once",
    f"""WITH {TRACE_SQL} SELECT transaction_id, count(*) FILTER (WHERE event_type = 'decision') AS n_decisions
      FROM trace GROUP BY 1 HAVING n_decisions <> 1""",
)
def agg_decision_once(spark, sf):
    events = trace_events(spark, sf)
    return audit.not_decided_once(events.select("transaction_id").distinct(), events)


@query(
    "join_expected_actual",
    f"""WITH {src.DECISIONS_SQL} SELECT CASE toxic WHEN 1 THEN 'DENY' WHEN 0 THEN 'ALLOW' END AS expected_verdict, verdict,
      (verdict IS NOT DISTINCT FROM CASE toxic WHEN 1 THEN 'DENY' WHEN 0 THEN 'ALLOW' END) AS ok, count(*) AS n
    FROM labels FULL OUTER JOIN decisions ON doc_id = txn_id GROUP BY ALL""",
)
def join_expected_actual(spark, sf):
    wanted = F.when(F.col("toxic") == 1, "DENY").when(F.col("toxic") == 0, "ALLOW")
    expected = table(spark, sf, "labels").select(F.col("doc_id").alias("txn_id"), wanted.alias("expected_verdict"))
    joined = expected.join(src.decisions(spark, sf).select("txn_id", "verdict"), "txn_id", "full_outer")
    ok = F.col("verdict").eqNullSafe(F.col("expected_verdict")).alias("ok")
    return joined.groupBy("expected_verdict", "verdict", ok).agg(F.count("*").alias("n"))


_RULE_NAMES = src.sql_list(r["id"] for r in src.POLICY.rules)


@query(
    "join_rules_referenced",
    f"""SELECT p_partkey, rule_id FROM (SELECT p_partkey, unnest(['deny_jailbreak', 'deny_' || lower(p_type)]) AS rule_id FROM part)
      WHERE rule_id NOT IN ({_RULE_NAMES})""",
)
def join_rules_referenced(spark, sf):
    from siftwarden.operators.corpus import unknown_rules

    named = F.array(F.lit("deny_jailbreak"), F.concat(F.lit("deny_"), F.lower("p_type")))
    cases = table(spark, sf, "part").select(
        F.col("p_partkey").alias("case_id"), named.alias("expected_policy_hits")
    )
    return unknown_rules(cases, src.POLICY).select(F.col("case_id").alias("p_partkey"), "rule_id")


@query(
    "join_category_coverage",
    f"""WITH {src.FINDINGS_SQL}, {src.RULES_SQL} SELECT category, count(*) AS n FROM findings
      WHERE category NOT IN (SELECT category FROM rules) GROUP BY category""",
)
def join_category_coverage(spark, sf):
    seen = src.findings(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    return seen.join(governed_categories(spark, src.POLICY), "category", "left_anti")


def decision_requests(spark, sf):
    """Events read as decision requests, ten per approval."""
    e = src.requests(spark, sf)
    group = F.floor(F.col("event_id") / 10).cast("bigint")
    verb = F.when(F.col("event_type").isin("view", "purchase"), "APPROVE").when(
        F.col("event_type").isin("click", "signup"), "DENY"
    ).otherwise("HOLD")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("apr_"), (group * 20).cast("string")).alias("approval_id"),
        verb.alias("decision"), F.when(F.col("value") > 20, "because").otherwise("").alias("note"),
        F.col("user_id").alias("reviewer"),
        F.concat(F.lit("k"), group.cast("string"), F.lit("-"), F.col("event_type")).alias("idempotency_key"), "ts",
    )


REQUESTS_SQL = """requests AS (SELECT event_id AS request_id, 'apr_' || (event_id // 10) * 20 AS approval_id,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'APPROVE' WHEN event_type IN ('click', 'signup') THEN 'DENY' ELSE 'HOLD' END AS decision,
  CASE WHEN value > 20 THEN 'because' ELSE '' END AS note, user_id AS reviewer,
  'k' || (event_id // 10) || '-' || event_type AS idempotency_key, ts FROM events)"""


@query(
    "join_idempotent_replay",
    f"""WITH {REQUESTS_SQL}, firsts AS (SELECT * FROM requests
      QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY ts, request_id) = 1)
    SELECT r.request_id, r.idempotency_key, CASE WHEN r.approval_id = f.approval_id AND r.decision = f.decision
      AND r.note = f.note THEN 'replayed' ELSE 'conflict' END AS outcome
    FROM requests r JOIN firsts f USING (idempotency_key) WHERE r.request_id <> f.request_id""",
)
def join_idempotent_replay(spark, sf):
    return ap.replayed_or_conflicting(decision_requests(spark, sf))


@query(
    "join_leaked_values",
    f"""WITH {src.DOCS_SQL}, b AS (SELECT item_id, {src.norm_sql('text')} AS c FROM benchmark)
    SELECT item_id AS canary_id, count(*) AS n_leaks FROM docs JOIN b ON contains(norm, c) GROUP BY 1""",
)
def join_leaked_values(spark, sf):
    values = table(spark, sf, "benchmark").select(F.col("item_id").alias("canary_id"), F.col("text").alias("canary"))
    return leak.canary_hits(src.documents(spark, sf), values, decode=False).groupBy("canary_id").agg(F.count("*").alias("n_leaks"))


@query(
    "set_union_findings",
    f"""WITH {src.FINDINGS_SQL} SELECT plane, category, count(*) AS n FROM (
      SELECT plane, category FROM findings UNION ALL SELECT 'action', 'SENSITIVE_ACTION' FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000) GROUP BY ALL""",
)
def set_union_findings(spark, sf):
    from siftwarden.operators import tools

    acts = tools.scan_calls(src.calls(spark, sf), src.POLICY, src.SALT)
    acts = acts.where(F.col("category") == "SENSITIVE_ACTION").select("txn_id", "plane", "category", "score")
    both = src.findings(spark, sf).select("txn_id", "plane", "category", "score").unionByName(acts)
    return both.groupBy("plane", "category").agg(F.count("*").alias("n"))


@query(
    "set_except_taxonomy",
    f"""WITH {src.FINDINGS_SQL} SELECT c.category FROM (VALUES {', '.join(f"('{c}')" for c in d.CATEGORIES)}) c(category)
      EXCEPT SELECT category FROM findings""",
)
def set_except_taxonomy(spark, sf):
    declared = spark.createDataFrame([(c,) for c in d.CATEGORIES], "category string")
    return declared.join(src.findings(spark, sf).select("category").distinct(), "category", "left_anti")
