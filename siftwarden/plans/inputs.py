"""How the given tables are read as requests, findings, calls and approvals.

Each reading exists twice: as a DataFrame and as a SQL common table expression
for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.operators import messages as ms
from siftwarden.operators.policy import Policy, leaf_rows
from siftwarden.sources.readers import table

SALT = "table-salt"
POLICY = Policy.default()
NOW = "2000-06-15 00:00:00"
TTL_DAYS = 30


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return ", ".join(quote(x) for x in items)


def case_sql(column: str, table_: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN {quote(k) if isinstance(k, str) else k} THEN {quote(v)}" for k, v in table_.items()
    )
    return f"CASE {column} {arms} ELSE {otherwise} END"


def case_col(column: str, table_: dict, otherwise=None) -> Column:
    chain = F
    for k, v in table_.items():
        chain = chain.when(F.col(column) == k, v)
    return chain.otherwise(otherwise)


# --- texts -------------------------------------------------------------------------


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return ms.from_turns(table(spark, sf, "conversations"))


MESSAGES_SQL = """messages AS (
  SELECT conv_id AS txn_id, turn, role, coalesce(text, '') AS text,
         CASE WHEN role IN ('assistant', 'tool') THEN 'context' ELSE 'input' END AS plane
  FROM conversations)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as retrieved context: one message each."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("txn_id"), F.lit(0).cast("bigint").alias("turn"),
        F.lit("context").alias("plane"), "text", "source", "lang",
    )


def norm_sql(column: str) -> str:
    drop = d.ZERO_WIDTH + d.BIDI_CONTROLS + d.VARIATION_SELECTORS
    folded = f"translate({column}, {quote(d.HOMOGLYPHS_FROM + drop)}, {quote(d.HOMOGLYPHS_TO)})"
    return f"trim(regexp_replace({folded}, '\\s+', ' ', 'g'))"


def word_fold_sql(column: str) -> str:
    """Letters beyond ASCII as ``w``, so ASCII word classes see words; lengths stay."""
    marks = f"regexp_replace({column}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '~', 'g')"
    return f"regexp_replace({marks}, '[^\\x00-\\x7F]', 'w', 'g')"


DOCS_SQL = f"""docs AS (SELECT doc_id AS txn_id, source, text, {norm_sql('text')} AS norm,
  {word_fold_sql(norm_sql('text'))} AS folded, {word_fold_sql('text')} AS folded_raw FROM documents)"""


def spans_sql(name: str, pattern: str, source: str = "docs", folded: str = "folded", text: str = "norm") -> str:
    """CTEs ending in ``name(txn_id, start_pos, end_pos, hit)``: all matches with offsets."""
    p = quote(pattern)
    return f"""{name}_m AS (
  SELECT txn_id, {text} AS t, regexp_extract_all({folded}, {p}) AS m, string_split_regex({folded}, {p}) AS s
  FROM {source} WHERE regexp_matches({folded}, {p})),
{name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name}_o AS (
  SELECT txn_id, t, length(m[i]) AS w,
         (list_sum(list_transform(s[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start_pos
  FROM {name}_i),
{name} AS (
  SELECT txn_id, start_pos, start_pos + w AS end_pos, substring(t, start_pos + 1, w) AS hit
  FROM {name}_o)"""


# --- findings ---------------------------------------------------------------------------

INBOUND = {
    1: "PROMPT_INJECTION", 2: "JAILBREAK", 3: "PII_DETECTED", 4: "SECRET_DETECTED",
    5: "SENSITIVE_TOPIC", 6: "INDIRECT_INJECTION", 7: "DETECTOR_TIMEOUT",
}
OUTBOUND = {
    1: "OUTPUT_PII", 2: "OUTPUT_SECRET", 3: "CANARY_LEAK", 4: "SYSTEM_PROMPT_LEAK",
    5: "OUTPUT_PII", 6: "SCHEMA_VIOLATION", 7: "DETECTOR_TIMEOUT",
}
PLANE_OF_FLAG = {"A": "input", "N": "context", "R": "response"}
DETECTOR_OF_STATUS = {"F": "first_pass", "O": "second_pass"}


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Line items read as findings of their order."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey"
    )
    return rows.select(
        F.col("l_orderkey").alias("txn_id"),
        case_col("l_returnflag", PLANE_OF_FLAG).alias("plane"),
        F.when(F.col("l_returnflag") == "R", case_col("l_linenumber", OUTBOUND))
        .otherwise(case_col("l_linenumber", INBOUND)).alias("category"),
        F.round(F.col("l_discount") * 10, 1).alias("score"),
        case_col("l_linestatus", DETECTOR_OF_STATUS, "third_pass").alias("detector_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "HIGH").when(F.col("l_suppkey") % 3 == 1, "MEDIUM")
        .otherwise("LOW").alias("confidence"),
        F.col("l_partkey").alias("ord"),
        F.col("l_suppkey").alias("ord2"),
    )


FINDINGS_SQL = f"""findings AS (
  SELECT l_orderkey AS txn_id, {case_sql('l_returnflag', PLANE_OF_FLAG)} AS plane,
         CASE WHEN l_returnflag = 'R' THEN {case_sql('l_linenumber', OUTBOUND)}
              ELSE {case_sql('l_linenumber', INBOUND)} END AS category,
         round(l_discount * 10, 1) AS score,
         {case_sql('l_linestatus', DETECTOR_OF_STATUS, quote('third_pass'))} AS detector_id,
         CASE l_suppkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
         l_partkey AS ord, l_suppkey AS ord2
  FROM lineitem)"""


def _rules_values() -> str:
    rows = []
    for r in leaf_rows(POLICY):
        position, rule_id, plane, category, gte, lt, verdict, change, reason = r
        rows.append(
            f"({position}, {quote(rule_id)}, {quote(plane)}, {quote(category)}, {gte}::DOUBLE, {lt}::DOUBLE, "
            f"{quote(verdict)}, {quote(change)}, {quote(reason)})"
        )
    return ",\n    ".join(rows)


RANK_SQL = "CASE verdict WHEN 'DENY' THEN 2 WHEN 'NEED_APPROVAL' THEN 1 ELSE 0 END"
VERDICT_SQL = "CASE rank WHEN 2 THEN 'DENY' WHEN 1 THEN 'NEED_APPROVAL' ELSE 'ALLOW' END"


def level_sql(score: str) -> str:
    return (
        f"CASE WHEN coalesce({score}, 0) <= 0 THEN 'NONE' WHEN {score} >= 0.9 THEN 'CRITICAL' "
        f"WHEN {score} >= 0.7 THEN 'HIGH' WHEN {score} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
    )


RULES_SQL = f"""rules(position, rule_id, plane, category, score_gte, score_lt, verdict, transformation, reason_code) AS (
  VALUES {_rules_values()})"""

HITS_SQL = f"""{FINDINGS_SQL}, {RULES_SQL},
tops AS (SELECT txn_id, plane, category, max(score) AS score FROM findings
         WHERE category <> 'DETECTOR_TIMEOUT' GROUP BY ALL),
leaf_hits AS (SELECT t.txn_id, t.plane, t.category, t.score, r.position, r.rule_id, r.verdict,
                     r.transformation, r.reason_code
              FROM tops t JOIN rules r ON t.plane = r.plane AND t.category = r.category
               AND t.score >= r.score_gte AND t.score < r.score_lt),
hits AS (SELECT DISTINCT txn_id, position, rule_id, verdict, transformation, reason_code FROM leaf_hits)"""

# One decision per transaction that has findings.
DECISIONS_SQL = f"""{HITS_SQL},
ranks AS (SELECT txn_id, max({RANK_SQL}) AS rank FROM hits GROUP BY txn_id),
wins AS (SELECT h.* FROM hits h JOIN ranks r ON h.txn_id = r.txn_id AND {RANK_SQL} = r.rank),
txns AS (SELECT txn_id, max(score) FILTER (WHERE category <> 'DETECTOR_TIMEOUT') AS max_score,
                bool_or(category = 'DETECTOR_TIMEOUT') AS degraded FROM findings GROUP BY txn_id),
decisions AS (
  SELECT t.txn_id, {VERDICT_SQL} AS verdict,
    CASE WHEN r.rank = 2 THEN 'NONE' ELSE coalesce((SELECT max(w.transformation) FROM wins w
      WHERE w.txn_id = t.txn_id AND w.transformation <> 'NONE'), 'NONE') END AS transformation,
    coalesce((SELECT string_agg(DISTINCT w.reason_code, ',' ORDER BY w.reason_code) FROM wins w
      WHERE w.txn_id = t.txn_id), '') AS reasons,
    coalesce((SELECT string_agg(h.rule_id, ',' ORDER BY h.position) FROM hits h
      WHERE h.txn_id = t.txn_id), '') AS rules,
    {level_sql('t.max_score')} AS risk_level, t.degraded
  FROM txns t LEFT JOIN ranks r ON t.txn_id = r.txn_id)"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions over the line-item findings: one shuffle, then row-wise."""
    from siftwarden.operators.decide import decide, score_board

    return decide(score_board(findings(spark, sf), POLICY), POLICY)


# --- tool calls -----------------------------------------------------------------------------

TOOL_OF_PRIORITY = {
    "1-URGENT": "wire_transfer", "2-HIGH": "create_payment", "3-MEDIUM": "send_email",
    "4-NOT SPECIFIED": "run_sql", "5-LOW": "delete_account",
}


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as tool calls with an amount."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("identity"),
        case_col("o_orderpriority", TOOL_OF_PRIORITY).alias("tool"),
        F.to_json(F.struct(F.col("o_totalprice").alias("amount"))).alias("args"),
    )


CALLS_SQL = f"""calls AS (SELECT o_orderkey AS txn_id, o_custkey AS identity,
  {case_sql('o_orderpriority', TOOL_OF_PRIORITY)} AS tool, o_totalprice AS amount FROM orders)"""


# --- request log ----------------------------------------------------------------------------


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as a request log."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# --- approvals --------------------------------------------------------------------------------

STATE_OF_STATUS = {"P": "PENDING", "O": "APPROVED"}
STATE_OF_PRIORITY = {"1-URGENT": "RESUMING", "2-HIGH": "DENIED", "3-MEDIUM": "COMPLETED"}


def approvals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as approvals."""
    o = table(spark, sf, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.concat(F.lit("apr_"), F.col("o_orderkey").cast("string")).alias("approval_id"),
        F.col("o_orderkey").alias("transaction_id"),
        F.coalesce(
            case_col("o_orderstatus", STATE_OF_STATUS), case_col("o_orderpriority", STATE_OF_PRIORITY, "FAILED")
        ).alias("state"),
        F.col("o_custkey").alias("creator"),
        (F.col("o_custkey") % 5).cast("int").alias("resume_attempts"),
        created.alias("created_at"),
        (created + F.make_interval(days=F.lit(TTL_DAYS))).alias("expires_at"),
        "o_totalprice",
    )


APPROVALS_SQL = f"""approvals AS (
  SELECT 'apr_' || o_orderkey AS approval_id, o_orderkey AS transaction_id,
    coalesce({case_sql('o_orderstatus', STATE_OF_STATUS)},
             {case_sql('o_orderpriority', STATE_OF_PRIORITY, quote('FAILED'))}) AS state,
    o_custkey AS creator, o_custkey % 5 AS resume_attempts, o_orderdate AS created_at,
    o_orderdate + INTERVAL {TTL_DAYS} DAY AS expires_at, o_totalprice FROM orders)"""

STATE_OF_EVENT = {
    "view": "APPROVED", "click": "RESUMING", "purchase": "COMPLETED", "error": "DENIED", "signup": "EXPIRED",
}


def approval_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as reported state changes: one approval per user and day."""
    rows = requests(spark, sf)
    day = F.date_format("ts", "yyyyMMdd")
    return rows.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("approval_id"), "ts",
        F.col("event_id").alias("seq"), case_col("event_type", STATE_OF_EVENT).alias("to_state"),
    )


APPROVAL_EVENTS_SQL = f"""approval_events AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS approval_id, ts, event_id AS seq,
         {case_sql('event_type', STATE_OF_EVENT)} AS to_state FROM events)"""

EDGES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in d.APPROVAL_EDGES)


# --- audit events -----------------------------------------------------------------------------


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as audit rows: one stream per user."""
    e = requests(spark, sf)
    return e.select(
        F.col("user_id").alias("stream_id"), "event_id",
        F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("payload"),
    )
