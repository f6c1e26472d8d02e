"""Tool calls: declared candidates, response calls, and their detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import toolargs as ta
from siftwarden.functions.hashing import salted_hash_sql
from siftwarden.operators.detect import finding_sql
from siftwarden.operators.policy import Policy


def candidates(requests: DataFrame) -> DataFrame:
    """Declared tools (txn_id, tools array) as (txn_id, pos, tool, args) rows.

    Entries that are not functions or have no name are dropped; parameters that
    are not a JSON object count as ``{}``.
    """
    rows = requests.select("txn_id", F.posexplode("tools").alias("pos", "t"))
    rows = rows.where(
        (F.col("t.type") == "function") & (F.coalesce(F.col("t.function.name"), F.lit("")) != "")
    )
    raw = F.col("t.function.parameters")
    is_object = F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT")
    return rows.select(
        "txn_id", "pos", F.col("t.function.name").alias("tool"),
        F.when(is_object, raw).otherwise("{}").alias("args"),
    )


def first_response_call(responses: DataFrame) -> DataFrame:
    """The first tool call of the first choice of a response, where it is complete.

    ``responses`` has (txn_id, body) with ``body`` the JSON text of the response.
    """
    body = F.try_parse_json("body")
    at = "$.choices[0].message.tool_calls[0].function"
    calls = responses.select(
        "txn_id",
        ta.path_text(body, at + ".name").alias("tool"),
        ta.path_text(body, at + ".arguments").alias("args"),
    )
    return calls.where(F.col("tool").isNotNull() & F.col("args").isNotNull())


def scan_calls(calls: DataFrame, policy: Policy, salt: str) -> DataFrame:
    """Findings about tool calls (txn_id, tool, args as JSON text).

    Arguments that are not JSON yield one finding and nothing else is looked at.
    Unlike the policy conditions, SQL and shell texts are taken as they stand.
    """
    df = calls.withColumn("_v", F.try_parse_json("args"))
    query, command = ta.path_text(F.col("_v"), "$.query"), ta.path_text(F.col("_v"), "$.command")
    amount = ta.path_number(F.col("_v"), "$.amount")
    checks = [
        F.when(
            F.col("_v").isNull(),
            F.expr(finding_sql("tool_calls", "'SCHEMA_VIOLATION'", "0.6D", "'MEDIUM'",
                               "'unparseable_tool_arguments_v1'", "0", "0", salted_hash_sql("args", salt))),
        )
    ]
    readable = F.col("_v").isNotNull()

    def check(condition, category: str, score: float):
        hit = F.expr(finding_sql("tool_calls", f"'{category}'", f"{score}D", "'HIGH'"))
        checks.append(F.when(readable & F.coalesce(condition, F.lit(False)), hit))

    allowlist = policy.tool_allowlist
    if allowlist is not None:
        check(~F.col("tool").isin(*allowlist), "TOOL_NOT_ALLOWLISTED", 0.9)
    threshold = policy.leaf("high_value_transfer", "numeric_gte")
    if threshold is not None:
        tools = policy.leaf("high_value_transfer", "tool_name_in") or []
        check(
            F.col("tool").isin(*tools) & (amount >= float(threshold)), "SENSITIVE_ACTION", 0.85
        )
    verbs = [v.upper() for v in policy.leaf("deny_destructive_sql", "sql_verb_in") or []]
    check(
        (F.trim(query) != "") & (ta.first_word(query).isin(*verbs) | ta.unbounded_mutation(query)),
        "DESTRUCTIVE_ACTION", 0.95,
    )
    families = policy.leaf("deny_shell_deletion", "shell_pattern_in") or []
    check(ta.has_shell_pattern(F.lower(command), families), "DESTRUCTIVE_ACTION", 0.95)
    keys = [c for c in calls.columns if c != "args"]
    return (
        df.select(*keys, F.posexplode_outer(F.array_compact(F.array(*checks))).alias("ord", "f"))
        .where(F.col("f").isNotNull())
        .select(*keys, F.lit("action").alias("plane"), "ord", "f.*")
    )
