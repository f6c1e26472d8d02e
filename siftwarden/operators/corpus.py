"""Labelled corpora: run them through the whole pipeline and score the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.operators import decide, detect, leak, messages, redact, tools
from siftwarden.operators.policy import Policy


def guard_responses(
    responses: DataFrame, prompts: DataFrame, policy: Policy, salt: str, canaries: DataFrame,
    bodies: DataFrame | None = None,
) -> DataFrame:
    """Decide responses (txn_id, turn, text): their text, and the first tool call they propose.

    ``canaries`` has (canary_id, canary); ``prompts`` has (txn_id, system_prompt);
    ``bodies`` has (txn_id, body), the whole response as JSON. A call whose arguments
    are no JSON object leaves its finding, and tells the policy nothing more.
    """
    on_plane = responses.withColumn("plane", F.lit("response"))
    found = detect.scan(on_plane, [detect.pii(), detect.secrets()], salt)
    hits = leak.canary_hits(responses, canaries)
    leaks = leak.canary_findings(hits, salt).unionByName(
        leak.prompt_leak_findings(leak.prompt_similarity(responses, prompts), salt)
    )
    findings, calls = found.unionByName(leaks), None
    if bodies is not None:
        proposed = tools.first_response_call(bodies)
        action = tools.scan_calls(proposed, policy, salt).withColumn("turn", F.lit(0).cast("bigint"))
        findings = findings.unionByName(action.drop("tool"))
        calls = proposed.where(F.schema_of_variant(F.try_parse_json("args")).startswith("OBJECT"))
    decided = decide.decide_requests(findings, policy, responses.select("txn_id"), calls)
    return decide.guard_output(decided)


def run_cases(cases: DataFrame, policy: Policy, salt: str) -> DataFrame:
    """Decisions for corpus cases: input side, and the response where there is one."""
    spark = cases.sparkSession
    requests = cases.select(
        F.col("case_id").alias("txn_id"), "payload.messages", "payload.tools", "response"
    )
    msgs = messages.from_requests(requests)
    findings = detect.scan(msgs, detect.text_detectors(policy), salt)
    calls = tools.candidates(requests.where(F.col("tools").isNotNull()))
    action = tools.scan_calls(calls, policy, salt).withColumn("turn", F.lit(0).cast("bigint"))
    every = findings.unionByName(action.drop("pos", "tool"))
    sized = requests.select("txn_id").join(messages.payload_bytes(msgs), "txn_id", "left")
    inbound = decide.decide_requests(every, policy, sized, calls)
    # The system prompt as forwarded, which is after redaction.
    forwarded = redact.redact_requests(msgs, inbound)
    prompts = messages.system_prompts(forwarded)
    allowed = inbound.where(F.col("verdict") == "ALLOW").select("txn_id")
    answers = (
        requests.where(F.col("response").isNotNull())
        .join(allowed, "txn_id", "left_semi")
        .select("txn_id", F.lit(0).cast("bigint").alias("turn"), F.col("response").alias("text"))
    )
    canaries = spark.createDataFrame(
        [(i, c) for i, c in enumerate(policy.canaries)], "canary_id bigint, canary string"
    )
    outbound = guard_responses(answers, prompts, policy, salt, canaries)
    columns = ["txn_id", "verdict", "transformation", "reason_codes", "policy_hits", "degraded",
               "max_score", "policy_version"]
    return decide.combine(inbound.select(*columns).unionByName(outbound.select(*columns)))


def compare(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Expectation and outcome side by side, with an overall ``ok``."""
    rules = F.transform(
        F.filter("policy_hits", lambda h: h["verdict"] == F.col("verdict")), lambda h: h["rule_id"]
    )
    actual = decisions.select(
        F.col("txn_id").alias("case_id"), "verdict", "transformation", "reason_codes",
        F.array_sort(rules).alias("rules"),
    )
    joined = cases.join(actual, "case_id", "full_outer")

    def same_set(a: str, b: str):
        return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))

    checks = {
        "verdict_ok": F.col("verdict").eqNullSafe(F.col("expected_verdict")),
        "transformation_ok": F.col("transformation").eqNullSafe(F.col("expected_transformation")),
        "reasons_ok": same_set("reason_codes", "expected_reason_codes"),
        "hits_ok": same_set("rules", "expected_policy_hits"),
    }
    out = joined.select("case_id", "category", "verdict", "transformation", "reason_codes", "rules",
                        *[c.alias(n) for n, c in checks.items()])
    return out.withColumn("ok", F.expr(" AND ".join(checks)))


def score(compared: DataFrame) -> DataFrame:
    """Share of right cases per bucket."""
    return compared.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_ok"),
        (F.count_if("ok") / F.count("*")).alias("share"),
    )


def distribution(cases: DataFrame) -> DataFrame:
    """Cases per bucket against the expected numbers, and repeated ids."""
    expected = cases.sparkSession.createDataFrame(
        list(d.CORPUS_DISTRIBUTION.items()), "category string, expected bigint"
    )
    counts = cases.groupBy("category").agg(F.count("*").alias("n"))
    repeated = (
        cases.groupBy("case_id").agg(F.count("*").alias("k"), F.first("category").alias("category"))
        .where(F.col("k") > 1).groupBy("category").agg(F.count("*").alias("repeated_ids"))
    )
    return (
        expected.join(counts, "category", "full_outer")
        .join(repeated, "category", "left")
        .select(
            "category", F.coalesce("expected", F.lit(0)).alias("expected"),
            F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("repeated_ids", F.lit(0)).alias("repeated_ids"),
        )
    )


def unknown_rules(cases: DataFrame, policy: Policy) -> DataFrame:
    """Expected rule ids that the policy does not have."""
    rules = cases.sparkSession.createDataFrame([(r["id"],) for r in policy.rules], "rule_id string")
    expected = cases.select("case_id", F.explode("expected_policy_hits").alias("rule_id"))
    return expected.join(rules, "rule_id", "left_anti")
