"""From findings to decisions: scores, risk, verdicts, reasons, combination.

The findings of a transaction are reduced to one row with a column per (plane,
category) the policy can ask for. That is the only shuffle; it pre-aggregates
before it, so a transaction with very many findings costs one row per task.
Everything after it is a row-wise expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.operators.policy import Facts, Policy, hits_sql, rule_categories


def verdict_rank(verdict: Column) -> Column:
    return (
        F.when(verdict == "DENY", 2).when(verdict == "NEED_APPROVAL", 1).otherwise(0)
    )


def verdict_name(rank: Column) -> Column:
    return F.when(rank == 2, "DENY").when(rank == 1, "NEED_APPROVAL").otherwise("ALLOW")


def transformation_rank(transformation: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in d.TRANSFORMATION_ORDER]), transformation)


def transformation_name(rank: Column) -> Column:
    names = F.array(F.lit("NONE"), *[F.lit(t) for t in d.TRANSFORMATION_ORDER])
    return F.element_at(names, F.coalesce(rank, F.lit(0)).cast("int") + 1)


def risk_level(score: Column) -> Column:
    chain = F.when(F.coalesce(score, F.lit(0.0)) <= 0.0, "NONE")
    for level, bound in d.RISK_BOUNDS:
        chain = chain.when(score >= bound, level)
    return chain.otherwise("LOW")


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in d.RISK_LEVELS]), level) - 1


def risk_name(rank: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(x) for x in d.RISK_LEVELS]), F.coalesce(rank, F.lit(0)).cast("int") + 1
    )


# --- reductions of findings ----------------------------------------------------


def content_findings(findings: DataFrame) -> DataFrame:
    """Findings about content; timeout marks are an operational signal."""
    return findings.where(F.col("category") != d.OPERATIONAL_CATEGORY)


def category_scores(findings: DataFrame, keys: Sequence[str] = ("txn_id",)) -> DataFrame:
    return (
        content_findings(findings).groupBy(*keys, "category").agg(F.max("score").alias("score"))
    )


def risk(findings: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """Overall risk per transaction; transactions without findings are NONE."""
    worst = content_findings(findings).groupBy("txn_id").agg(F.max("score").alias("max_score"))
    if transactions is not None:
        worst = transactions.select("txn_id").join(worst, "txn_id", "left")
    return worst.select("txn_id", "max_score", risk_level(F.col("max_score")).alias("risk_level"))


def degraded(findings: DataFrame) -> DataFrame:
    """Transactions with an operational mark, with the reason that wins."""
    return (
        findings.where(F.col("category").isin(d.OPERATIONAL_CATEGORY, "DETECTOR_ERROR"))
        .groupBy("txn_id")
        .agg(F.bool_or(F.col("category") == d.OPERATIONAL_CATEGORY).alias("timed_out"))
        .select(
            "txn_id",
            F.when(F.col("timed_out"), "detector_timeout").otherwise("detector_error").alias("reason"),
        )
    )


# --- evaluation --------------------------------------------------------------------


def _score_column(plane: str, category: str) -> str:
    return f"s__{plane}__{category}"


def _asked_pairs(policy: Policy) -> list[tuple[str, str]]:
    return sorted(
        {(p, c) for rule in policy.rules for p in rule["plane"] for c in rule_categories(rule)}
    )


def score_board(findings: DataFrame, policy: Policy) -> DataFrame:
    """One row per transaction: the top score of every (plane, category) rules ask for."""
    pairs = _asked_pairs(policy)
    tops = [
        F.max(
            F.when((F.col("plane") == p) & (F.col("category") == c), F.col("score"))
        ).alias(_score_column(p, c))
        for p, c in pairs
    ]
    content = F.col("category") != d.OPERATIONAL_CATEGORY
    return findings.groupBy("txn_id").agg(
        *tops,
        F.max(F.when(content, F.col("score"))).alias("max_score"),
        F.coalesce(F.bool_or(~content), F.lit(False)).alias("degraded"),
    )


def _facts(policy: Policy, df: DataFrame) -> Facts:
    known = set(_asked_pairs(policy))
    has = set(df.columns)
    return Facts(
        score=lambda p, c: _score_column(p, c) if (p, c) in known else "CAST(NULL AS DOUBLE)",
        byte_count="payload_bytes" if "payload_bytes" in has else "0",
        tool="tool" if "tool" in has else "CAST(NULL AS STRING)",
        args=F.try_parse_json("args") if "args" in has else F.try_parse_json(F.lit("{}")),
    )


def decide(board: DataFrame, policy: Policy) -> DataFrame:
    """Evaluate the policy over a score board.

    Optional columns of the board feed the other conditions: ``payload_bytes``,
    ``tool`` and ``args`` (JSON text). Adds hits, verdict, transformation,
    reason_codes, risk_level and policy_version.
    """
    missing = {
        _score_column(*pair): F.lit(None).cast("double")
        for pair in _asked_pairs(policy)
        if _score_column(*pair) not in board.columns
    }
    if "max_score" not in board.columns:
        missing["max_score"] = F.lit(None).cast("double")
    missing["degraded"] = F.expr("coalesce(degraded, false)") if "degraded" in board.columns else F.lit(False)
    df = board.withColumns(missing)
    facts = _facts(policy, df)
    hits = hits_sql(policy, facts)
    if facts.checks:
        df = df.withColumns(facts.checks)
    df = df.withColumn("policy_hits", F.expr(hits)).withColumn("_rank", F.expr(_TOP_RANK))
    winners = "filter(policy_hits, h -> h.verdict = verdict)"
    order = ", ".join(f"'{t}'" for t in d.TRANSFORMATION_ORDER)
    change = f"array_max(transform({winners}, h -> array_position(array({order}), h.transformation)))"
    return (
        df.withColumn("verdict", verdict_name(F.col("_rank")))
        .withColumns(
            {
                "transformation": F.expr(
                    f"CASE WHEN verdict = 'DENY' THEN 'NONE' "
                    f"ELSE element_at(array('NONE', {order}), CAST(coalesce({change}, 0) AS INT) + 1) END"
                ),
                "reason_codes": F.expr(f"array_sort(array_distinct(transform({winners}, h -> h.reason_code)))"),
                "risk_level": risk_level(F.col("max_score")),
                "policy_version": F.lit(policy.version),
            }
        )
        .drop("_rank", *facts.checks, *[_score_column(*p) for p in _asked_pairs(policy)])
    )


_TOP_RANK = (
    "coalesce(array_max(transform(policy_hits, h -> "
    "CASE h.verdict WHEN 'DENY' THEN 2 WHEN 'NEED_APPROVAL' THEN 1 ELSE 0 END)), 0)"
)


def combine(decisions: DataFrame, key: str = "txn_id") -> DataFrame:
    """Merge several decisions per key into one.

    The collected sets hold rules and reason codes, whose number is bounded by
    the policy, never by the number of decisions merged.
    """
    rank = verdict_rank(F.col("verdict"))
    per_key = decisions.groupBy(key).agg(
        F.max(rank).alias("rank"),
        F.flatten(
            F.collect_set(F.transform("reason_codes", lambda c: F.struct(rank.alias("rank"), c.alias("code"))))
        ).alias("reasons"),
        F.max(F.struct(rank.alias("rank"), transformation_rank(F.col("transformation")).alias("t"))).alias("change"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("policy_hits")))).alias("policy_hits"),
        F.bool_or("degraded").alias("degraded"),
        F.max("max_score").alias("max_score"),
        F.min("policy_version").alias("policy_version"),
    )
    won = F.filter("reasons", lambda r: r["rank"] == F.col("rank"))
    return per_key.select(
        key,
        verdict_name(F.col("rank")).alias("verdict"),
        F.when(F.col("rank") == 2, "NONE")
        .otherwise(transformation_name(F.col("change.t")))
        .alias("transformation"),
        F.array_sort(F.array_distinct(F.transform(won, lambda r: r["code"]))).alias("reason_codes"),
        "policy_hits",
        "degraded",
        "max_score",
        risk_level(F.col("max_score")).alias("risk_level"),
        "policy_version",
    )


def decide_requests(
    findings: DataFrame,
    policy: Policy,
    transactions: DataFrame,
    calls: DataFrame | None = None,
) -> DataFrame:
    """Decisions for whole requests.

    ``transactions`` lists the requests (txn_id, optionally payload_bytes) and
    ``calls`` their declared tool calls (txn_id, tool, args). A request with
    several calls is decided once per call and the decisions are combined.
    """
    board = transactions.join(score_board(findings, policy), "txn_id", "left")
    if calls is None:
        return decide(board, policy)
    board = board.join(calls.select("txn_id", "tool", "args"), "txn_id", "left")
    return combine(decide(board, policy))


def guard_output(decisions: DataFrame) -> DataFrame:
    """Response-plane decisions: a hold makes no sense any more and becomes DENY."""
    held = F.col("verdict") == "NEED_APPROVAL"
    return decisions.withColumn(
        "transformation", F.when(held, "NONE").otherwise(F.col("transformation"))
    ).withColumn("verdict", F.when(held, "DENY").otherwise(F.col("verdict")))


# --- findings x rules -----------------------------------------------------------------


def rule_hits(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Every category rule a transaction's findings trip, one row per hit.

    The rules come from one policy document, a few dozen rows, so they are
    broadcast; findings never move for the join.
    """
    tops = category_scores(findings, ("txn_id", "plane"))
    r = F.broadcast(rules)
    return (
        tops.join(r, ["plane", "category"])
        .where((F.col("score") >= F.col("score_gte")) & (F.col("score") < F.col("score_lt")))
        .select(
            "txn_id", "plane", "category", "score", "position", "rule_id", "verdict",
            "transformation", "reason_code",
        )
    )
