"""Policies over time: which one was in force, and what a change of policy did.

A history is a short list of documents with the time each takes effect. Which of them
governs a transaction is read off its own time in its own row, and every version is
evaluated over the same row of scores: no transaction is paired with a policy, and no
finding is scanned twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.operators.decide import decide, score_board
from siftwarden.operators.policy import Policy

History = Sequence[tuple[dt.datetime, Policy]]
OUTCOME = ("verdict", "transformation", "reason_codes", "policy_version")


def merged(history: History) -> Policy:
    """All rules of all versions, for a score board that serves each of them."""
    return Policy(tuple(rule for _, policy in history for rule in policy.rules))


def in_force(ts: Column, history: History) -> Column:
    """Number of the version in force at a time, from 0; null before the first one and without a time.

    Versions that take effect at the same time: the later one in the list holds.
    """
    times = [at for at, _ in history]
    if list(times) != sorted(times):
        raise ValueError("a history is in order of time")
    begun = sum((F.when(ts >= F.lit(at), 1).otherwise(0) for at in times), F.lit(0))
    return F.when(ts.isNotNull() & (begun > 0), begun - 1)


def evaluated(findings: DataFrame, transactions: DataFrame, history: History) -> DataFrame:
    """The columns of ``transactions`` (txn_id, ts, ...) with ``version`` and ``versions``: what every version decides."""
    board = score_board(findings, merged(history))
    keys = [F.col(f"`{c}`") for c in transactions.columns]
    scores = [c for c in board.columns if c != "txn_id"]
    rows = transactions.select("txn_id", F.struct(*keys).alias("_of")).join(board, "txn_id", "left")
    # The scores travel as one column; each version takes them out, decides, and leaves only its outcome.
    rows = rows.select("_of", F.struct("txn_id", *scores).alias("_scores"))
    for k, (_, policy) in enumerate(history):
        decided = decide(rows.select("*", "_scores.*"), policy)
        rows = decided.select(*rows.columns, F.struct(*OUTCOME).alias(f"_v{k}"))
    version = in_force(F.col("_of.ts"), history).cast("int").alias("version")
    return rows.select("_of.*", version, F.array(*[F.col(f"_v{k}") for k in range(len(history))]).alias("versions"))


def decided_as_of(findings: DataFrame, transactions: DataFrame, history: History) -> DataFrame:
    """Decisions by the version in force at each transaction's time; null where there was none."""
    rows = evaluated(findings, transactions, history)
    return rows.withColumn("decision", F.get("versions", F.col("version"))).select(
        *[F.col(f"`{c}`") for c in transactions.columns], "version", "decision.*"
    )


def what_changed(findings: DataFrame, transactions: DataFrame, history: History) -> DataFrame:
    """For each transaction under a version that replaced another: both outcomes side by side."""
    rows = evaluated(findings, transactions, history).where(F.col("version") > 0)
    before, after = F.get("versions", F.col("version") - 1), F.get("versions", F.col("version"))
    named = [side[c].alias(f"{c}_{name}") for name, side in (("before", before), ("after", after)) for c in OUTCOME]
    return rows.select(*[F.col(f"`{c}`") for c in transactions.columns], "version", *named)
