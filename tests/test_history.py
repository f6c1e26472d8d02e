"""Decisions under a changing policy against one policy at a time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwarden.operators import history
from siftwarden.operators.decide import decide, score_board
from siftwarden.plans.history import HISTORY, LENIENT, STRICT, changed

SCORES = [
    (1, "input", "PROMPT_INJECTION", 0.45), (2, "input", "SENSITIVE_TOPIC", 0.9), (3, "context", "INDIRECT_INJECTION", 0.6),
    (4, "response", "OUTPUT_PII", 0.9), (5, "response", "SYSTEM_PROMPT_LEAK", 0.85), (6, "input", "DETECTOR_TIMEOUT", 0.0),
    (3, "input", "PII_DETECTED", 0.9), (8, "input", "JAILBREAK", 0.9),
]
WHEN = {"none": None, "early": dt.datetime(1990, 1, 1), "first": dt.datetime(1995, 6, 30, 23), "edge": HISTORY[1][0], "last": dt.datetime(2020, 1, 1)}
VERSION = {"none": None, "early": None, "first": 0, "edge": 1, "last": 2}


@pytest.fixture(scope="module")
def tables(spark):
    findings = spark.createDataFrame(SCORES, "txn_id int, plane string, category string, score double")
    return findings, lambda at: spark.createDataFrame([(i, at, "x") for i in range(1, 9)], "txn_id int, ts timestamp, verdict string")


@pytest.mark.parametrize("when", list(WHEN))
def test_as_of(spark, tables, when):
    findings, transactions = tables
    rows = transactions(WHEN[when]).withColumnRenamed("verdict", "a.b")
    got = history.decided_as_of(findings, rows, HISTORY).collect()
    version = VERSION[when]
    assert {r.version for r in got} == {version} and len(got) == 8
    if version is None:
        assert {r.verdict for r in got} == {None}
        return
    policy = HISTORY[version][1]
    board = spark.range(1, 9).select(F.col("id").cast("int").alias("txn_id")).join(score_board(findings, policy), "txn_id", "left")
    columns = ("txn_id", "verdict", "transformation", "reason_codes", "policy_version")
    want = [tuple(r) for r in decide(board, policy).select(*columns).collect()]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)


def test_what_changed(spark, tables):
    findings, transactions = tables
    rows = transactions(WHEN["edge"]).unionByName(transactions(WHEN["last"])).unionByName(transactions(WHEN["first"])).drop("verdict")
    got = {(r.version, r.txn_id): (r.verdict_before, r.verdict_after) for r in history.what_changed(findings, rows, HISTORY).collect()}
    assert {k: v for k, v in got.items() if v[0] != v[1]} == {
        (1, 1): ("ALLOW", "DENY"), (1, 2): ("NEED_APPROVAL", "DENY"), (1, 4): ("ALLOW", "NEED_APPROVAL"),
        (2, 1): ("DENY", "ALLOW"), (2, 2): ("DENY", "NEED_APPROVAL"), (2, 4): ("NEED_APPROVAL", "ALLOW"),
        (2, 3): ("DENY", "NEED_APPROVAL"), (2, 5): ("DENY", "ALLOW"),
    }
    assert len(got) == 16 and {k[0] for k in got} == {1, 2}
    assert len({STRICT.version, LENIENT.version, changed().version}) == 3


def test_history_is_ordered(tables):
    with pytest.raises(ValueError):
        history.in_force(F.col("ts"), HISTORY[::-1])


def test_one_shuffle_of_findings(spark, tables):
    findings, transactions = tables
    plan = history.what_changed(findings, transactions(WHEN["last"]).drop("verdict"), HISTORY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1
