from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_queries import TABLES, rows_of
from siftwarden.plans import detection

SF = "/root/testdata/sf0.001"
SAMPLE = ("scan_pii", "redact_text", "agg_counters", "win_rate_limit", "approvals_decide", "sink_audit_jsonl", "join_rule_conditions")


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in res.description], res.fetchall())


def test_every_detector_is_in_scan_all(spark, monkeypatch):
    got = {tuple(r)[:4]: r.n for r in entry.queries()["scan_all"](spark, SF).collect()}
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = {(p, d, c, i): n for p, d, c, i, n in con.execute(f"SELECT plane, detector_id, category, pattern_id, n FROM ({entry.oracle_sql()['scan_all']})").fetchall()}
    assert got == sql
    n = Counter()
    for (plane, _, category, _), k in got.items():
        n[plane, category] += k
    each = {q: entry.queries()[q](spark, SF) for q in ("scan_canary_leak", "scan_system_prompt_leak", "scan_tool_allowlist", "scan_tool_amount", "scan_message_schema")}
    assert n["response", "CANARY_LEAK"] >= each["scan_canary_leak"].count() > 0
    assert n["response", "SYSTEM_PROMPT_LEAK"] == each["scan_system_prompt_leak"].count() > 0
    assert n["action", "TOOL_NOT_ALLOWLISTED"] == each["scan_tool_allowlist"].count() > 0
    assert n["action", "SENSITIVE_ACTION"] == each["scan_tool_amount"].count() > 0
    faults = Counter(r.pattern_id for r in each["scan_message_schema"].collect())
    have = Counter()
    for (_, _, _, i), k in got.items():
        have[i] += k
    assert {i: have[i] for i in faults} == faults and len(faults) == 2
    # Values in assistant messages are output.
    plain = detection.probes
    monkeypatch.setattr(detection, "probes", lambda *a: plain(*a).withColumn("text", F.concat("text", F.lit(" someone@example.org"))))
    planted = Counter({tuple(r)[:4]: r.n for r in detection.scan_all(spark, SF).collect()})
    answers = con.execute("SELECT count(*) FROM conversations WHERE role = 'assistant'").fetchone()[0]
    assert sum(k for (plane, _, category, _), k in planted.items() if (plane, category) == ("response", "OUTPUT_PII")) == answers > 0
