import datetime as dt
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.operators import approvals as ap
from siftwarden.operators import audit, decide, leak, limits, metrics, tools
from siftwarden.operators.policy import Policy

T0 = dt.datetime(2026, 1, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def board(spark, scores, **facts):
    findings = spark.createDataFrame(
        [(1, p, c, s) for p, c, s in scores] or [(1, "input", "SCHEMA_VIOLATION", 0.1)],
        "txn_id int, plane string, category string, score double",
    )
    df = decide.score_board(findings, Policy.default())
    for name, value in facts.items():
        df = df.withColumn(name, F.lit(value))
    return decide.decide(df, Policy.default()).first()


def test_precedence_and_evidence(spark):
    r = board(spark, [("input", "PROMPT_INJECTION", 0.95), ("input", "PII_DETECTED", 0.9), ("input", "JAILBREAK", 0.6)])
    assert (r["verdict"], r["transformation"], r["reason_codes"]) == ("DENY", "NONE", ["PROMPT_INJECTION"])
    assert [h["rule_id"] for h in r["policy_hits"]] == ["deny_prompt_injection", "review_probable_jailbreak", "redact_pii_inbound"]
    r = board(spark, [("response", "PROMPT_INJECTION", 0.95)])
    assert (r["verdict"], r["risk_level"]) == ("ALLOW", "CRITICAL")


@pytest.mark.parametrize(
    ("tool", "args", "verdict"),
    [
        ("wire_transfer", '{"amount": 999}', "ALLOW"), ("wire_transfer", '{"amount": 1000}', "NEED_APPROVAL"),
        ("wire_transfer", '{"amount": "5000"}', "ALLOW"), ("run_sql", '{"query": "-- c\\nDROP TABLE t"}', "DENY"),
        ("run_sql", '{"query": "DROP;"}', "ALLOW"), ("run_sql", '{"query": "DELETE FROM t WHERE a = 1"}', "ALLOW"),
        ("run_sql", '{"query": "update t set a = 1"}', "DENY"), ("run_sql", '{"command": "RM  -rf /"}', "DENY"),
        ("unknown", "{}", "DENY"), ("search_docs", '{"a": {"amount": 5000}}', "ALLOW"),
    ],
)
def test_tool_rules(spark, tool, args, verdict):
    assert board(spark, [], tool=tool, args=args)["verdict"] == verdict


def test_payload_limit(spark):
    assert board(spark, [], payload_bytes=262144)["verdict"] == "ALLOW"
    assert board(spark, [], payload_bytes=262145)["reason_codes"] == ["PAYLOAD_TOO_LARGE"]


def test_policy_documents_are_checked():
    with pytest.raises(ValueError, match="unknown keys"):
        Policy.from_document({"rules": [{"id": "x", "plane": ["input"], "verdict": "DENY", "reason_code": "X", "no": 1}]})
    assert len(Policy.default().rules) == 21


def test_tool_detectors_do_not_forgive(spark):
    calls = spark.createDataFrame(
        [(1, "run_sql", '{"query": "-- c\\nDROP TABLE t"}'), (2, "run_sql", '{"command": "rm  -rf /"}'),
         (3, "wire_transfer", '{"amount": true}'), (4, "run_sql", "{broken"), (5, "nope", "[1]")],
        "txn_id int, tool string, args string",
    )
    assert rows(tools.scan_calls(calls, Policy.default(), "s"), "txn_id", "category") == [
        (4, "SCHEMA_VIOLATION"), (5, "TOOL_NOT_ALLOWLISTED"),
    ]


def test_rate_limit_equals_counting_in_order(spark):
    random.seed(7)
    log = [(i, "hot" if i % 3 else "cold", at(random.randrange(0, 300))) for i in range(600)]
    got = rows(limits.rate_limit(spark.createDataFrame(log, "request_id int, identity string, ts timestamp"), 5, 60),
               "request_id", "allowed", "remaining", "retry_after")
    seen, want = {}, []
    for i, who, ts in sorted(log, key=lambda r: (r[2], r[0])):
        start = int(ts.timestamp()) // 60 * 60
        n = seen[who, start] = seen.get((who, start), 0) + 1
        want.append((i, n <= 5, max(0, 5 - n), 0 if n <= 5 else max(1, start + 60 - int(ts.timestamp()))))
    assert got == sorted(want)


def test_replay_is_a_fold_whatever_the_partitioning(spark):
    random.seed(3)
    log = [(f"a{random.choice([0, 0, 0, 1, 2])}", at(random.randrange(50)), i, random.choice(d.APPROVAL_STATES)) for i in range(3000)]
    want = {}
    for a, _, _, to in sorted(log, key=lambda r: (r[1], r[2])):
        state, bad = want.get(a, ("PENDING", 0))
        want[a] = (to, bad) if (state, to) in d.APPROVAL_EDGES else (state, bad + 1)
    df = spark.createDataFrame(log, "approval_id string, ts timestamp, seq bigint, to_state string")
    got = {r[0]: (r[1], r[2]) for r in ap.replay(df.repartition(7)).select("approval_id", "state", "n_rejected").collect()}
    assert got == want


def test_decisions_one_after_another(spark):
    approvals = spark.createDataFrame(
        [("a", "PENDING", "ann", at(100)), ("b", "PENDING", "ann", at(10)), ("c", "DENIED", "ann", at(100)), ("e", "PENDING", "ann", at(100))],
        "approval_id string, state string, creator string, expires_at timestamp",
    )
    asks = [
        (1, "a", "APPROVE", None, "ann", "k1", at(1)), (2, "a", "DENY", " ", "bob", "k2", at(2)), (3, "a", "APPROVE", None, "bob", "k3", at(3)),
        (4, "a", "APPROVE", None, "bob", "k3", at(4)), (5, "a", "DENY", "no", "bob", "k3", at(5)), (6, "a", "DENY", "no", "bob", "k6", at(6)),
        (7, "b", "APPROVE", None, "bob", "k7", at(20)), (8, "c", "APPROVE", None, "bob", "k8", at(20)), (9, "zz", "APPROVE", None, "bob", "k9", at(20)),
        (10, "e", "APPROVE", None, "bob", "k3", at(21)), (11, "e", "HOLD", None, "bob", "k11", at(22)), (12, "e", "DENY", "no", "bob", "k12", at(23)),
    ]
    df = spark.createDataFrame(asks, "request_id int, approval_id string, decision string, note string, reviewer string, idempotency_key string, ts timestamp")
    assert dict(rows(ap.decide(df, approvals), "request_id", "outcome")) == {
        1: "self_approval", 2: "note_required", 3: "applied", 4: "replayed", 5: "conflict", 6: "wrong_state",
        7: "expired", 8: "wrong_state", 9: "unknown", 10: "conflict", 11: "bad_decision", 12: "applied",
    }


ASKS = "request_id int, approval_id string, decision string, note string, reviewer string, idempotency_key string, ts timestamp"


def one_after_another(asks, open_approvals):
    done, owner, out = {}, {}, {}
    for r, a, verdict, note, _, key, _ in sorted(asks, key=lambda x: (x[6], x[0])):
        if key in owner:
            out[r] = "replayed" if owner[key] == (a, verdict, note or None) else "conflict"
        elif a not in open_approvals:
            out[r] = "unknown"
        elif a in done:
            out[r] = "wrong_state"
        else:
            done[a], out[r] = r, "applied"
            if key is not None:
                owner[key] = (a, verdict, note or None)
    return out


def test_a_chain_of_clashing_keys(spark):
    """Request i uses the key of approval i on approval i + 1, in the order that makes each wait for the one before."""
    n = 1000
    names = [f"a{i:04d}" for i in range(n + 1)]
    asks = [(2 * i + j, names[i + j], "APPROVE", None, "bob", f"k{i}", at(2 * i + j)) for i in range(n) for j in (0, 1)]
    approvals = spark.createDataFrame([(a, "PENDING", "ann", at(10**6)) for a in names], "approval_id string, state string, creator string, expires_at timestamp")
    df = spark.createDataFrame(asks, ASKS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    component = ap.components(ap.contested(ap.checked_requests(df, approvals)))
    # Some ten rounds; adaptive execution makes a job of every shuffle.
    assert len(tracker.getJobIdsForGroup("chain")) < 300
    spark.sparkContext.setJobGroup("frame", "frame")
    out = ap.decide(df, approvals, component)
    assert not tracker.getJobIdsForGroup("frame")
    assert component.select("component").distinct().count() == 1
    assert dict(rows(out, "request_id", "outcome")) == one_after_another(asks, set(names))


def test_decisions_by_hand_and_by_fold(spark):
    rng = random.Random(11)
    names = [f"a{i}" for i in range(120)]
    asks = [
        (i, rng.choice(names + ["zz"]), rng.choice(["APPROVE", "DENY"]), rng.choice(["n", "m"]), "bob", rng.choice([None] + [f"k{j}" for j in range(160)]), at(rng.randrange(300)))
        for i in range(500)
    ]
    asks += [(500 + i, *asks[i][1:6], at(400 + i)) for i in range(60)]
    approvals = spark.createDataFrame([(a, "PENDING", "ann", at(10**6)) for a in names], "approval_id string, state string, creator string, expires_at timestamp")
    got = dict(rows(ap.decide(spark.createDataFrame(asks, ASKS).repartition(5), approvals), "request_id", "outcome"))
    assert got == one_after_another(asks, set(names)) and set(got.values()) == {"applied", "replayed", "conflict", "wrong_state", "unknown"}


def test_sweep_and_reconcile(spark):
    df = spark.createDataFrame([("a", "PENDING", at(0), 0), ("b", "APPROVED", at(9), 0), ("c", "RESUMING", at(0), 2), ("e", "RESUMING", at(0), 3)],
                               "approval_id string, state string, expires_at timestamp, resume_attempts int")
    now = F.lit(at(0)).cast("timestamp")
    once = ap.sweep(df, now)
    assert rows(once, "approval_id", "state") == rows(ap.sweep(once, now), "approval_id", "state")
    assert [s for _, s in rows(ap.reconcile(once), "approval_id", "state")] == ["EXPIRED", "APPROVED", "APPROVED", "FAILED"]


def test_chain_build_and_verify(spark):
    events = spark.createDataFrame([(i % 3, i, f'{{"n":{i}}}') for i in range(60)], "stream_id int, event_id int, payload string")
    chained = audit.build_chain(events).cache()
    last = {}
    for s, _, payload, prev, own in rows(chained, "stream_id", "event_id", "payload", "prev_hash", "event_hash"):
        assert prev == last.get(s, "sha256:" + sha256(b"").hexdigest())
        assert own == "sha256:" + sha256((prev + payload).encode()).hexdigest()
        last[s] = own
    assert audit.broken_links(chained, slice_of=F.floor(F.col("event_id") / 10)).count() == 0
    bad = chained.withColumn("payload", F.when(F.col("event_id") == 31, "{}").otherwise(F.col("payload")))
    assert rows(audit.broken_links(bad), "event_id", "bad_hash") == [(31, True)]


def test_leak_join_equals_contains(spark):
    random.seed(5)
    words = ["red", "blue", "x1", "RG-7", "alpha", "be", "ta", "gam"]
    texts = [(i, 0, " ".join(random.choice(words) for _ in range(random.randrange(1, 60)))) for i in range(150)]
    secrets = sorted({" ".join(random.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for _ in range(6)} | {"ed bl", "lph", "ta gam re"})
    secrets += [texts[3][2][2:-1], texts[9][2][1:]]
    secrets = sorted(set(secrets))
    got = rows(
        leak.canary_hits(spark.createDataFrame(texts, "txn_id int, turn int, text string"), spark.createDataFrame(list(enumerate(secrets)), "canary_id int, canary string")),
        "txn_id", "canary_id", "start",
    )
    want = sorted((i, k, t.find(" ".join(s.split()))) for i, _, t in texts for k, s in enumerate(secrets) if s.strip() and " ".join(s.split()) in t)
    assert got == want


def test_nearest_rank_equals_sorting(spark):
    random.seed(1)
    data = [(f"g{random.randrange(2)}", round(random.lognormvariate(3, 2) * random.choice([1, 1, -1, 0]), 2)) for _ in range(4000)]
    got = {(r[0], r[1]): r[2] for r in metrics.nearest_rank(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    for g in ("g0", "g1"):
        ordered = sorted(v for k, v in data if k == g)
        for p in (50, 95, 99):
            assert got[g, p] == ordered[round(p / 100 * (len(ordered) - 1))]


def test_paging_walks_the_whole_queue(spark):
    df = spark.createDataFrame([(f"a{i:02}", "PENDING" if i % 4 else "DENIED", at(i // 3)) for i in range(30)], "approval_id string, state string, created_at timestamp")
    want = [r[0] for r in df.where("state = 'PENDING'").orderBy(F.desc("created_at"), F.desc("approval_id")).collect()]
    seen, cursor = [], None
    while True:
        page = ap.page(df, ["PENDING"], 7, cursor).orderBy(F.desc("created_at"), F.desc("approval_id")).collect()
        seen += [r["approval_id"] for r in page]
        cursor = page[-1]["next_cursor"] if page else None
        if cursor is None:
            break
    assert seen == want
