"""Aggregation, window and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.operators import approvals as ap
from siftwarden.operators import audit, decide, limits, metrics, redact
from siftwarden.plans import inputs as src
from siftwarden.plans.detection import decided_sql
from siftwarden.plans.registry import ORACLES, query
from siftwarden.plans.scalars import HTTP_SQL, http_log
from siftwarden.sources.readers import table


@query(
    "agg_category_scores",
    f"""WITH {src.FINDINGS_SQL} SELECT txn_id, category, max(score) AS score FROM findings
      WHERE category <> 'DETECTOR_TIMEOUT' GROUP BY ALL""",
)
def agg_category_scores(spark, sf):
    return decide.category_scores(src.findings(spark, sf))


@query(
    "agg_risk_level",
    f"""WITH {src.FINDINGS_SQL}, w AS (SELECT txn_id, max(score) AS s FROM findings
      WHERE category <> 'DETECTOR_TIMEOUT' GROUP BY 1)
    SELECT o_orderkey AS txn_id, {src.level_sql('s')} AS risk_level FROM orders LEFT JOIN w ON o_orderkey = txn_id""",
)
def agg_risk_level(spark, sf):
    txns = table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn_id"))
    return decide.risk(src.findings(spark, sf), txns).select("txn_id", "risk_level")


@query(
    "agg_risk_worse_of",
    f"""WITH {src.FINDINGS_SQL}, w AS (SELECT txn_id, plane = 'response' AS out, max(score) AS s FROM findings
      WHERE category <> 'DETECTOR_TIMEOUT' GROUP BY ALL), l AS (SELECT txn_id, {src.level_sql('s')} AS level FROM w)
    SELECT txn_id, arg_max(level, list_position([{src.sql_list(d.RISK_LEVELS)}], level)) AS risk_level FROM l GROUP BY 1""",
)
def agg_risk_worse_of(spark, sf):
    f = src.findings(spark, sf)
    sides = [decide.risk(f.where(c)) for c in (F.col("plane") == "response", F.col("plane") != "response")]
    both = sides[0].unionByName(sides[1])
    worst = F.max(decide.risk_rank(F.col("risk_level")))
    return both.groupBy("txn_id").agg(decide.risk_name(worst).alias("risk_level"))


def _decision_query(name: str, sql_columns: str, columns):
    query(name, f"WITH {src.DECISIONS_SQL} SELECT txn_id, {sql_columns} FROM decisions")(
        lambda spark, sf: src.decisions(spark, sf).select("txn_id", *columns())
    )


def _rules():
    return F.array_join(F.transform("policy_hits", lambda h: h["rule_id"]), ",").alias("rules")


_decision_query("agg_verdict", "verdict", lambda: ["verdict"])
_decision_query("agg_reason_codes", "reasons", lambda: [F.array_join("reason_codes", ",").alias("reasons")])
_decision_query("agg_policy_hits", "rules", lambda: [_rules()])
_decision_query("agg_transformation", "transformation", lambda: ["transformation"])


@query(
    "agg_matched_categories",
    f"""WITH {src.HITS_SQL} SELECT txn_id, rule_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
      FROM leaf_hits GROUP BY ALL""",
)
def agg_matched_categories(spark, sf):
    hits = src.decisions(spark, sf).select("txn_id", F.explode("policy_hits").alias("h"))
    return hits.select("txn_id", "h.rule_id", F.array_join("h.matched_categories", ",").alias("categories"))


def _per_customer(spark, sf):
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("identity"))
    return src.decisions(spark, sf).join(owner, "txn_id")


@query(
    "agg_combine_decisions",
    f"""WITH {src.DECISIONS_SQL}, o AS (SELECT o_custkey AS identity, d.*, {src.RANK_SQL} AS rk FROM decisions d
        JOIN orders ON o_orderkey = txn_id),
    m AS (SELECT identity, max(rk) AS rank, bool_or(degraded) AS degraded FROM o GROUP BY 1),
    w AS (SELECT o.identity, unnest(string_split(reasons, ',')) AS code FROM o JOIN m ON o.identity = m.identity AND rk = rank),
    r AS (SELECT identity, string_agg(DISTINCT code, ',' ORDER BY code) FILTER (WHERE code <> '') AS reasons FROM w GROUP BY 1),
    h AS (SELECT o.identity, count(DISTINCT rule_id) AS n_rules FROM o JOIN hits USING (txn_id) GROUP BY 1)
    SELECT m.identity, {src.VERDICT_SQL} AS verdict, coalesce(r.reasons, '') AS reasons,
      coalesce(h.n_rules, 0)::BIGINT AS n_rules, degraded
    FROM m LEFT JOIN r ON m.identity = r.identity LEFT JOIN h ON m.identity = h.identity""",
)
def agg_combine_decisions(spark, sf):
    merged = decide.combine(_per_customer(spark, sf), "identity")
    rules = F.array_distinct(F.transform("policy_hits", lambda h: h["rule_id"]))
    return merged.select(
        "identity", "verdict", F.array_join("reason_codes", ",").alias("reasons"),
        F.size(rules).cast("bigint").alias("n_rules"), "degraded",
    )


# What answers say in front of their text, and the tool call they propose, by request number.
_ANSWERS = ("", "Your record shows 123-45-6789 on file.", "Write to dana.reyes@example.com.", "")
_PROPOSED = (
    None, ("wire_transfer", '{"amount": 5000}'), ("run_sql", '{"query": "DROP TABLE customers;"}'), ("search_docs", '{"query": "terms"}'),
    ("search_docs", '{"query": '),
)
_ANSWER_CASE = " ".join(f"WHEN {i} THEN {src.quote(a)}" for i, a in enumerate(_ANSWERS))
_ANSWERED_SQL = f"""SELECT txn_id AS real, 0 AS turn, 'response' AS plane,
  {src.norm_sql(f"(CASE txn_id % 4 {_ANSWER_CASE} END || ' ' || text)")} AS norm
  FROM (SELECT conv_id AS txn_id, arg_max(coalesce(text, ''), turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1)"""


@query(
    "agg_output_guard",
    f"""WITH {decided_sql(_ANSWERED_SQL)},
    asked AS (SELECT DISTINCT conv_id AS txn_id FROM conversations WHERE role = 'assistant')
    SELECT txn_id, CASE WHEN txn_id % 5 IN (1, 2) OR coalesce(verdict, 'ALLOW') <> 'ALLOW' THEN 'DENY' ELSE 'ALLOW' END AS verdict,
      CASE WHEN txn_id % 5 IN (1, 2) OR coalesce(verdict, 'ALLOW') <> 'ALLOW' THEN 'NONE' ELSE coalesce(transformation, 'NONE') END AS transformation
    FROM asked LEFT JOIN decisions USING (txn_id)""",
)
def agg_output_guard(spark, sf):
    """Answers behind planted values, with planted tool calls in their bodies."""
    from siftwarden.operators import messages as ms
    from siftwarden.operators.corpus import guard_responses

    msgs = src.conversations(spark, sf)
    said = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("txn_id") % len(_ANSWERS) + 1).cast("int"))
    answers = ms.responses(msgs).withColumn("text", F.concat(said, F.lit(" "), "text"))
    call = F
    for i, proposed in enumerate(_PROPOSED):
        if proposed:
            function = F.struct(F.lit(proposed[0]).alias("name"), F.lit(proposed[1]).alias("arguments"))
            call = call.when(F.col("txn_id") % len(_PROPOSED) == i, F.array(F.struct(function.alias("function"))))
    message = F.struct(F.col("text").alias("content"), call.alias("tool_calls"))
    bodies = answers.select("txn_id", F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))).alias("body"))
    canaries = spark.createDataFrame(list(enumerate(src.POLICY.canaries)), "canary_id bigint, canary string")
    decided = guard_responses(answers, ms.system_prompts(msgs), src.POLICY, src.SALT, canaries, bodies)
    return decided.select("txn_id", "verdict", "transformation")


@query(
    "agg_findings_summary",
    f"""WITH {src.DECISIONS_SQL} SELECT f.txn_id, f.detector_id, f.category,
      arg_min(f.confidence, struct_pack(a := f.ord, b := f.ord2)) AS confidence
    FROM findings f JOIN decisions d ON f.txn_id = d.txn_id AND list_contains(string_split(d.reasons, ','), f.category)
    GROUP BY ALL""",
)
def agg_findings_summary(spark, sf):
    reasons = src.decisions(spark, sf).select("txn_id", F.explode("reason_codes").alias("category"))
    kept = src.findings(spark, sf).join(reasons, ["txn_id", "category"], "left_semi")
    return kept.groupBy("txn_id", "detector_id", "category").agg(
        F.min_by("confidence", F.struct("ord", "ord2")).alias("confidence")
    )


@query(
    "agg_detector_versions",
    f"""WITH {src.FINDINGS_SQL}, v AS (SELECT DISTINCT txn_id, detector_id, '1.' || (ord2 % 3) || '.0' AS version FROM findings)
    SELECT txn_id, string_agg(detector_id || '=' || version, ',' ORDER BY detector_id, version) AS detectors FROM v GROUP BY 1""",
)
def agg_detector_versions(spark, sf):
    version = F.concat(F.lit("1."), (F.col("ord2") % 3).cast("string"), F.lit(".0"))
    named = F.struct("detector_id", "version")
    return src.findings(spark, sf).withColumn("version", version).groupBy("txn_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_set(named)), lambda x: F.concat(x["detector_id"], F.lit("="), x["version"])), ","
        ).alias("detectors")
    )


@query(
    "agg_degraded",
    f"""WITH {src.FINDINGS_SQL}, m AS (SELECT txn_id, bool_or(score >= 0.5) AS timed_out FROM findings
      WHERE category = 'DETECTOR_TIMEOUT' GROUP BY 1)
    SELECT CASE WHEN timed_out THEN 'detector_timeout' ELSE 'detector_error' END AS reason, count(*) AS n FROM m GROUP BY 1""",
)
def agg_degraded(spark, sf):
    marks = src.findings(spark, sf).where(F.col("category") == d.OPERATIONAL_CATEGORY)
    kind = F.when(F.col("score") >= 0.5, d.OPERATIONAL_CATEGORY).otherwise("DETECTOR_ERROR")
    return decide.degraded(marks.withColumn("category", kind)).groupBy("reason").agg(F.count("*").alias("n"))


_STATES = ", ".join(f"('{s}')" for s in d.APPROVAL_STATES)


@query(
    "agg_queue_depth",
    f"""WITH {src.APPROVALS_SQL} SELECT s.state, count(approval_id) AS n FROM (VALUES {_STATES}) s(state)
      LEFT JOIN approvals a ON a.state = s.state GROUP BY s.state""",
)
def agg_queue_depth(spark, sf):
    return ap.queue_depth(src.approvals(spark, sf).select("state"))


@query(
    "agg_counters",
    f"""WITH {src.DECISIONS_SQL}
    SELECT 'decisions_total' AS name, verdict AS label, count(*) AS value FROM decisions GROUP BY ALL
    UNION ALL SELECT 'risk_level_total', risk_level, count(*) FROM decisions GROUP BY ALL
    UNION ALL SELECT 'transformations_total', transformation, count(*) FROM decisions WHERE transformation <> 'NONE' GROUP BY ALL
    UNION ALL SELECT 'upstream_calls_avoided_total', verdict, count(*) FROM decisions WHERE verdict = 'DENY' GROUP BY ALL
    UNION ALL SELECT 'policy_hits_total', rule_id, count(*) FROM hits GROUP BY ALL
    UNION ALL SELECT 'reason_codes_total', code, count(*) FROM
      (SELECT unnest(string_split(reasons, ',')) AS code FROM decisions) WHERE code <> '' GROUP BY ALL""",
)
def agg_counters(spark, sf):
    return metrics.decision_counters(src.decisions(spark, sf))


@query(
    "agg_http_counters",
    f"""WITH {HTTP_SQL} SELECT endpoint, status_class, count(*) AS n, round(sum(seconds::DECIMAL(28,6))::DOUBLE, 4) AS seconds
      FROM http GROUP BY ALL""",
)
def agg_http_counters(spark, sf):
    total = F.round(F.sum(F.col("seconds").cast("decimal(28,6)")).cast("double"), 4)
    return http_log(spark, sf).groupBy("endpoint", "status_class").agg(F.count("*").alias("n"), total.alias("seconds"))


_BOUNDS = ", ".join(f"('{float(b)!r}', {b}::DOUBLE)" for b in d.HISTOGRAM_BOUNDS)


@query(
    "agg_histogram",
    f"""WITH {HTTP_SQL}, b(le, bound) AS (VALUES {_BOUNDS}, ('+Inf', 'infinity'::DOUBLE))
    SELECT endpoint, le, count(*) FILTER (WHERE seconds <= bound) AS n FROM http CROSS JOIN b GROUP BY ALL""",
)
def agg_histogram(spark, sf):
    return metrics.histogram(http_log(spark, sf), "endpoint", "seconds")


@query(
    "agg_wait_time",
    """SELECT l_returnflag AS outcome, count(*) AS n, min(date_diff('day', o_orderdate, l_shipdate)) AS min_days,
      max(date_diff('day', o_orderdate, l_shipdate)) AS max_days,
      sum(date_diff('day', o_orderdate, l_shipdate))::BIGINT AS sum_days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def agg_wait_time(spark, sf):
    taken = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    made = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.date_diff("l_shipdate", "o_orderdate").cast("bigint")
    return taken.join(made, "l_orderkey").groupBy(F.col("l_returnflag").alias("outcome")).agg(
        F.count("*").alias("n"), F.min(days).alias("min_days"), F.max(days).alias("max_days"),
        F.sum(days).alias("sum_days"),
    )


_PCT = ", ".join(
    f"max(v) FILTER (WHERE rn = round_even({p} / 100.0 * (n - 1), 0)::BIGINT + 1) AS p{p}" for p in (50, 95, 99)
)


@query(
    "agg_latency_summary",
    f"""WITH r AS (SELECT l_returnflag || l_linestatus AS shape, l_extendedprice AS v,
      row_number() OVER (PARTITION BY shape ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY shape) AS n FROM lineitem)
    SELECT shape, max(n) AS n, round(sum(v::DECIMAL(28,6))::DOUBLE / max(n), 6) AS mean, min(v) AS min, max(v) AS max, {_PCT}
    FROM r GROUP BY shape""",
)
def agg_latency_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("shape"), "l_extendedprice"
    )
    return metrics.latency_summary(rows, "shape", "l_extendedprice").withColumn("mean", F.round("mean", 6))


@query(
    "agg_latency_approx",
    "SELECT event_type, count(value) AS n, true AS p50_ok, true AS p95_ok, true AS p99_ok FROM events GROUP BY 1",
)
def agg_latency_approx(spark, sf):
    """Whether each approximate percentile has its rank, within one part in a thousand."""
    events = table(spark, sf, "events")
    approx = metrics.approx_summary(events, "event_type", "value")
    ranks = events.select("event_type", "value").join(approx, "event_type").groupBy("event_type", "n").agg(
        *[F.count_if(F.col("value") < F.col(p)).alias(f"{p}_less") for p in ("p50", "p95", "p99")],
        *[F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_most") for p in ("p50", "p95", "p99")],
    )
    slack = F.col("n") / 1000 + 1
    ok = [
        ((F.col(f"{p}_less") <= F.col("n") * q + slack) & (F.col(f"{p}_most") >= F.col("n") * q - slack)).alias(f"{p}_ok")
        for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    ]
    return ranks.select("event_type", "n", *ok)


@query(
    "agg_throughput",
    """SELECT event_type, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 9) AS per_second
       FROM events GROUP BY 1""",
)
def agg_throughput(spark, sf):
    out = metrics.throughput(src.requests(spark, sf), "event_type", "ts")
    return out.select("event_type", "n", F.round("per_second", 9).alias("per_second"))


@query(
    "agg_status_counts",
    f"""WITH {HTTP_SQL} SELECT endpoint, count(*) FILTER (WHERE code = 200) AS c200, count(*) FILTER (WHERE code = 202) AS c202,
      count(*) FILTER (WHERE code = 403) AS c403, count(*) FILTER (WHERE code = 500) AS c500 FROM http GROUP BY 1""",
)
def agg_status_counts(spark, sf):
    codes = (200, 202, 403, 500)
    wide = http_log(spark, sf).groupBy("endpoint").pivot("code", list(codes)).count()
    return wide.select("endpoint", *[F.coalesce(str(c), F.lit(0)).alias(f"c{c}") for c in codes])


@query(
    "agg_calls_avoided",
    f"""WITH {src.DECISIONS_SQL}, {src.APPROVALS_SQL} SELECT verdict, count(*) AS n FROM decisions d LEFT JOIN approvals a ON transaction_id = txn_id
      WHERE verdict = 'DENY' OR (verdict = 'NEED_APPROVAL' AND state IN ('DENIED', 'EXPIRED', 'FAILED')) GROUP BY 1""",
)
def agg_calls_avoided(spark, sf):
    state = src.approvals(spark, sf).select(F.col("transaction_id").alias("txn_id"), "state")
    held = (F.col("verdict") == "NEED_APPROVAL") & F.col("state").isin("DENIED", "EXPIRED", "FAILED")
    joined = src.decisions(spark, sf).select("txn_id", "verdict").join(state, "txn_id", "left")
    return joined.where((F.col("verdict") == "DENY") | held).groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "agg_cost_avoided",
    f"""WITH {src.DECISIONS_SQL}, t AS (SELECT greatest(1, length(text) // 4) AS tokens FROM conversations JOIN decisions ON conv_id = txn_id
      WHERE verdict = 'DENY')
    SELECT count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / 1000000 * 0.15, 9) AS cost,
      round(sum(tokens) / 1000000 * 0.15 / count(*) * 1000, 9) AS cost_per_1000 FROM t""",
)
def agg_cost_avoided(spark, sf):
    denied = src.decisions(spark, sf).where(F.col("verdict") == "DENY").select("txn_id")
    calls = src.conversations(spark, sf).join(denied, "txn_id", "left_semi")
    out = metrics.avoided_cost(calls.select(metrics.token_estimate(F.col("text")).alias("tokens")))
    return out.select("calls", "tokens", F.round("cost", 9).alias("cost"), F.round("cost_per_1000", 9).alias("cost_per_1000"))


@query(
    "agg_corpus_score",
    f"""WITH {src.DECISIONS_SQL} SELECT CASE toxic WHEN 1 THEN 'TOXIC' ELSE 'BENIGN' END AS category, count(*) AS n,
      count(*) FILTER (WHERE (coalesce(verdict, 'ALLOW') = 'DENY') = (toxic = 1)) AS n_ok,
      round(count(*) FILTER (WHERE (coalesce(verdict, 'ALLOW') = 'DENY') = (toxic = 1)) / count(*), 9) AS share
    FROM labels LEFT JOIN decisions ON doc_id = txn_id GROUP BY 1""",
)
def agg_corpus_score(spark, sf):
    from siftwarden.operators.corpus import score

    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("txn_id"), "toxic")
    # A case without findings is allowed.
    joined = cases.join(src.decisions(spark, sf).select("txn_id", "verdict"), "txn_id", "left")
    verdict = F.coalesce("verdict", F.lit("ALLOW"))
    compared = joined.select(
        F.when(F.col("toxic") == 1, "TOXIC").otherwise("BENIGN").alias("category"),
        ((verdict == "DENY") == (F.col("toxic") == 1)).alias("ok"),
    )
    return score(compared).withColumn("share", F.round("share", 9))


_EXPECTED = ", ".join(f"({i}, '{c}', {n})" for i, (c, n) in enumerate(d.CORPUS_DISTRIBUTION.items()))


@query(
    "agg_corpus_distribution",
    f"""WITH expected(i, category, expected) AS (VALUES {_EXPECTED}),
    c AS (SELECT doc_id, count(*) AS k FROM labels GROUP BY 1),
    counted AS (SELECT doc_id % {len(d.CORPUS_DISTRIBUTION)} AS i, sum(k)::BIGINT AS n, count(*) FILTER (k > 1) AS repeated_ids FROM c GROUP BY 1)
    SELECT category, expected::BIGINT AS expected, coalesce(n, 0) AS n, coalesce(repeated_ids, 0) AS repeated_ids
    FROM expected LEFT JOIN counted USING (i)""",
)
def agg_corpus_distribution(spark, sf):
    from siftwarden.operators.corpus import distribution

    buckets = F.element_at(
        F.array(*[F.lit(c) for c in d.CORPUS_DISTRIBUTION]),
        (F.col("doc_id") % len(d.CORPUS_DISTRIBUTION) + 1).cast("int"),
    )
    return distribution(table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), buckets.alias("category")))


@query(
    "agg_stats_totals",
    f"""WITH {src.APPROVALS_SQL} SELECT count(*) AS approvals, count(*) FILTER (WHERE state = 'PENDING') AS pending,
      (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS decisions, (SELECT count(*) FROM events) AS http_requests FROM approvals""",
)
def agg_stats_totals(spark, sf):
    a = src.approvals(spark, sf).agg(
        F.count("*").alias("approvals"), F.count_if(F.col("state") == "PENDING").alias("pending")
    )
    n = src.decisions(spark, sf).agg(F.count("*").alias("decisions"))
    e = table(spark, sf, "events").agg(F.count("*").alias("http_requests"))
    # Three single rows side by side.
    key = F.lit(1).alias("k")
    one = a.select("*", key).join(n.select("*", key), "k").join(e.select("*", key), "k")
    return one.drop("k")


# --- windows ------------------------------------------------------------------------------

_LIMIT, _WINDOW = 3, 21600


@query(
    "win_rate_limit",
    f"""WITH r AS (SELECT event_id AS request_id, user_id AS identity, (epoch_us(ts) // {_WINDOW * 1000000}) * {_WINDOW} AS window_start,
      epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // {_WINDOW * 1000000} ORDER BY ts, event_id) AS n FROM events)
    SELECT request_id, identity, window_start, n <= {_LIMIT} AS allowed, greatest(0, {_LIMIT} - n)::BIGINT AS remaining,
      CASE WHEN n > {_LIMIT} THEN greatest(1, ceil(window_start + {_WINDOW} - us / 1000000))::BIGINT ELSE 0 END AS retry_after FROM r""",
)
def win_rate_limit(spark, sf):
    rows = src.requests(spark, sf).select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("identity"), "ts"
    )
    return limits.rate_limit(rows, _LIMIT, _WINDOW).drop("ts")


_SPAN_LABELS = {"A": "EMAIL", "N": "SSN", "R": "PEM_PRIVATE_KEY"}


@query(
    "win_merge_spans",
    f"""WITH s AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS pos,
      (l_orderkey * 7)::BIGINT AS st, (l_orderkey * 7 + l_quantity)::BIGINT AS en, {src.case_sql('l_returnflag', _SPAN_LABELS)} AS label FROM lineitem),
    g AS (SELECT *, CASE WHEN st < max(en) OVER (PARTITION BY l_suppkey ORDER BY st, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 0 ELSE 1 END AS opens FROM s),
    i AS (SELECT *, sum(opens) OVER (PARTITION BY l_suppkey ORDER BY st, pos) AS island FROM g)
    SELECT l_suppkey AS doc_id, min(st) AS start_pos, max(en) AS end_pos,
      CASE max(CASE label WHEN 'PEM_PRIVATE_KEY' THEN 6 WHEN 'SSN' THEN 4 ELSE 2 END) WHEN 6 THEN 'PEM_PRIVATE_KEY' WHEN 4 THEN 'SSN' ELSE 'EMAIL' END AS label
    FROM i GROUP BY l_suppkey, island""",
)
def win_merge_spans(spark, sf):
    start = (F.col("l_orderkey") * 7).cast("bigint")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"),
        (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey")).alias("pos"), start.alias("start"),
        (start + F.col("l_quantity")).cast("bigint").alias("end"),
        src.case_col("l_returnflag", _SPAN_LABELS).alias("label"),
    )
    merged = redact.merge_span_rows(rows, "doc_id")
    return merged.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "label")


_CHAIN_SQL = f"""WITH RECURSIVE r AS (SELECT user_id, event_id, '{{"k":' || json_extract_string(props, '$.k') || '}}' AS payload,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  c(user_id, rn, event_id, prev_hash, event_hash) AS (
    SELECT user_id, rn, event_id, '{audit.GENESIS}', 'sha256:' || sha256('{audit.GENESIS}' || payload) FROM r WHERE rn = 1
    UNION ALL SELECT r.user_id, r.rn, r.event_id, c.event_hash, 'sha256:' || sha256(c.event_hash || r.payload)
    FROM c JOIN r ON r.user_id = c.user_id AND r.rn = c.rn + 1)"""


@query(
    "win_hash_chain_build",
    f"{_CHAIN_SQL} SELECT user_id AS stream_id, event_id, prev_hash, event_hash FROM c",
)
def win_hash_chain_build(spark, sf):
    return audit.build_chain(src.audit_events(spark, sf)).drop("payload")


@query(
    "win_hash_chain_verify",
    f"""{_CHAIN_SQL} SELECT c.user_id AS stream_id, c.event_id, (coalesce(b.event_id, 1) % 97 = 0 AND b.event_id IS NOT NULL) AS bad_link,
      c.event_id % 97 = 0 AS bad_hash FROM c LEFT JOIN c b ON b.user_id = c.user_id AND b.rn = c.rn - 1
      WHERE c.event_id % 97 = 0 OR (b.event_id % 97 = 0)""",
)
def win_hash_chain_verify(spark, sf):
    """Verification of a chain some of whose rows were tampered with."""
    chained = audit.build_chain(src.audit_events(spark, sf))
    # A letter that is no hex digit: the forged hash always differs.
    forged = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("sha256:x"), F.substring("event_hash", 9, 63)))
    tampered = chained.withColumn("event_hash", F.coalesce(forged, F.col("event_hash")))
    return audit.broken_links(tampered, slice_of=F.floor(F.col("event_id") / 1000))


@query(
    "win_latest_state",
    f"""WITH {src.APPROVAL_EVENTS_SQL} SELECT approval_id, arg_max(to_state, struct_pack(a := ts, b := seq)) AS state, count(*) AS n_events
      FROM approval_events GROUP BY 1""",
)
def win_latest_state(spark, sf):
    return ap.latest_state(src.approval_events(spark, sf))


@query(
    "win_counter_increase",
    """WITH e AS (SELECT event_type AS series, epoch_us(ts) AS us, json_extract_string(props, '$.k')::BIGINT AS value, ts, event_id FROM events),
    b AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, event_id) AS before FROM e)
    SELECT series, us, value, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS increase FROM b""",
)
def win_counter_increase(spark, sf):
    scrapes = src.requests(spark, sf).select(
        F.col("event_type").alias("series"), "ts", F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("value")
    )
    out = metrics.counter_increase(scrapes)
    return out.select("series", F.unix_micros("ts").alias("us"), "value", "increase")


# --- top-k ------------------------------------------------------------------------------------


@query(
    "page_approvals",
    f"""WITH {src.APPROVALS_SQL}, q AS (SELECT approval_id, state, created_at, row_number() OVER (ORDER BY created_at DESC, approval_id DESC) AS rn,
      count(*) OVER () AS total FROM approvals WHERE state IN ('PENDING', 'APPROVED')),
    k AS (SELECT rn FROM q WHERE approval_id = (SELECT approval_id FROM q WHERE rn = 50))
    SELECT approval_id, state, epoch_us(created_at) AS created_us,
      CASE WHEN total > (SELECT rn FROM k) + 25 THEN (SELECT approval_id FROM q WHERE rn = (SELECT rn FROM k) + 25) END AS next_cursor
    FROM q WHERE rn > (SELECT rn FROM k) AND rn <= (SELECT rn FROM k) + 25""",
)
def page_approvals(spark, sf):
    rows = src.approvals(spark, sf).select("approval_id", "state", "created_at")
    open_states = ["PENDING", "APPROVED"]
    first = ap.page(rows, open_states, 50)
    cursor = first.select("next_cursor").first()[0]
    second = ap.page(rows, open_states, 25, cursor)
    return second.select("approval_id", "state", F.unix_micros("created_at").alias("created_us"), "next_cursor")


@query(
    "top_recent_decisions",
    """SELECT event_id AS id, user_id AS reviewer, event_type AS decision FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""",
)
def top_recent_decisions(spark, sf):
    rows = src.requests(spark, sf).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("reviewer"), F.col("event_type").alias("decision"),
        F.col("ts").alias("created_at"),
    )
    return ap.recent_decisions(rows).drop("created_at")


@query(
    "top_series",
    f"WITH {src.HITS_SQL} SELECT reason_code AS name, count(*) AS value FROM hits GROUP BY 1 ORDER BY value DESC, name",
)
def top_series(spark, sf):
    hits = src.decisions(spark, sf).select(F.explode("policy_hits").alias("h"))
    counts = hits.groupBy(F.col("h.reason_code").alias("name")).agg(F.count("*").alias("value"))
    return metrics.series(counts)


@query(
    "sink_audit_jsonl",
    """SELECT '{"actor_id": "' || user_id || '", "actor_type": "reviewer", "approval_id": null, "correlation_id": "cor_' || user_id
      || '", "created_at": "' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '", "event_hash": "h' || event_id
      || '", "event_type": "' || event_type || '", "id": "evt_' || event_id || '", "payload": ' || props
      || ', "prev_hash": "p' || event_id || '", "transaction_id": "txn_' || event_id // 10 || '"}' AS value
    FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def sink_audit_jsonl(spark, sf):
    key = F.col("event_id").cast("string")
    rows = src.requests(spark, sf).select(
        F.concat(F.lit("evt_"), key).alias("id"),
        F.concat(F.lit("txn_"), F.floor(F.col("event_id") / 10).cast("string")).alias("transaction_id"),
        F.lit(None).cast("string").alias("approval_id"),
        F.concat(F.lit("cor_"), F.col("user_id").cast("string")).alias("correlation_id"), "event_type",
        F.lit("reviewer").alias("actor_type"), F.col("user_id").cast("string").alias("actor_id"),
        F.col("props").alias("payload"), F.concat(F.lit("p"), key).alias("prev_hash"),
        F.concat(F.lit("h"), key).alias("event_hash"), F.col("ts").alias("created_at"),
    )
    return audit.export_lines(rows, "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z")


# --- all counters as rows -----------------------------------------------------------------------


def _family_sql(name: str, labels: dict[str, str], rows: str) -> str:
    rendered = " || ',' || ".join(f"'{k}=' || {v}" for k, v in labels.items())
    return f"SELECT '{name}' AS name, {rendered} AS labels, count(*)::DOUBLE AS value FROM {rows} GROUP BY ALL"


_ALLOWED_TOOLS = src.sql_list(src.POLICY.tool_allowlist)
_TOOL_NAME = f"CASE WHEN tool IN ({_ALLOWED_TOOLS}) THEN tool ELSE 'other' END"
_OPEN = "'PENDING', 'APPROVED'"
_METRICS_SQL = " UNION ALL ".join(
    _family_sql(*family)
    for family in (
        ("http_requests_total", {"endpoint": "endpoint", "status_class": "status_class"}, "http"),
        ("errors_total", {"error_code": "code"}, "(SELECT * FROM http WHERE code >= 400)"),
        ("tool_calls_total", {"tool": "tool"}, "calls"),
        ("output_decisions_total", {"verdict": "CASE verdict WHEN 'NEED_APPROVAL' THEN 'DENY' ELSE verdict END"}, "decisions"),
        ("detector_failures_total", {"detector_id": "detector_id", "reason": "'timeout'"}, "(SELECT * FROM findings WHERE category = 'DETECTOR_TIMEOUT')"),
        ("degraded_transactions_total", {"reason": "'timeout'"}, "(SELECT * FROM decisions WHERE degraded)"),
        ("approvals_total", {"state": "state"}, "approvals"),
        ("approval_queue_depth", {"state": "state"}, f"(SELECT * FROM approvals WHERE state IN ({_OPEN}))"),
        ("rate_limited_total", {"scope": "'identity'"}, f"(SELECT * FROM ({ORACLES['win_rate_limit']}) WHERE NOT allowed)"),
        ("tool_findings_total", {"tool_name": _TOOL_NAME, "category": "'TOOL_NOT_ALLOWLISTED'"}, f"(SELECT * FROM calls WHERE tool NOT IN ({_ALLOWED_TOOLS}))"),
        ("tool_findings_total", {"tool_name": _TOOL_NAME, "category": "'SENSITIVE_ACTION'"},
         "(SELECT * FROM calls WHERE tool IN ('wire_transfer', 'create_payment', 'initiate_transfer') AND amount >= 1000)"),
    )
)


@query(
    "sink_metrics_long",
    f"""WITH {HTTP_SQL}, {src.CALLS_SQL}, {src.APPROVALS_SQL}, {src.DECISIONS_SQL} {_METRICS_SQL}
    UNION ALL SELECT 'policy_info', 'policy_version={src.POLICY.version},schema_version=1', 1::DOUBLE""",
)
def sink_metrics_long(spark, sf):
    """Metric families with their labels, each counted with partial counts before the shuffle."""
    from siftwarden.operators import tools

    http, calls, approvals = http_log(spark, sf), src.calls(spark, sf), src.approvals(spark, sf)
    decisions, timeout = src.decisions(spark, sf), F.lit("timeout")
    bounded = metrics.bounded(F.col("tool"), src.POLICY.tool_allowlist, "other").alias("tool_name")
    info = spark.range(1).select(F.lit(src.POLICY.version).alias("policy_version"), F.lit(1).alias("schema_version"))
    return metrics.counters(
        {
            "http_requests_total": (http, ["endpoint", "status_class"]),
            "errors_total": (http.where("code >= 400").withColumn("error_code", F.col("code")), ["error_code"]),
            "tool_calls_total": (calls, ["tool"]),
            "output_decisions_total": (decide.guard_output(decisions), ["verdict"]),
            "detector_failures_total": (
                src.findings(spark, sf).where(F.col("category") == d.OPERATIONAL_CATEGORY).withColumn("reason", timeout), ["detector_id", "reason"],
            ),
            "degraded_transactions_total": (decisions.where("degraded").withColumn("reason", timeout), ["reason"]),
            "approvals_total": (approvals, ["state"]),
            "approval_queue_depth": (approvals.where(f"state IN ({_OPEN})"), ["state"]),
            "rate_limited_total": (win_rate_limit(spark, sf).where("NOT allowed").withColumn("scope", F.lit("identity")), ["scope"]),
            "tool_findings_total": (tools.scan_calls(calls, src.POLICY, src.SALT).select(bounded, "category"), ["tool_name", "category"]),
            "policy_info": (info, ["policy_version", "schema_version"]),
        }
    )
