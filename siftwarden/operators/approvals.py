"""The approval workflow as jobs over approval tables and event logs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions.ordered import hour_slice, with_previous
from siftwarden.sources.sinks import written

# --- creation and expiry ------------------------------------------------------


def create(decisions: DataFrame, ttl_seconds: int = d.APPROVAL_TTL_SECONDS) -> DataFrame:
    """Held decisions as pending approvals.

    ``decisions`` carries created_at, creator and material_hash; only the rules
    that asked for the hold are kept as its hits.
    """
    held = decisions.where(F.col("verdict") == "NEED_APPROVAL")
    holds = F.filter("policy_hits", lambda h: h["verdict"] == "NEED_APPROVAL")
    return held.select(
        F.concat(F.lit("apr_"), F.col("txn_id").cast("string")).alias("approval_id"),
        F.col("txn_id").alias("transaction_id"),
        F.lit("PENDING").alias("state"),
        "risk_level",
        "reason_codes",
        F.transform(holds, lambda h: h["rule_id"]).alias("policy_hits"),
        "material_hash",
        "creator",
        F.lit(0).alias("resume_attempts"),
        "created_at",
        (F.col("created_at") + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
    )


def elapsed(now: Column) -> Column:
    return F.col("state").isin("PENDING", "APPROVED") & (F.col("expires_at") <= now)


def sweep(approvals: DataFrame, now: Column) -> DataFrame:
    """Expire what has elapsed; running it again changes nothing."""
    return approvals.withColumn("state", F.when(elapsed(now), "EXPIRED").otherwise(F.col("state")))


def reconcile(approvals: DataFrame, max_attempts: int = d.MAX_RESUME_ATTEMPTS) -> DataFrame:
    """After a restart: stuck resumes go back to APPROVED, or to FAILED when used up."""
    stuck = F.col("state") == "RESUMING"
    fresh = F.col("resume_attempts") < max_attempts
    return approvals.withColumn(
        "state",
        F.when(stuck & fresh, "APPROVED").when(stuck, "FAILED").otherwise(F.col("state")),
    )


def age_and_deadline(approvals: DataFrame, now: Column) -> DataFrame:
    """Seconds waiting and left, and the way a queue shows them."""
    age = F.floor((F.unix_micros(now) - F.unix_micros("created_at")) / 1_000_000)
    left = F.floor((F.unix_micros("expires_at") - F.unix_micros(now)) / 1_000_000)

    def in_units(seconds: Column, start: Column, prefix: str, suffix: str) -> Column:
        def unit(size: int, letter: str) -> Column:
            n = F.floor(seconds / size).cast("string")
            return F.concat(F.lit(prefix), n, F.lit(letter + suffix))

        return (
            start.when(seconds < 3600, unit(60, "m"))
            .when(seconds < 86400, unit(3600, "h"))
            .otherwise(unit(86400, "d"))
        )

    soon = F.concat(F.lit("in "), left.cast("string"), F.lit("s"))
    return approvals.select(
        "*",
        age.alias("age_seconds"),
        left.alias("left_seconds"),
        in_units(age, F.when(age < 45, "just now"), "", " ago").alias("age_text"),
        in_units(left, F.when(left <= 0, "expired").when(left < 60, soon), "in ", "").alias("left_text"),
    )


# --- replaying event logs -------------------------------------------------------


def edges_column(source: Column, target: Column) -> Column:
    """Whether a transition is allowed."""
    allowed = F.lit(False)
    for a, b in d.APPROVAL_EDGES:
        allowed = allowed | ((source == a) & (target == b))
    return allowed


_CODE = {state: i for i, state in enumerate(d.APPROVAL_STATES)}


def _step_sql(state: str, code: str) -> str:
    """SQL: the state after an event; an illegal or unknown event changes nothing."""
    n = len(d.APPROVAL_STATES)
    legal = [["NULL"] * n for _ in range(n)]
    for a, b in d.APPROVAL_EDGES:
        legal[_CODE[b]][_CODE[a]] = str(_CODE[b])
    rows = ", ".join("array(" + ", ".join(f"CAST({x} AS INT)" for x in row) + ")" for row in legal)
    return f"coalesce(get(get(array({rows}), {code}), {state}), {state})"


def _runs(events: DataFrame) -> DataFrame:
    """The events of each approval and hour in order: (approval_id, slice, run)."""
    states = F.array(*[F.lit(s) for s in d.APPROVAL_STATES])
    code = F.coalesce(F.array_position(states, F.col("to_state")) - 1, F.lit(-1)).cast("int")
    rows = events.select(
        "approval_id", hour_slice(F.col("ts")).alias("slice"),
        F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"), code.alias("code"), "to_state").alias("e"),
    )
    return rows.groupBy("approval_id", "slice").agg(F.array_sort(F.collect_list("e")).alias("run"))


def _maps(runs: DataFrame) -> DataFrame:
    """Each run as a map from the state before it to the state after it, and how many events it rejects."""
    step = _step_sql("a.s", "e.code")
    one = f"""aggregate(run, named_struct('s', s, 'bad', 0L),
      (a, e) -> named_struct('s', {step}, 'bad', a.bad + CASE WHEN {step} = a.s THEN 1L ELSE 0L END))"""
    return runs.select(
        "approval_id", "slice", F.size("run").cast("bigint").alias("n"),
        F.expr(f"transform(sequence(0, {len(d.APPROVAL_STATES) - 1}), s -> {one})").alias("m"),
    )


def replay(events: DataFrame) -> DataFrame:
    """Fold each approval's events (approval_id, ts, seq, to_state), from PENDING.

    A run of events is a map from the state before it to the state after it, and such
    maps compose: the events of one approval and hour are reduced to one map, and only
    those maps are gathered per approval. A task holds one approval's hour at most.
    """
    folded = _maps(_runs(events)).groupBy("approval_id").agg(
        F.expr(
            """aggregate(array_sort(collect_list(struct(slice, n, m))), named_struct('s', 0, 'bad', 0L, 'n', 0L),
                 (acc, r) -> named_struct('s', r.m[acc.s].s, 'bad', acc.bad + r.m[acc.s].bad, 'n', acc.n + r.n))"""
        ).alias("f")
    )
    return folded.select(
        "approval_id",
        F.element_at(F.array(*[F.lit(s) for s in d.APPROVAL_STATES]), F.col("f.s") + 1).alias("state"),
        F.col("f.n").alias("n_events"),
        F.col("f.bad").alias("n_rejected"),
    )


def latest_state(events: DataFrame) -> DataFrame:
    """The last reported state of each approval."""
    return events.groupBy("approval_id").agg(
        F.max_by("to_state", F.struct("ts", "seq")).alias("state"), F.count("*").alias("n_events")
    )


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events that no allowed edge explains, from the state the approval was really in."""
    runs = _runs(events)
    starts = _maps(runs).groupBy("approval_id").agg(
        F.expr(
            """aggregate(array_sort(collect_list(struct(slice, m))),
                 named_struct('s', 0, 'at', CAST(array() AS array<struct<slice: bigint, s: int>>)),
                 (acc, r) -> named_struct('s', r.m[acc.s].s, 'at', concat(acc.at, array(named_struct('slice', r.slice, 's', acc.s))))).at"""
        ).alias("at")
    ).select("approval_id", F.inline("at"))
    step = _step_sql("a.s", "e.code")
    kind = "array<struct<seq: bigint, s: int, to_state: string>>"
    wrong = F.expr(
        f"""aggregate(run, named_struct('s', s, 'bad', CAST(array() AS {kind})), (a, e) -> named_struct('s', {step}, 'bad',
              CASE WHEN {step} = a.s THEN concat(a.bad, array(named_struct('seq', e.seq, 's', a.s, 'to_state', e.to_state)))
                   ELSE a.bad END)).bad"""
    )
    found = runs.join(starts, ["approval_id", "slice"]).select("approval_id", F.inline(wrong))
    state = F.element_at(F.array(*[F.lit(s) for s in d.APPROVAL_STATES]), F.col("s") + 1)
    return found.select("approval_id", "seq", state.alias("from_state"), "to_state")


# --- decisions --------------------------------------------------------------------


def replayed_or_conflicting(requests: DataFrame) -> DataFrame:
    """Requests whose idempotency key was used before: same body or another one."""
    firsts = requests.groupBy("idempotency_key").agg(
        F.min(F.struct("ts", "request_id", "approval_id", "decision", "note")).alias("first")
    )
    same = (
        F.col("approval_id").eqNullSafe(F.col("first.approval_id"))
        & F.col("decision").eqNullSafe(F.col("first.decision"))
        & F.nullif(F.col("note"), F.lit("")).eqNullSafe(F.nullif(F.col("first.note"), F.lit("")))
    )
    return (
        requests.join(firsts, "idempotency_key")
        .where(F.col("request_id") != F.col("first.request_id"))
        .select("request_id", "idempotency_key", F.when(same, "replayed").otherwise("conflict").alias("outcome"))
    )


_ASKED = ["ts", "request_id", "approval_id", "idempotency_key", "decision", "note"]


def checked_requests(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """The requests with ``problem``: why each is unsound on its own, null if it is sound."""
    state = approvals.select("approval_id", "state", "creator", "expires_at")
    joined = requests.join(state, "approval_id", "left")
    expired = (F.col("state") == "EXPIRED") | (
        (F.col("state") == "PENDING") & (F.col("expires_at") <= F.col("ts"))
    )
    problem = (
        F.when(F.col("state").isNull(), "unknown")
        .when(expired, "expired")
        .when(F.col("state") != "PENDING", "wrong_state")
        .when(F.col("reviewer") == F.col("creator"), "self_approval")
        .when((F.col("decision") == "DENY") & (F.trim(F.coalesce("note", F.lit(""))) == ""), "note_required")
        .when(~F.col("decision").isin("APPROVE", "DENY"), "bad_decision")
    )
    return joined.withColumn("problem", problem)


def contested(checked: DataFrame) -> DataFrame:
    """Sound requests on approvals that share an idempotency key with another approval."""
    sound = checked.where(F.col("problem").isNull())
    used = sound.where(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key")
    crossing = used.agg(F.min("approval_id").alias("low"), F.max("approval_id").alias("high")).where("low <> high")
    shared = sound.join(crossing.select("idempotency_key"), "idempotency_key", "left_semi").select("approval_id").distinct()
    return sound.join(shared, "approval_id", "left_semi").select(*_ASKED)


def components(asked: DataFrame) -> DataFrame:
    """``approval_id`` and ``component`` of contested requests: approvals that keys tie together, directly or in a chain.

    Every round an approval takes the smallest label that a key of its has, then that
    label's own label, so a chain of n approvals takes about log2(n) rounds; each is a
    table in the shared folder.
    """
    ties = asked.where(F.col("idempotency_key").isNotNull()).select("approval_id", "idempotency_key").distinct()
    ties = written(ties, "ties")
    labels = written(ties.select("approval_id", F.col("approval_id").alias("component")).distinct(), "components")
    while True:
        by_key = ties.join(labels, "approval_id").groupBy("idempotency_key").agg(F.min("component").alias("near"))
        lower = ties.join(by_key, "idempotency_key").groupBy("approval_id").agg(F.min("near").alias("near"))
        above = labels.select(F.col("approval_id").alias("near"), F.col("component").alias("above"))
        moved = lower.join(above, "near").select("approval_id", F.least("near", "above").alias("component"))
        settled = labels.withColumnRenamed("component", "old").join(written(moved, "components"), "approval_id")
        labels = settled.select("approval_id", "component")
        if settled.where("old <> component").isEmpty():
            return labels


def _one_by_one(asked: Column) -> Column:
    """The requests of a component that are applied, taken in order: the approval still open and the key unused."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    names, keys = F.transform(asked, lambda x: x["approval_id"]), F.transform(asked, lambda x: x["idempotency_key"])
    start = F.struct(F.slice(names, 1, 0).alias("done"), F.slice(keys, 1, 0).alias("used"), none("int").alias("won"))

    def step(acc: Column, x: Column) -> Column:
        key = x["idempotency_key"]
        refused = F.array_contains(acc["done"], x["approval_id"]) | F.coalesce(F.array_contains(acc["used"], key), F.lit(False))
        # Positions, as an applied request is looked up in the ordered array.
        taken = F.struct(
            F.array_append(acc["done"], x["approval_id"]).alias("done"),
            F.when(key.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], key)).alias("used"),
            F.array_append(acc["won"], x["at"]).alias("won"),
        )
        return F.when(refused, acc).otherwise(taken)

    numbered = F.transform(asked, lambda x, i: x.withField("at", i))
    won = F.aggregate(numbered, start, step)["won"]
    return F.transform(won, lambda i: F.get(asked, i))


def decide(requests: DataFrame, approvals: DataFrame, component: DataFrame | None = None) -> DataFrame:
    """Outcome of every decision request, as if they had come one after another.

    ``requests``: request_id, approval_id, decision, reviewer, note,
    idempotency_key, ts. ``approvals``: approval_id, state, creator, expires_at.
    The first sound request on a pending approval is applied, unless its key was
    used by an earlier applied one: then it is a replay or a conflict, and the next
    in line has its turn. Approvals whose keys are theirs alone are settled by one
    aggregation. Those tied by shared keys (``component`` of ``components``) are taken
    one request after another, component by component, as an ordered fold in one row:
    a component is as large as the chain of shared keys, not as a tenant or day.

    Without ``component`` it is found here, which runs jobs; with it nothing runs
    before the result is read.
    """
    checked = checked_requests(requests, approvals)
    disputed = contested(checked)
    if component is None:
        component = components(disputed)
    alone = checked.where(F.col("problem").isNull()).join(component, "approval_id", "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct(*_ASKED)))
    folded = disputed.join(component, "approval_id").groupBy("component").agg(ordered.alias("asked"))
    applied = alone.groupBy("approval_id").agg(F.min(F.struct(*_ASKED)).alias("a")).select("a.*").unionByName(
        folded.select(F.explode(_one_by_one(F.col("asked"))).alias("a")).select("a.*")
    )
    # A key has one applied request at most.
    owners = applied.where(F.col("idempotency_key").isNotNull()).select(
        "idempotency_key", F.struct("ts", "request_id", "approval_id", "decision", "note").alias("owner")
    )
    winner = applied.select(
        "approval_id", F.col("request_id").alias("winner"), F.col("ts").alias("won_at")
    )
    out = checked.join(owners, "idempotency_key", "left").join(winner, "approval_id", "left")
    owned = F.col("owner").isNotNull() & (
        F.struct(F.col("owner.ts"), F.col("owner.request_id")) < F.struct("ts", "request_id")
    )
    same = (
        (F.col("approval_id") == F.col("owner.approval_id"))
        & F.col("decision").eqNullSafe(F.col("owner.decision"))
        & F.nullif(F.col("note"), F.lit("")).eqNullSafe(F.nullif(F.col("owner.note"), F.lit("")))
    )
    too_late = F.struct("won_at", "winner") < F.struct("ts", "request_id")
    return out.select(
        "request_id",
        "approval_id",
        F.when(owned & same, "replayed")
        .when(owned, "conflict")
        .when(F.col("problem").isin("unknown", "expired", "wrong_state"), F.col("problem"))
        .when(F.coalesce(F.col("winner").isNotNull() & too_late, F.lit(False)), "wrong_state")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .otherwise("applied")
        .alias("outcome"),
    )


def self_approvals(decisions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Decisions taken by the identity that created the request."""
    own = approvals.select("approval_id", F.col("creator").alias("reviewer"))
    return decisions.join(own, ["approval_id", "reviewer"])


def readable(transactions: DataFrame, identity: str, reviewer: bool) -> DataFrame:
    """The transactions an identity may read; others look as if they were absent."""
    return transactions if reviewer else transactions.where(F.col("identity") == identity)


def readable_by_services(transactions: DataFrame, services: DataFrame) -> DataFrame:
    """The transactions some service of a list may read: its own ones."""
    return transactions.join(services.select("identity"), "identity", "left_semi")


# --- resuming ------------------------------------------------------------------------


def claim_once(claims: DataFrame, approvals: DataFrame) -> DataFrame:
    """The one claim that wins per approved, unexpired approval.

    ``claims``: claim_id, approval_id, ts.
    """
    open_ = approvals.where(F.col("state") == "APPROVED").select("approval_id", "expires_at")
    return (
        claims.join(open_, "approval_id")
        .where(F.col("ts") < F.col("expires_at"))
        .groupBy("approval_id")
        .agg(F.min_by("claim_id", F.struct("ts", "claim_id")).alias("claim_id"))
    )


def arguments_changed(approvals: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Approvals whose request no longer hashes to what was reviewed."""
    return (
        approvals.join(recomputed.select("transaction_id", F.col("material_hash").alias("now_hash")), "transaction_id")
        .where(F.col("material_hash") != F.col("now_hash"))
        .select("approval_id", "transaction_id", F.lit("DENIED").alias("state"), F.lit("ARGUMENTS_CHANGED").alias("note"))
    )


def resume_outcomes(
    claims: DataFrame, approvals: DataFrame, recomputed: DataFrame, guarded: DataFrame
) -> DataFrame:
    """What each resume attempt came to.

    ``recomputed``: transaction_id, material_hash. ``guarded``: txn_id, verdict of
    the response. Exactly one claim per approval goes on; the others are not
    eligible.
    """
    won = claim_once(claims, approvals).select("claim_id", F.lit(True).alias("won"))
    facts = (
        claims.join(won, "claim_id", "left")
        .join(approvals.select("approval_id", "transaction_id", "material_hash"), "approval_id", "left")
        .join(recomputed.select("transaction_id", F.col("material_hash").alias("now_hash")), "transaction_id", "left")
        .join(
            guarded.select(F.col("txn_id").alias("transaction_id"), F.col("verdict").alias("guard")),
            "transaction_id", "left",
        )
    )
    return facts.select(
        "claim_id",
        "approval_id",
        F.when(F.col("won").isNull(), "not_eligible")
        .when(~F.col("now_hash").eqNullSafe(F.col("material_hash")), "denied_arguments_changed")
        .when(F.col("guard") == "DENY", "denied_output_guard")
        .otherwise("completed")
        .alias("outcome"),
    )


# --- reading the queue --------------------------------------------------------------------


def queue_depth(approvals: DataFrame) -> DataFrame:
    """Approvals per state, with a row for states nobody is in."""
    spark = approvals.sparkSession
    states = spark.createDataFrame([(s,) for s in d.APPROVAL_STATES], "state string")
    counts = approvals.groupBy("state").agg(F.count("*").alias("n"))
    return states.join(counts, "state", "left").select(
        "state", F.coalesce("n", F.lit(0)).alias("n")
    )


def page(
    approvals: DataFrame, states: list[str] | None, limit: int, cursor: str | None = None
) -> DataFrame:
    """One page of the queue, newest first, after the cursor row.

    ``next_cursor`` is set on every row of the page if there are more rows. A
    cursor that is not in the filtered queue starts from the first page.
    """
    limit = max(1, min(limit, d.PAGE_LIMIT_MAX))
    rows = approvals
    if states:
        rows = rows.where(F.col("state").isin(*states))
    if cursor is not None:
        at = rows.where(F.col("approval_id") == cursor).select("created_at").take(1)
        if at:
            rows = rows.where(
                (F.col("created_at") < at[0][0])
                | ((F.col("created_at") == at[0][0]) & (F.col("approval_id") < cursor))
            )
    newest = rows.orderBy(F.desc("created_at"), F.desc("approval_id")).limit(limit + 1)
    # At most limit + 1 rows from here on.
    ranked = newest.withColumn(
        "_rn", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("approval_id")))
    )
    last = F.max(F.when(F.col("_rn") == limit, F.col("approval_id"))).over(Window.partitionBy())
    more = F.max("_rn").over(Window.partitionBy()) > limit
    return (
        ranked.withColumn("next_cursor", F.when(more, last))
        .where(F.col("_rn") <= limit)
        .drop("_rn")
    )


def recent_decisions(decisions: DataFrame, limit: int = 20) -> DataFrame:
    return decisions.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
