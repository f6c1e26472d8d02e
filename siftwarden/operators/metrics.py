"""Counters, histograms, percentiles and the figures derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions.ordered import hour_slice, with_previous


def status_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def bounded(value: Column, known: Sequence[str], other: str) -> Column:
    """A label kept to a closed set."""
    return F.when(value.isin(*known), value).otherwise(F.lit(other))


def token_estimate(text: Column) -> Column:
    """About four characters to a token, at least one token."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def counters(families: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Metric families as rows (name, labels, value).

    ``families`` maps a metric name to a table and its label columns. Labels are
    rendered as ``k=v`` pairs in the order given.
    """
    parts = []
    for name, (df, labels) in families.items():
        rendered = F.concat_ws(
            ",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in labels]
        )
        parts.append(
            df.groupBy(*labels)
            .agg(F.count("*").cast("double").alias("value"))
            .select(F.lit(name).alias("name"), rendered.alias("labels"), "value")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decision_counters(decisions: DataFrame) -> DataFrame:
    """All counters of a decisions table in one pass over it.

    Each decision contributes one (metric, label) pair per thing counted; the
    pairs are counted together, with partial counts before the shuffle. Label
    sets are closed, so the result is small.
    """

    def pair(metric: str, label: Column) -> Column:
        return F.struct(F.lit(metric).alias("name"), label.cast("string").alias("label"))

    def pairs(metric: str, labels: Column) -> Column:
        return F.transform(labels, lambda x: pair(metric, x))

    singles = F.array(
        pair("decisions_total", F.col("verdict")),
        pair("risk_level_total", F.col("risk_level")),
        pair("transformations_total", F.nullif(F.col("transformation"), F.lit("NONE"))),
        pair("upstream_calls_avoided_total", F.when(F.col("verdict") == "DENY", F.col("verdict"))),
    )
    every = F.concat(
        singles,
        pairs("policy_hits_total", F.transform("policy_hits", lambda h: h["rule_id"])),
        pairs("reason_codes_total", F.col("reason_codes")),
    )
    return (
        decisions.select(F.explode(every).alias("p"))
        .where(F.col("p.label").isNotNull())
        .groupBy("p.name", "p.label")
        .agg(F.count("*").alias("value"))
    )


def histogram(
    samples: DataFrame, label: str, value: str, bounds: Sequence[float] = d.HISTOGRAM_BOUNDS
) -> DataFrame:
    """Cumulative buckets per label: (label, le, n), ``+Inf`` last."""
    spots = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = samples.groupBy(label).agg(*spots, F.count(value).alias("total"))
    rows = F.array(
        *[
            F.struct(F.lit(repr(float(b))).alias("le"), F.col(f"b{i}").alias("n"))
            for i, b in enumerate(bounds)
        ],
        F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")),
    )
    return wide.select(label, F.explode(rows).alias("r")).select(label, "r.le", "r.n")


def _bucket(value: Column) -> Column:
    """A coarse key that never decreases as the value grows."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * 256)).cast("bigint")


def nearest_rank(
    samples: DataFrame, label: str, value: str, percents: Sequence[int] = (50, 95, 99)
) -> DataFrame:
    """Exact nearest-rank percentiles per label: (label, percent, value).

    The rank is ``round_half_even(p/100 * (n-1))``. Labels are few and groups
    huge, so no group is ever sorted: values are counted per coarse bucket, the
    bucket holding each rank is found from the running counts, and only those
    buckets' distinct values are ranked.
    """
    rows = samples.where(F.col(value).isNotNull()).select(
        label, F.col(value).alias("_x"), _bucket(F.col(value)).alias("_b")
    )
    per_value = rows.groupBy(label, "_b", "_x").agg(F.count("*").alias("_n"))
    per_bucket = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(label).orderBy("_b")
    buckets = per_bucket.withColumn("_upto", F.sum("_n").over(running)).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(label))
    )
    ranks = F.array(
        *[
            F.struct(
                F.lit(p).alias("percent"),
                F.bround(F.lit(p / 100) * (F.col("_total") - 1), 0).cast("bigint").alias("rank"),
            )
            for p in percents
        ]
    )
    wanted = (
        buckets.select(
            label, "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto",
            F.explode(ranks).alias("r"),
        )
        .where((F.col("r.rank") >= F.col("_before")) & (F.col("r.rank") < F.col("_upto")))
        .select(label, "_b", "_before", F.col("r.percent").alias("percent"), F.col("r.rank").alias("rank"))
    )
    inside = Window.partitionBy(label, "percent").orderBy("_x")
    return (
        per_value.join(wanted, [label, "_b"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .where((F.col("rank") < F.col("_end")) & (F.col("rank") >= F.col("_end") - F.col("_n")))
        .select(label, "percent", F.col("_x").alias("value"))
    )


def latency_summary(samples: DataFrame, label: str, value: str) -> DataFrame:
    """n, mean, min, max and nearest-rank p50, p95, p99 per label.

    Sums run over decimals, so the mean does not depend on the order of rows.
    """
    basics = samples.groupBy(label).agg(
        F.count(value).alias("n"),
        (F.sum(F.col(value).cast("decimal(28,6)")).cast("double") / F.count(value)).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    tops = (
        nearest_rank(samples, label, value)
        .groupBy(label)
        .agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"p{p}") for p in (50, 95, 99)])
    )
    return basics.join(tops, label)


def approx_summary(samples: DataFrame, label: str, value: str, accuracy: int = 10000) -> DataFrame:
    """The one-pass variant with approximate percentiles."""
    quantiles = F.percentile_approx(value, [0.5, 0.95, 0.99], accuracy)
    return samples.groupBy(label).agg(F.count(value).alias("n"), quantiles.alias("q")).select(
        label, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))]
    )


def throughput(samples: DataFrame, label: str, ts: str) -> DataFrame:
    """Requests per second of wall time per label."""
    wall = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1_000_000)
    return samples.groupBy(label).agg(F.count("*").alias("n"), wall.alias("wall_seconds")).withColumn(
        "per_second", F.when(F.col("wall_seconds") > 0, F.col("n") / F.col("wall_seconds"))
    )


def counter_increase(scrapes: DataFrame) -> DataFrame:
    """Increase between scrapes (series, ts, seq, value); a drop is a counter reset.

    ``seq`` orders scrapes of the same time.
    """
    before = with_previous(scrapes, ["series"], ["ts", "seq"], "value", hour_slice(F.col("ts")), "before")
    grown = F.col("value") - F.col("before")
    return before.select(
        "series", "ts", "seq", "value",
        F.when(F.col("before").isNull(), F.lit(0)).when(grown < 0, F.col("value")).otherwise(grown).alias("increase"),
    )


def series(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """A chart series (name, value): positive values, largest first, then by name."""
    out = counts.where(F.col("value") > 0).orderBy(F.desc("value"), F.asc("name"))
    return out if limit is None else out.limit(limit)


def avoided_cost(calls: DataFrame, price: float = d.INPUT_PRICE_PER_MILLION) -> DataFrame:
    """Calls avoided, their prompt tokens and what those would have cost."""
    total = calls.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    cost = F.col("tokens") / F.lit(1_000_000) * F.lit(price)
    return total.select(
        "calls", "tokens", cost.alias("cost"),
        F.when(F.col("calls") > 0, cost / F.col("calls") * 1000).alias("cost_per_1000"),
    )
