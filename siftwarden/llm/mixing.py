"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table tells how likely each domain is for a document
(hashed words and signs, multinomial logistic regression). Every document gets a nonnegative rate,
how often it is to be used, such that the expected tokens of each domain (rate times
tokens times posterior, added up) come as close to the targets as least squares allows:

    minimise |A w - T|^2 in the metric of (A diag(1/tokens) A')^-1,  w >= 0

by projected gradient from w = 1, the metric taken over the documents whose rate is above
zero. In that metric a full step meets the targets at once unless more rates hit zero; a
step that does not come closer is halved. A document's rate follows from its posteriors
and the few steps so far, so a round is one pass over tokens and posteriors that returns a
few numbers per domain.

At most ``SAMPLE`` labelled rows, in expectation, are fitted on, chosen by a hash of the
key. Any number d of domains will do: a round returns d + d * d numbers of each task.

Cases: a null or blank text has no tokens, so its rate matters to no total; without
labelled rows, or with one domain, all documents belong to it; domains no document
belongs to are left short of their target; repeated rows get a rate each; null keys do
not train; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.llm.tables import written

FEATURES = 1 << 15
SAMPLE = 16_000
PENALTY = 1e-3
FIT_PARTS = 4
ROUNDS = 40
CLOSE = 1e-4
SEED = 23


def tokens_of(text: Column) -> Column:
    """How many words between blanks there are."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def terms_of(text: Column) -> Column:
    """What the classifier sees: runs of letters in lower case, and runs of signs."""
    text = F.coalesce(text, F.lit(""))
    letters, signs = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.regexp_replace(text, r"[\p{L}\s]+", " ")
    return F.concat(F.split(letters, " "), F.split(signs, " "))


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], n_labelled: int, sample: int = SAMPLE) -> DataFrame:
    """``row`` (all columns), ``tokens`` and ``p``, the posterior of each domain, for every document.

    ``labelled`` has ``doc_id`` and ``domain``, and ``n_labelled`` rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), terms_of(F.col("text")).alias("words"), tokens_of(F.col("text")).alias("tokens"))
    seen = HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES, binary=True)
    rate = min(1.0, sample / max(n_labelled, 1))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    chosen = chosen.groupBy(F.col("doc_id").alias("key")).agg(F.min("domain").alias("domain"))
    index = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(float(i)))])
    # About ``sample`` keys at most, however long the labelled table.
    known = rows.join(F.broadcast(chosen), "key").select("words", index[F.col("domain")].alias("label"))
    known = written(seen.transform(known).select("features", "label"), "labelled")
    present = [int(r["label"]) for r in known.select("label").distinct().collect()]
    if len(present) < 2:
        only = present[0] if present else 0
        return rows.select("row", "tokens", F.array(*[F.lit(float(i == only)) for i in range(len(domains))]).alias("p"))
    learner = LogisticRegression(family="multinomial", maxIter=40, regParam=PENALTY, standardization=False)
    # The sample is bounded, and each of its parts returns a gradient as wide as the model.
    model = learner.fit(known.repartition(FIT_PARTS))
    told = model.transform(seen.transform(rows))
    p = vector_to_array("probability")
    missing = len(domains) - model.numClasses
    p = F.concat(p, F.array_repeat(F.lit(0.0), missing)) if missing else p
    return told.select("row", "tokens", p.alias("p"))


def _moved(p: np.ndarray, steps: list) -> np.ndarray:
    w = np.ones(len(p))
    for step in steps:
        w = np.maximum(0.0, w - p @ step)
    return w


def _arrays(batch: pa.RecordBatch, domains: int) -> tuple[np.ndarray, np.ndarray]:
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)
    return p, batch.column("tokens").to_numpy().astype(float)


def fit_rates(table: DataFrame, targets: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The steps that lead from rate 1 to the fitted rates; ``table`` has ``tokens`` and ``p``."""
    d = len(targets)
    narrow = table.select("tokens", "p")

    def measured(steps: list) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain at the rates so far, and their metric."""

        def run(batches):
            total = np.zeros(d + d * d)
            for batch in batches:
                p, t = _arrays(batch, d)
                w = _moved(p, steps)
                total[:d] += (t * w) @ p
                free = w > 0
                total[d:] += ((p[free] * t[free, None]).T @ p[free]).ravel()
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "x": total})

        out = np.zeros(d + d * d)
        for r in narrow.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        gram = out[d:].reshape(d, d)
        return out[:d], np.linalg.pinv(gram + 1e-6 * np.trace(gram) / d * np.eye(d), hermitian=True)

    steps: list[np.ndarray] = []
    reached, metric = measured(steps)
    scale, share = max(np.abs(targets).sum(), 1.0), 1.0
    for _ in range(rounds):
        off = reached - targets
        if np.abs(off).max() <= CLOSE * scale or share < 1e-3:
            break
        step = share * (metric @ off)
        then, after = measured([*steps, step])
        if np.abs(then - targets).max() < np.abs(off).max():
            steps, reached, metric, share = [*steps, step], then, after, 1.0
        else:
            share /= 2
    return steps


def with_rates(table: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    """The table with ``rate``, from the same steps that the totals were measured with."""
    kept = [s.tolist() for s in steps]

    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        values = p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
        return pa.array(_moved(values, [np.array(s) for s in kept]))

    return table.withColumn("rate", rate(table["p"]))


def domain_table(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: good or poor, clean or toxic."""
    quality = F.when(F.col("quality") == 1, "good").otherwise("poor")
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select(
        "doc_id", F.concat(quality, F.when(F.col("toxic") == 1, "-toxic").otherwise("-clean")).alias("domain")
    )


def targets_of(natural: np.ndarray, domains: list[str], weights: dict[str, float], anchor: str) -> np.ndarray:
    """Target tokens in proportion to the weights, such that the anchor keeps its own total."""
    total = natural[domains.index(anchor)] / weights[anchor]
    return np.array([weights.get(d, 0.0) * total for d in domains])


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str) -> DataFrame:
    """``row``, ``tokens``, ``p`` and ``rate`` of every document, for target weights by domain."""
    domains = sorted(weights)
    labelled = labelled.where(F.col("domain").isin(domains))
    told = posteriors(docs, labelled, domains, labelled.count())
    told = written(told, "posteriors")
    sums = told.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[i]), F.lit(0.0)) for i in range(len(domains))]).first()
    targets = targets_of(np.array(sums, float), domains, weights, anchor)
    return with_rates(told, fit_rates(told, targets))


def realised(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows, each as often as its rate says: its whole part, and once more with the chance of the rest."""
    chance = F.pmod(F.xxhash64(F.lit(seed), "row.doc_id", "row.text"), F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor("rate")
    copies = (whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")


# Most of the mix is good clean text, used about once in full; the rest is let in sparingly.
WEIGHTS = {"good-clean": 0.96, "good-toxic": 0.01, "poor-clean": 0.025, "poor-toxic": 0.005}
ANCHOR = "good-clean"


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, domain_table(labels), WEIGHTS, ANCHOR)
