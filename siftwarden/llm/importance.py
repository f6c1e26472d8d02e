"""A quality classifier by importance resampling.

Two generative models of hashed word n-grams are counted, one over the target texts and
one over all texts. A document's importance is the log-ratio of its likelihoods under
them. Adding Gumbel noise (from a hash of its key and a seed) and keeping the k largest
sums samples k documents without replacement in proportion to importance.

The target is a set of rows marked good; at most ``sample`` of them, in expectation, are
used, chosen by a hash of the key, so that they can be told to all tasks. Everything else
covers all documents. The k-th largest sum is found by counting in ever finer bins.

Cases: a null, empty or blank text has no n-grams and log-ratio 0; without any target row
the two models are the same and all ratios are 0; rows with equal keys and texts get
equal sums, and all rows tied with the k-th are kept; null keys are hashed as null; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm import words
from siftwarden.llm.tables import BATCH_BYTES, bounded_batches, written

BUCKETS = 1 << 16
SAMPLE = 20_000
SEED = 11
BINS = 2048
FEW = 10_000


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and word pairs, and where each text's begin."""
    codes, distinct, offsets = words.split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    h = words.word_hashes(distinct)[codes]
    pair = words.mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    inside = np.ones(max(len(h) - 1, 0), bool)
    ends = offsets[1:-1]
    inside[ends[(ends > 0) & (ends < len(h))] - 1] = False
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    found = np.concatenate([words.mixed(h), pair[inside]]) % np.uint64(BUCKETS)
    rows = np.concatenate([row, row[:-1][inside]])
    return found.astype(np.int64), rows


def _counted(batches):
    total = np.zeros((2, BUCKETS))
    for batch in (part for whole in batches for part in words.slices(whole, "text", BATCH_BYTES)):
        found, rows = buckets(batch.column("text"))
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        total[0] += np.bincount(found, minlength=BUCKETS)
        total[1] += np.bincount(found[good[rows]], minlength=BUCKETS)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_pydict(
        {"bucket": at.astype(np.int32), "raw": total[0, at].astype(np.int64), "target": total[1, at].astype(np.int64)}
    )


def fit(docs: DataFrame, good: DataFrame, n_good: int, sample: int = SAMPLE) -> np.ndarray:
    """Log-ratio per bucket. ``good`` has the keys of target rows, ``n_good`` how many they are."""
    bounded_batches(docs.sparkSession)
    rate = min(1.0, sample / max(n_good, 1))
    chosen = good.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("doc_id").distinct()
    # About ``sample`` keys at most: that is what is broadcast, however long the table.
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("good", F.lit(True))), "doc_id", "left").select(
        "text", F.coalesce("good", F.lit(False)).alias("good")
    )
    counts = marked.mapInArrow(_counted, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    ).toPandas()
    table = np.zeros((2, BUCKETS))
    table[0, counts["bucket"]] = counts["raw"]
    table[1, counts["bucket"]] = counts["target"]
    # The target model leans on the raw one where it has seen little.
    raw = (table[0] + 1) / (table[0].sum() + BUCKETS)
    target = (table[1] + raw * BUCKETS / 4) / (table[1].sum() + BUCKETS / 4)
    return np.log(target / raw)


def log_ratio(docs: DataFrame, ratios: np.ndarray):
    """A column: the log importance of the text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        def of(part: pa.Array) -> pa.Array:
            found, rows = buckets(part)
            return pa.array(np.bincount(rows, shared.value[found], len(part)))

        return words.sliced(texts, BATCH_BYTES, of)

    return score(docs["text"])


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, by counting in bins of a shrinking range."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        width = (high - low) / BINS
        inside = values.where(F.col(column).between(low, high))
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("place")
        counted = inside.groupBy(place).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(counted.collect(), reverse=True):
            if row["n"] >= k:
                low, high, n = row["low"], row["high"], row["n"]
                break
            k -= row["n"]
        else:
            return low
        if n <= FEW:
            rest = values.where(F.col(column).between(low, high)).select(column).collect()
            return sorted((r[0] for r in rest), reverse=True)[k - 1]
    return low


def resample(docs: DataFrame, ratios: np.ndarray, share: float, seed: int = SEED) -> DataFrame:
    """Every document with its log-ratio, its noisy sum and whether it is in the sample."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = docs.select("doc_id", log_ratio(docs, ratios).alias("log_ratio"), (-F.log(-F.log(unit))).alias("noise"))
    noisy = written(noisy.withColumn("sampling_key", F.col("log_ratio") + F.col("noise")).drop("noise"), "importance")
    k = round(share * noisy.count())
    least = kth_largest(noisy, "sampling_key", k) if k else None
    return noisy.withColumn("kept", F.col("sampling_key") >= F.lit(least) if least is not None else F.lit(False))
