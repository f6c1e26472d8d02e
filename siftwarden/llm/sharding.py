"""A two-pass external shuffle into shards.

Pass one scatters the rows into memory-sized buckets by a seeded hash of key and text.
Pass two brings every bucket into a canonical order, Fisher-Yates shuffles it with a
generator seeded by the bucket, and writes it. The buckets one after the other are the
shuffled table; its shards are equal ranges of that order, so that their row counts are
at most one apart.

The order depends on the seed and the rows alone, not on how the input was split. Only
keys that fill a good part of a bucket by themselves (rows repeated by the thousand) are
also told apart by their position in the input, which must then be a table, not a query
whose row order may change when a lost task is run again.

Cases: a null text counts no bytes and is hashed as null; null keys and repeated rows are
rows like any other; empty tables give empty shards; all columns of the input, whatever
their names, are in the struct ``row``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftwarden.llm.tables import bounded_batches, scratch, written

BUCKET_BYTES = 32 << 20
SLICE_BYTES = 4 << 20
RANGE = 4096  # buckets whose rows are added up together
FEW_BUCKETS = 1 << 20  # up to here their starts, 16 bytes each, are sent to every task; beyond, they are joined


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _shuffled(seed: int):
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        bucket = whole["bucket"][0].as_py()
        canonical = np.lexsort((whole["tie"].to_numpy(), whole["hash"].to_numpy()))
        order = canonical[np.random.default_rng([seed, bucket]).permutation(len(canonical))]
        rows, step = whole["row"].chunk(0), max(1, len(order) * SLICE_BYTES // max(1, whole.nbytes))
        for at in range(0, len(order), step):
            some = order[at : at + step]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.take(pa.array(some)), pa.array(np.full(len(some), bucket, np.int32)),
                    pa.array(np.arange(at, at + len(some), dtype=np.int64)),
                ],
                ["row", "bucket", "place"],
            )

    return run


def bucket_starts(kept: DataFrame) -> DataFrame:
    """Rows before each bucket: counted within ranges of buckets, and over the ranges."""
    sizes = kept.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("bucket") / RANGE))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.sum("n").over(earlier(Window.partitionBy("range").orderBy("bucket")))
    # One row per range of buckets, hence for some gigabytes of rows.
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("all"))
    ranges = ranges.select("range", F.sum("all").over(earlier(Window.orderBy("range"))).alias("before"))
    both = sizes.withColumn("inside", inside).join(ranges, "range")
    return written(both.select("bucket", (F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("start")), "starts")


def external_shuffle(
    df: DataFrame, shards: int, seed: int, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Every row as ``row`` with its ``shard`` and its gapless ``slot`` there, as a written table."""
    spark = df.sparkSession
    bounded_batches(spark)
    keyed = F.xxhash64(F.lit(seed), F.col(key))
    total = df.agg(F.sum(text_bytes(F.col(text))).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(math.ceil((total["bytes"] or 0) / bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A key that fills half a bucket or more: its rows are dealt out one by one.
    most = max(1000, total["n"] // (2 * buckets))
    hot = written(df.groupBy(keyed.alias("hash")).count().where(F.col("count") > most).select("hash", F.lit(True).alias("hot")), "hot")
    own = F.monotonically_increasing_id().alias("own")
    rows = df.select(F.struct("*").alias("row"), keyed.alias("hash"), F.xxhash64(F.col(text)).alias("tie"), own)
    # As large as Spark's own size check allows, the hot keys are sent to the rows and not the rows to them.
    rows = rows.join(hot, "hash", "left").withColumn("apart", F.when(F.col("hot"), F.col("own")).otherwise(0))
    bucket = F.pmod(F.xxhash64("hash", "tie", "apart"), F.lit(buckets)).cast("int")
    rows = rows.select("row", "hash", "tie", bucket.alias("bucket"))
    schema = T.StructType([rows.schema["row"], T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType())])
    kept = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(_shuffled(seed), schema)
    kept = written(kept, "shuffled")
    starts = bucket_starts(kept)
    placed = kept.join(F.broadcast(starts) if buckets <= FEW_BUCKETS else starts, "bucket").withColumn("at", F.col("start") + F.col("place"))
    n = max(1, total["n"])
    placed = placed.withColumn("shard", F.expr(f"cast((at * {shards}L) div {n}L as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.select("row", "shard", (F.col("at") - first).alias("slot"))


def write_shards(shuffled: DataFrame, path: str | None = None) -> str:
    """One folder per shard, the files of each in slot order."""
    path = path or scratch(shuffled.sparkSession, "shards")
    rows = shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
    return path
