"""Exact duplicates by combining, safe under hot texts.

Equal texts are combined within each task first, then in groups of a digest and a
salt, then across salts. The grouping key always holds the whole normalised text
beside its digest, so two texts count as equal only if every character is. A hot
text sends at most one row per task to a salted group and one per salt to the last.

Membership follows from the digest alone where a digest stands for one content, which
is checked on the combined table; rows of a digest with several contents, if there
ever are any, are joined on content too.

Cases: a null text counts as empty; the smallest key stays, null keys come last;
rows repeated with the key that stays are all shown as that key's (``duplicates``),
while ``distinct_rows`` returns one of them; an empty table gives no rows; further
columns are kept by ``distinct_rows`` and left out of ``duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.llm.tables import written

SALTS = 16
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of blanks and control white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _salt() -> Column:
    # By task, so that copies combined within a task stay one row.
    return F.pmod(F.spark_partition_id(), F.lit(SALTS))


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Key, ``keep_id``, ``group_size``, ``kept`` and the digest of every row."""
    rows = df.select(F.col(key).alias("key"), normalised(F.col(text)).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    salted = rows.groupBy("digest", _salt().alias("salt"), "content").agg(F.min("key").alias("keep"), F.count("*").alias("n"))
    combined = salted.groupBy("digest", "content").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    # One row per content; the contents themselves are needed again only if a digest has several.
    groups = written(combined.select("digest", "keep", "n"), "exact-groups")
    several = written(groups.groupBy("digest").count().where("count > 1").select("digest"), "exact-collisions")
    if several.isEmpty():
        found = rows.select("key", "digest").join(groups, "digest")
    else:
        found = rows.select("key", "digest").join(groups.join(several, "digest", "left_anti"), "digest")
        both = rows.join(several, "digest", "left_semi")
        exact = both.groupBy("digest", "content").agg(F.min("key").alias("keep"), F.count("*").alias("n"))
        found = found.unionByName(both.join(exact, ["digest", "content"]).drop("content"))
    return found.select(
        F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.coalesce(F.col("key") == F.col("keep"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row per text, that with the smallest key, by the same combining.

    The text travels once, as the grouping key; the row itself only carries it
    again where normalising changed it.
    """
    names = df.columns
    content = normalised(F.col(text))
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text]
    own = F.when(F.col(text).isNull(), F.lit(None)).when(F.col(text) != content, F.col(text))
    rows = df.select(
        sha256(content).alias("digest"), content.alias("content"),
        F.struct(F.col(key).isNull(), F.col(key)).alias("rank"),
        F.struct(F.col(text).isNull().alias("void"), own.alias("own"), *rest).alias("row"),
    )
    first = [F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank")]
    salted = rows.groupBy("digest", _salt().alias("salt"), "content").agg(*first)
    kept = salted.groupBy("digest", "content").agg(*first)
    back = F.when(~F.col("row.void"), F.coalesce("row.own", "content"))
    return kept.select(*[(back if c == text else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)])
