"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept, as a table, and returns the
columns of documents; the last returns where every piece of every document is packed.

Language ID drops texts without a language (null or without letters) and texts of which
no language holds half of the letters. Exact and near copies leave the document with the
smallest doc_id. Mixing drops or repeats documents by their rates. The tables of a run are
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.llm import exact, langid, mixing, near, packing
from siftwarden.llm.tables import written

LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that holds at least half of their letters."""
    found = langid.identify(docs, langid.fit_documents(docs))
    judged = docs.select(F.struct("*").alias("row"), found.alias("found"))
    kept = judged.where((F.col("found.lang_pred") != langid.UNDETERMINED) & (F.col("found.score") >= LEAST_SHARE))
    return kept.select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text."""
    return exact.distinct_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per class of texts that share eight tenths of their five-word runs, directly or in a chain."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domains ask for."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.realised(mixing.mix_documents(docs, labels))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# No SQL: language models, MinHash joins and local search are not expressible. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
