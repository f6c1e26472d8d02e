"""Bounded decoding: the texts hidden in base64, hex and percent runs.

Three layers are followed inside each row. A decoded text that was seen before
in the same message is not taken again. Nothing is shuffled: all candidates of
a text live in that text's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions import text as tx
from siftwarden.functions.regex import literal


def with_variants(df: DataFrame, text: str = "norm", depth: int = d.MAX_DECODE_DEPTH, form: str = "detect") -> DataFrame:
    """Add ``variants``: the decoded texts of a normalised text column."""
    return df.withColumn("variants", tx.hidden_texts(F.col(text), depth, form))


def text_variants(df: DataFrame, depth: int = d.MAX_DECODE_DEPTH, form: str = "detect") -> DataFrame:
    """(txn_id, turn, text, decoded_depth, encoding): each text and all it hides.

    Texts have the form that detectors read; ``form="sql"`` gives the one that SQL can
    state, without compatibility forms and with ASCII blanks only (see ``tx.FORMS``).
    """
    fold = tx.normalize if form == "detect" else tx.fold_blanks
    rows = with_variants(df.withColumn("norm", fold(F.col("text"))), "norm", depth, form)
    plain = F.expr("array(named_struct('text', norm, 'depth', 0, 'encoding', 'plain'))")
    return rows.select("txn_id", "turn", F.explode_outer(F.concat(plain, "variants")).alias("v")).select(
        "txn_id",
        "turn",
        F.col("v.text").alias("text"),
        F.col("v.depth").alias("decoded_depth"),
        F.col("v.encoding").alias("encoding"),
    )


def candidate_runs(df: DataFrame) -> DataFrame:
    """Every run that has the shape of an encoding: (txn_id, turn, encoding, run).

    Escapes are not counted here, so there is no gate before the shapes themselves.
    """
    base = df.withColumn("norm", tx.normalize(F.col("text")))
    kinds = ", ".join(
        f"transform(regexp_extract_all(norm, {literal(run)}, 0), "
        f"r -> named_struct('encoding', '{name}', 'run', r))"
        for name, run in tx.RUNS.items()
    )
    return (
        base.select("txn_id", "turn", F.explode_outer(F.expr(f"concat({kinds})")).alias("c"))
        .where(F.col("c").isNotNull())
        .select("txn_id", "turn", "c.encoding", "c.run")
    )
