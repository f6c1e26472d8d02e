"""The flagship: documents with sensitive data, their decision and redacted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators import decide, detect, redact
from siftwarden.plans import inputs as src
from siftwarden.plans.detection import AS_CONTEXT, decided_sql
from siftwarden.plans.redaction import REBUILT_SQL
from siftwarden.plans.registry import query


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    findings = detect.scan(docs, [detect.pii(), detect.secrets()], src.SALT)
    decided = decide.decide(decide.score_board(findings, src.POLICY), src.POLICY)
    redacted = redact.redact(docs.join(decided, "txn_id"))
    return redacted.select(
        F.col("txn_id").alias("doc_id"), "source", "verdict", "transformation",
        F.array_join("reason_codes", ",").alias("reason_codes"), "risk_level",
        F.col("record.span_count").cast("bigint").alias("span_count"), "redacted",
    )


@query(
    "flagship",
    f"""SELECT d.txn_id AS doc_id, source, verdict, transformation, reasons AS reason_codes, risk_level,
      coalesce(span_count, 0) AS span_count, coalesce(redacted, text) AS redacted
    FROM (WITH {decided_sql(AS_CONTEXT, "detector_id IN ('pii', 'secrets')")} SELECT * FROM decisions) d
    JOIN documents ON doc_id = d.txn_id
    LEFT JOIN (WITH {REBUILT_SQL} SELECT * FROM rebuilt) r ON r.txn_id = d.txn_id""",
)
def flagship_query(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)
