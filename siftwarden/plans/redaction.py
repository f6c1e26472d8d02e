"""Redaction and transformation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.operators import detect, redact
from siftwarden.plans import inputs as src
from siftwarden.plans.detection import value_sql
from siftwarden.plans.registry import query
from siftwarden.sources.readers import table

_KINDS = [k.name for k in detect.REDACTED_KINDS]
_LABELS = {k.name: k.label for k in detect.REDACTED_KINDS}
_ORDER = {k: str(i) for i, k in enumerate(_KINDS)}

# Spans on the original text, merged by gaps and islands.
MERGED_SQL = f"""{value_sql(_KINDS, folded='folded_raw', text='text')},
raw AS (SELECT txn_id, start_pos, end_pos, {src.case_sql('kind', _LABELS)} AS label,
  {src.case_sql('kind', _ORDER)}::INT AS pos FROM found),
ranked AS (SELECT *, {' '.join(['CASE label'] + [f"WHEN '{k}' THEN {v}" for k, v in d.LABEL_RANK.items()] + ['END'])} AS lr,
  CASE WHEN start_pos < max(end_pos) OVER (PARTITION BY txn_id ORDER BY start_pos, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS opens FROM raw),
isles AS (SELECT *, sum(opens) OVER (PARTITION BY txn_id ORDER BY start_pos, pos) AS isle FROM ranked),
merged AS (SELECT txn_id, min(start_pos)::BIGINT AS start_pos, max(end_pos)::BIGINT AS end_pos,
  arg_max(label, struct_pack(a := lr, b := -start_pos, c := -pos)) AS label FROM isles GROUP BY txn_id, isle)"""


@query("redact_spans", f"WITH {MERGED_SQL} SELECT txn_id, start_pos, end_pos, label FROM merged")
def redact_spans(spark, sf):
    docs = src.documents(spark, sf)
    rows = docs.select("txn_id", F.explode_outer(redact.redaction_spans("text")).alias("s")).where("s IS NOT NULL")
    return rows.select(
        "txn_id", F.col("s.start").cast("bigint").alias("start_pos"), F.col("s.end").cast("bigint").alias("end_pos"), "s.label"
    )


REBUILT_SQL = f"""{MERGED_SQL},
pieces AS (SELECT m.txn_id, m.start_pos, coalesce(lag(m.end_pos) OVER w, 0) AS prev_end, m.end_pos, m.label,
  row_number() OVER (PARTITION BY m.txn_id ORDER BY m.start_pos DESC) = 1 AS last FROM merged m WINDOW w AS (PARTITION BY m.txn_id ORDER BY m.start_pos)),
rebuilt AS (SELECT p.txn_id, string_agg(substring(text, prev_end + 1, start_pos - prev_end) || '[REDACTED:' || label || ']', '' ORDER BY start_pos)
  || max(CASE WHEN last THEN substring(text, end_pos + 1) END) AS redacted, count(*) AS span_count,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM pieces p JOIN docs USING (txn_id) GROUP BY p.txn_id)"""


@query(
    "redact_text",
    f"""WITH {REBUILT_SQL} SELECT doc_id AS txn_id, coalesce(redacted, text) AS redacted FROM documents LEFT JOIN rebuilt ON doc_id = txn_id""",
)
def redact_text(spark, sf):
    return redact.redact(src.documents(spark, sf)).select("txn_id", "redacted")


@query(
    "redact_record",
    f"""WITH {REBUILT_SQL}, s AS (SELECT txn_id, string_agg(start_pos || '+' || (end_pos - start_pos), ';' ORDER BY start_pos) AS spans FROM merged GROUP BY 1)
    SELECT txn_id, span_count, labels, spans FROM rebuilt JOIN s USING (txn_id)""",
)
def redact_record(spark, sf):
    out = redact.redact(src.documents(spark, sf)).where(F.col("record.span_count") > 0)
    spans = F.transform(
        "record.spans", lambda s: F.concat(s["offset"].cast("string"), F.lit("+"), s["length"].cast("string"))
    )
    return out.select(
        "txn_id", F.col("record.span_count").cast("bigint").alias("span_count"),
        F.array_join("record.labels", ",").alias("labels"), F.array_join(spans, ";").alias("spans"),
    )


@query(
    "redact_conversation",
    f"""WITH {REBUILT_SQL}, {src.DECISIONS_SQL}
    SELECT doc_id AS txn_id, CASE WHEN transformation = 'REDACT' THEN coalesce(r.redacted, text) ELSE text END AS text
    FROM documents LEFT JOIN decisions d ON d.txn_id = doc_id LEFT JOIN rebuilt r ON r.txn_id = doc_id""",
)
def redact_conversation(spark, sf):
    docs = src.documents(spark, sf).withColumn("role", F.lit("tool"))
    return redact.redact_requests(docs, src.decisions(spark, sf)).select("txn_id", "text")


@query(
    "mask_text",
    f"""WITH {value_sql(['email'])} SELECT txn_id, start_pos, left(hit, 4) ||
      CASE WHEN length(hit) > 8 THEN regexp_replace(substring(hit, 5, length(hit) - 8), '[\\p{{L}}\\p{{N}}]', '*', 'g') || right(hit, 4) END AS masked FROM found""",
)
def mask_text(spark, sf):
    found = src.documents(spark, sf).withColumn("norm", detect.tx.normalize(F.col("text")))
    rows = found.select("txn_id", F.explode_outer(detect.EMAIL.spans("norm")).alias("s")).where("s IS NOT NULL")
    return rows.select(
        "txn_id", F.col("s.start").cast("bigint").alias("start_pos"), redact.mask_value(F.col("s.text")).alias("masked")
    )


@query(
    "truncate_text",
    """SELECT doc_id AS txn_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '[TRUNCATED]' ELSE text END AS text FROM documents""",
)
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("txn_id"), redact.truncate(F.col("text"), 500).alias("text")
    )


@query(
    "sanitize_text",
    r"""SELECT conv_id AS txn_id, turn, regexp_replace(regexp_replace('### system ### ' || text, '(?i)###\s*system\s*###|</?\s*(?:system|user|assistant)\s*>', '', 'g'),
      '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS text FROM conversations""",
)
def sanitize_text(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("txn_id"), "turn",
        redact.sanitize(F.concat(F.lit("### system ### "), "text")).alias("text"),
    )


@query(
    "rewrite_text",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN '[REMOVED BY POLICY]' ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id)""",
)
def rewrite_text(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    flagged = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return rows.select("doc_id", redact.rewrite(F.col("text"), flagged, "[REMOVED BY POLICY]").alias("text"))


# Cut, cleaned, then redacted; what is redacted leaves nothing to mask.
_CLEANED = r"""(SELECT doc_id, source, regexp_replace(regexp_replace(CASE WHEN length(text) > 5000 THEN left(text, 5000) || '[TRUNCATED]' ELSE text END,
  '(?i)###\s*system\s*###|</?\s*(?:system|user|assistant)\s*>', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS text FROM documents)"""


@query(
    "transform_order",
    f"""WITH {REBUILT_SQL.replace('FROM documents', f'FROM {_CLEANED}')}
    SELECT doc_id AS txn_id, coalesce(redacted, text) AS text FROM {_CLEANED} LEFT JOIN rebuilt ON doc_id = txn_id""",
)
def transform_order(spark, sf):
    docs = src.documents(spark, sf).select("txn_id", "text")
    return redact.transform_all(docs, {"MASK", "REDACT", "SANITIZE", "TRUNCATE"}, limit=5000)
