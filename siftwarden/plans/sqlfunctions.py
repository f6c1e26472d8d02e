"""Queries written in SQL with the table function over findings."""

from __future__ import annotations

from siftwarden.operators import detect, table_function
from siftwarden.plans import detection, inputs as src
from siftwarden.plans.registry import query
from siftwarden.sources.readers import table


@query("sql_findings", f"WITH {detection.value_sql(detect.PII_KINDS)} {detection._FOUND_VALUES}")
def sql_findings(spark, sf):
    """Personal data in documents, asked for in SQL: the rows of ``scan_pii``."""
    table_function.register_findings(spark, [detect.pii()], src.SALT, "pii_findings")
    return spark.sql(
        """SELECT doc_id AS txn_id, f.pii_type AS kind, CAST(f.start AS BIGINT) AS start_pos, CAST(f.end AS BIGINT) AS end_pos, f.excerpt_hash
           FROM {documents}, LATERAL pii_findings(text, 'context') AS f""",
        documents=table(spark, sf, "documents"),
    )


@query(
    "sql_findings_by_plane",
    f"""WITH {detection.PROBES_SQL}, {detection.text_findings_sql(detection._PROBED)}
    SELECT plane, detector_id, category, pattern_id, count(*) AS n, count(DISTINCT txn_id) AS n_requests FROM found_in GROUP BY ALL""",
)
def sql_findings_by_plane(spark, sf):
    """What each detector finds in messages with a phrase in front, by plane, asked for in SQL."""
    detectors = [s for s in detect.text_detectors(src.POLICY) if s.id != "urls"]
    table_function.register_findings(spark, detectors, src.SALT, "text_findings")
    return spark.sql(
        """SELECT plane, f.detector_id, f.category, f.pattern_id, count(*) AS n, count(DISTINCT txn_id) AS n_requests
           FROM {messages}, LATERAL text_findings(text, plane) AS f GROUP BY ALL""",
        messages=detection.probes(spark, sf),
    )
