"""Findings in SQL: ``SELECT ... FROM documents, LATERAL findings(text, 'context')``.

The function is a temporary SQL table function, made from the detectors' own expressions
over one text. Its body has no table of its own, so Spark unfolds it into the row of the
query it stands in: a projection and one generator, with no join, no shuffle and no Python
but for the texts that need a Unicode form or hold encoded runs, which go in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

from siftwarden.functions import text as tx
from siftwarden.operators.detect import FINDING_TYPE, NO_FINDINGS, DetectorSpec, failure_sql, quote

# What a detector may read, each once a literal is out of the way.
_INPUTS = re.compile(r"'(?:[^'\\]|\\.)*'|\b(plane|norm|folded|variants)\b(?!\s*\()")
COLUMNS = FINDING_TYPE.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ").replace("start ", "`start` ").replace("end ", "`end` ")


def _of_row(sql: str) -> str:
    """The expression with its inputs taken from the lambda variable ``text_row``."""
    return _INPUTS.sub(lambda m: f"text_row.{m[1]}" if m[1] else m[0], sql)


def findings_sql(detectors: Iterable[DetectorSpec], salt: str, text: str, plane: str) -> str:
    """SQL: the findings of all detectors on one text, an array."""
    detectors = list(detectors)
    if unknown := {s.id for s in detectors if "internal_urls" in s.findings(salt)}:
        raise ValueError(f"not for single texts: {', '.join(sorted(unknown))}")
    arrays = [
        f"CASE WHEN plane IN ({', '.join(map(quote, sorted(s.planes)))}) AND norm IS NOT NULL "
        f"THEN coalesce({s.findings(salt)}, array({failure_sql(s.id)})) ELSE {NO_FINDINGS} END"
        for s in detectors
    ]
    body = _of_row(f"concat({', '.join(arrays)})")
    norm = tx.normalize_sql(text)
    row = {"plane": plane, "norm": norm}
    if "text_row.folded" in body:
        row["folded"] = tx.fold_diacritics_sql(norm)
    if "text_row.variants" in body:
        row["variants"] = tx.hidden_texts_sql(norm)
    fields = ", ".join(f"'{k}', {v}" for k, v in row.items())
    # The row is a lambda variable: each derived text is worked out once for all detectors.
    return f"flatten(transform(array(named_struct({fields})), text_row -> {body}))"


def register_findings(spark: SparkSession, detectors: Iterable[DetectorSpec], salt: str, name: str = "findings") -> None:
    """Make ``name(text, plane)`` a table function of this session."""
    tx.register_forms(spark)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(given_text STRING, given_plane STRING)
        RETURNS TABLE ({COLUMNS})
        RETURN SELECT f.* FROM (SELECT explode({findings_sql(detectors, salt, 'given_text', 'given_plane')}) AS f)"""
    )
