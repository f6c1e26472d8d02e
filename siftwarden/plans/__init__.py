"""The registered queries: each operator run over whole tables, with its oracle."""

from siftwarden.plans import (  # noqa: F401
    aggregates, approvals, detection, flagship, history, joins, redaction, scalars, sources, sqlfunctions, streams,
)
from siftwarden.plans.registry import ORACLES, QUERIES  # noqa: F401
