"""All registered queries."""

from paytrail.plans import aggregates, encodings, files, joins, models, rows, windows  # noqa: F401
from paytrail.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
