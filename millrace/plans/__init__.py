"""Importing this package registers every query."""

from millrace.plans import (  # noqa: F401
    anomalies, columns, compares, files, gaps, ml, profiles, scaling, series, steps, values,
)
from millrace.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
