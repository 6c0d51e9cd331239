"""Registered queries over the given tables, each with the SQL that checks it."""

from gaugeworks.plans import (  # noqa: F401
    aggregates, filters, joins, projections, scalars, scans, sequences, sinks, stored, streams,
)
from gaugeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
