"""Queries over the driver's tables, one for each operator, and the SQL each is checked against."""

from __future__ import annotations

from .queries import base, geometry, graphs, joins, reports  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
FLAGSHIP = "a1_type_histogram"
