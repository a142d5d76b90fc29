"""Registered queries: operators applied to the given tables, with SQL twins."""

from galvanite.catalog.base import ORACLES, QUERIES

from galvanite.catalog import (  # noqa: F401, E402
    aggregations, selections, lookups, metrics, regressions, sequences, scalars, numerics,
)

__all__ = ["ORACLES", "QUERIES"]
