"""The queries of the engine's own operators, their SQL, and the flagship query."""

from __future__ import annotations

from quarry.operators.semfilter import FilterConfig
from quarry.plans import queries as own
from quarry.plans.oracle import oracle_sql
from quarry.plans.queries import queries

__all__ = ["flagship", "oracle_sql", "queries"]


def flagship(spark, sf_dir):
    """Texts with good entities, however few, and their mean density, by source and language."""
    return own.density_by_source(spark, sf_dir, FilterConfig(threshold_density=0.0))
