"""Queries over the driver tables, grouped by the operators they exercise."""

from cohortlens.plans.catalog import (  # noqa: F401
    cohort_queries,
    join_queries,
    model_queries,
    page_queries,
    profile_queries,
    quality_queries,
    report_queries,
    resolve_queries,
    sink_queries,
    staging_queries,
)
from cohortlens.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
