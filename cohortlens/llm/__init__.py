"""Operators for preparing training text, and the queries that apply them to whole tables."""

from cohortlens.llm import queries  # noqa: F401
from cohortlens.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
