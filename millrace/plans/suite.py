"""Loads every query module so that the registry is complete."""

from . import suite_audit, suite_docs, suite_forecast, suite_plans, suite_quality, suite_series, suite_stream, suite_tables  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
