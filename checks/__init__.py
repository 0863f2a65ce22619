"""Bindings of the operators to the driver's tables, with a DuckDB statement for each."""

from checks.registry import ORACLES, QUERIES
from checks import adjustment_queries, alarm_queries, energy_queries, kpi_queries, plan_queries, quality_queries, source_queries

__all__ = ["ORACLES", "QUERIES"]
