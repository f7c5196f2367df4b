"""Queries over the driver's tables, one for each operator."""

from tessera.plans import access, changes, customer, governance, insights, language, operations, pipeline, warehouse
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "access", "changes", "customer", "governance", "insights", "language", "operations", "pipeline", "warehouse"]
