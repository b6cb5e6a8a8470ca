"""Every query of the library by name, and its DuckDB SQL."""

from __future__ import annotations

from auditlake.plans import detection, findings, graphs, payload_queries, project_queries, streams, texts  # noqa: F401  they register their queries
from auditlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
