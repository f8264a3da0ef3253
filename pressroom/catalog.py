"""Every query of the library over the driver's tables, with its SQL twin."""

from __future__ import annotations

from .plans import check_queries, desk_queries, draft_queries, ledger_queries, library_queries, scalars, stream_queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "check_queries", "desk_queries", "draft_queries", "ledger_queries", "library_queries", "scalars", "stream_queries"]
