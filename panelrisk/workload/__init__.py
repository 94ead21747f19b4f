"""Registered queries: every operator over the given tables, with SQL where SQL can say it."""

from panelrisk.workload.base import ORACLES, QUERIES
from panelrisk.workload import (entity_queries, index_queries, media_queries,  # noqa: F401
                                metric_queries, panel_queries, quality_queries,
                                rollup_queries, scan_queries, stream_queries, window_queries)

__all__ = ["ORACLES", "QUERIES"]
