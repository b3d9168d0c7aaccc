"""All queries of the library but those of the training-data subpackage."""

from __future__ import annotations

from . import attack_queries, metric_queries, model_queries, record_queries, text_queries
from .base import ORACLES, QUERIES, query, scored, table

__all__ = ["ORACLES", "QUERIES", "attack_queries", "metric_queries", "model_queries", "query", "record_queries", "scored", "table", "text_queries"]
