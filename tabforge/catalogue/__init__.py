"""Named queries over the driver's tables, with SQL oracles where SQL can say the same."""

from tabforge.catalogue import calendar_queries, feature_queries, linear_queries, metric_queries, model_queries, table_queries
from tabforge.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calendar_queries", "feature_queries", "linear_queries", "metric_queries", "model_queries", "table_queries"]
