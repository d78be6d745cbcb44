"""All published queries."""

import importlib

from .registry import QUERIES, SQL

for _part in ("text_queries", "window_queries", "match_queries", "score_queries", "label_queries", "metric_queries",
              "source_queries", "report_queries", "model_queries", "detail_queries"):
    importlib.import_module(f"{__package__}.{_part}")

__all__ = ["QUERIES", "SQL"]
