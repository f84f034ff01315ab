"""All registered queries over the reference tables and their SQL."""

from skriva.plans import cue_queries, level_queries, report_queries, run_queries, score_queries, sql_queries, stat_queries, text_queries  # noqa: F401
from skriva.plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
