"""Runnable queries, each with the SQL that must give the same rows where SQL can say it."""

from fieldlake.queries import (  # noqa: F401
    formulas, intervals, modelling, planning, preparation, profiling, rasters, requests, stages,
)
from fieldlake.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
