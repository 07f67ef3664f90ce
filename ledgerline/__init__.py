"""Governed banking analytics as Spark DataFrames.

Sources give the raw star schema, plans turn it into governed marts and metrics,
operators hold the reusable relational pieces and functions the column helpers.
"""

from ledgerline.sources.tables import Tables
from ledgerline.plans.models import with_models

__all__ = ["Tables", "with_models"]
