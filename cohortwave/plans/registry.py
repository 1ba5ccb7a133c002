"""All queries of this library outside the training-data operators."""

from __future__ import annotations

from cohortwave.plans import base, clean_queries, model_queries, series_queries, source_queries, stat_queries  # noqa: F401

QUERIES, ORACLES = base.QUERIES, base.ORACLES
