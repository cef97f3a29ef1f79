"""Named queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import detail_queries, evidence_queries, judgement_queries, model_queries, relational_queries, report_queries, segment_queries, source_queries, span_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["flow_passages"](spark, sf_dir)
