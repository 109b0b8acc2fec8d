"""Queries over the operators of this engine, each with the SQL that states what it computes."""

from __future__ import annotations

from . import aggregate_queries, frame_queries, function_queries, interval_queries, more_queries, source_queries, text_queries, transcript_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (interval_queries, frame_queries, aggregate_queries, text_queries, transcript_queries, function_queries, source_queries, more_queries):
    QUERIES |= _module.REGISTRY.queries
    ORACLES |= _module.REGISTRY.oracles
