"""Registered queries with their SQL."""

from __future__ import annotations

from latentia.plans import corpus_queries, io_queries, model_queries, ner_queries, parse_queries, rep_queries

_PARTS = (corpus_queries, io_queries, parse_queries, rep_queries, model_queries, ner_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
