"""Registered queries over the given tables, with their SQL counterparts."""

from __future__ import annotations

from workload import (
    feature_queries,
    hit_queries,
    map_queries,
    similarity_queries,
    statistics_queries,
    study_queries,
    text_queries,
)

MODULES = [
    hit_queries,
    feature_queries,
    similarity_queries,
    statistics_queries,
    text_queries,
    study_queries,
    map_queries,
]

QUERIES = {name: build for module in MODULES for name, build in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
