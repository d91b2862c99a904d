"""Registered queries: each module binds operators to the supplied tables."""

from __future__ import annotations

from .registry import Registry


def all_queries() -> Registry:
    from . import (
        activity_queries, catalogue_queries, flow_queries, import_queries, ingest_queries, match_queries, merge_queries, search_queries, stream_queries,
    )

    reg = Registry()
    for module in (catalogue_queries, activity_queries, search_queries, match_queries, ingest_queries, merge_queries, import_queries, stream_queries, flow_queries):
        module.register(reg)
    return reg
