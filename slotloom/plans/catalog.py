"""All queries over the reference operators and their SQL."""

from __future__ import annotations

from slotloom.plans import align_queries, data_queries, metric_queries, mining_queries, rule_queries, stream_queries, text_queries

PARTS = [stream_queries, text_queries, rule_queries, align_queries, metric_queries, mining_queries, data_queries]


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.R.queries.items()}


def oracles() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.R.oracles.items()}
