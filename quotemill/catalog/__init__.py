"""Registered queries over the given tables, with comparison SQL."""

from __future__ import annotations

from quotemill.catalog import base
from quotemill.catalog import (  # noqa: F401
    evaluation_queries,
    job_queries,
    news_queries,
    policy_queries,
    price_queries,
)


def queries():
    return dict(base.QUERIES)


def oracles():
    return dict(base.ORACLES)
