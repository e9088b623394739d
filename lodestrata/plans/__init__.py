"""Registered queries of the engine and the SQL each is held against."""

from __future__ import annotations

from lodestrata.plans import (  # noqa: F401
    corpus,
    decisions,
    extras,
    facts,
    history,
    markup,
    operations,
    page_nodes,
    quality,
    question_batches,
    scalars,
    search,
    sources,
    state,
    streams,
    texts,
    topics,
)
from lodestrata.plans import builds  # noqa: F401, E402, I001  it takes an oracle of the modules above
from lodestrata.plans._registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
