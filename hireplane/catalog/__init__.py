"""Registered queries with their inputs and check SQL."""

from hireplane.catalog import registry


def _load() -> None:
    from hireplane.catalog import q_candidates, q_filings, q_postings, q_scoring  # noqa: F401


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_oracles():
    _load()
    return dict(registry.ORACLES)
