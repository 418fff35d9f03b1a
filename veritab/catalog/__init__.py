"""Named queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from veritab.catalog.registry import ORACLE, QUERIES


def load() -> tuple[dict, dict]:
    from veritab.catalog import columns, encoders, learning, pairwise, preparation, recursion, repairs, rowlevel, spatial  # noqa: F401

    return QUERIES, ORACLE
