"""Every query of the library by name, and the SQL that states the same result."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir); ``oracle`` is SQL over the tables for the same rows."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


from tidewake.plans import activity, channels, edges, folding, keeping, matching, measures, notices, receiving, records, signals, storing, streams, texts, timeline  # noqa: E402, F401
