"""A registry of queries and of the SQL that says the same."""

from __future__ import annotations

import functools

from slotloom.plans import base


class Registry:
    """share: whether the queries use the labelled slots more than once, so that these are written once a run."""

    def __init__(self, share: bool = False) -> None:
        self.share = share
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None, *ctes: str):
        """Registers a query (spark, sf_dir); oracle: its SQL, with the named CTEs of base before it."""

        def keep(f):
            @functools.wraps(f)
            def run(spark, sf_dir):
                with base.shared_slots():
                    return f(spark, sf_dir)

            self.queries[f.__name__] = run if self.share else f
            if oracle is not None:
                self.oracles[f.__name__] = base.sql(*ctes, body=oracle) if ctes else oracle
            return f

        return keep
