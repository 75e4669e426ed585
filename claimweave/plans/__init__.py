"""Registered queries: operators bound to the test tables, each with its SQL twin."""

from claimweave.plans import accounting, attach, checks, governance, graph, ingest, review, rules, streams, workflow  # noqa: F401
from claimweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
