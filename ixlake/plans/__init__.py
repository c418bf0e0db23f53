"""Registered queries over the given tables."""

from ixlake.plans import decode, idl, ingest, log, replay, state  # noqa: F401
from ixlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
