"""Queries with their SQL."""

from tectra.plans import proofs, queries  # noqa: F401
