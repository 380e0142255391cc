"""Registered queries: each operator on the given tables, with the SQL that must agree."""

from catalog import assurance, lifecycle, privacy, profiles, rules, runs, sources, streams
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "assurance", "lifecycle", "privacy", "profiles", "rules", "runs", "sources", "streams"]
