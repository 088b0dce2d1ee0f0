"""Registered queries over the named tables, each with the SQL that states the same rows."""

from larkspur.plans.catalog import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
