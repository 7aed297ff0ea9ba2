"""Queries over the TPC-H-like tables, each beside the SQL that must agree with it."""

from catalog import batches, cells, lenient, pipelines, profiles, sources, sql_form
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

_MODULES = (batches, cells, lenient, pipelines, profiles, sources, sql_form)
