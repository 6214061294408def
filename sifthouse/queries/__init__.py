"""All registered queries of the engine, with the SQL that checks them."""

from . import library, live, search, signals, tables, upkeep
from .registry import ORACLE_SQL, QUERIES
from .search import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "library", "live", "search", "signals", "tables", "upkeep"]
