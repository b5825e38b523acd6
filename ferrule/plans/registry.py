"""All queries of the package, registered by importing their modules."""

from . import ORACLES, QUERIES, cases, files, intake, store, tables

__all__ = ["ORACLES", "QUERIES", "cases", "files", "intake", "store", "tables"]
