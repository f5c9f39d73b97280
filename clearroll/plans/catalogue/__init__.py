"""Every operator as a query over the driver's tables, with the SQL it must equal."""

from .registry import QUERIES, query

from . import records, checking, directory, monitoring, privacy, documents, streams  # noqa: E402,F401

__all__ = ["QUERIES", "query"]
