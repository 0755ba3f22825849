"""Importing the package registers all queries."""

from . import catalogue, flows, gates, learned, parsed, problems, ranked, reports, symbolgraph, wider

__all__ = ["catalogue", "flows", "gates", "learned", "parsed", "problems", "ranked", "reports", "symbolgraph", "wider"]
