"""All registered queries: importing this module fills ``QUERIES`` and ``SQL``."""

from . import catalog, catalog_io, catalog_reports, catalog_rows  # noqa: F401
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
