"""Importing this registers every query of the library."""

from gristmill.plans import catalog_queries, decision_queries, file_queries, ingest_queries, office_queries, page_queries, report_queries, text_queries, upkeep_queries, url_queries  # noqa: F401
from gristmill.plans import stream_queries  # noqa: F401, I001  (after the batch queries, whose SQL it shares)
