"""The catalogue of queries: each operator family on the driver's tables, with its SQL oracle.

Orders are submissions, their line items a repeat; customers, parts and nations
are pre-loaded data; events are an incoming stream; documents are text answers.
"""

from __future__ import annotations

from . import queries_data, queries_forms, queries_more, queries_rules, queries_scale
from .registration import CATALOGUE, Query, query, table

flagship = queries_data.priority_share
__all__ = ["CATALOGUE", "Query", "flagship", "queries_data", "queries_forms", "queries_more", "queries_rules", "queries_scale", "query", "table"]
