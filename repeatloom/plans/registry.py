"""The queries outside the training-data subpackage and their SQL, by name."""

from __future__ import annotations

from . import call_queries, locus_queries, read_queries, sequence_queries, table_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (call_queries, locus_queries, read_queries, sequence_queries, table_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
