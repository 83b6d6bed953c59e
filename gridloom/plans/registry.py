"""Queries by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from gridloom.plans import cast_queries, contact_queries, ordered_queries, reduction_queries, region_queries, spatial_queries, void_queries, workflows

FLAGSHIP = "contact_network"
QUERIES = {**spatial_queries.QUERIES, **ordered_queries.QUERIES, **contact_queries.QUERIES, **cast_queries.QUERIES, **workflows.QUERIES, **reduction_queries.QUERIES, **region_queries.QUERIES, **void_queries.QUERIES}
ORACLE_SQL = {**spatial_queries.ORACLE_SQL, **ordered_queries.ORACLE_SQL, **contact_queries.ORACLE_SQL, **cast_queries.ORACLE_SQL, **workflows.ORACLE_SQL, **reduction_queries.ORACLE_SQL, **region_queries.ORACLE_SQL, **void_queries.ORACLE_SQL}
