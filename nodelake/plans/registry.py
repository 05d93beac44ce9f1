"""Every registered query of the catalog, array, table and run operators, with its SQL."""

from __future__ import annotations

from nodelake.plans import catalog_queries, data_queries

QUERIES = catalog_queries.QUERIES | data_queries.QUERIES
ORACLES = catalog_queries.ORACLES | data_queries.ORACLES
