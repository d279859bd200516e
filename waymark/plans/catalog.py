"""All registered queries. Importing the modules fills the registry."""

from waymark.plans import catalog_functions, catalog_lookups, catalog_matching, catalog_reports, catalog_roads, catalog_routes, catalog_streams, catalog_tables  # noqa: F401
from waymark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
