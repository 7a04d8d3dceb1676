"""All queries on the driver's tables, with the SQL that must give the same rows."""

from loamworks.plans import aggregates, boards, compatibility, entities, filters, graphs, grids, joins, kernels, lookups, publish, requests, seeds, series, sources, spatial, tables, texts, values, windows  # noqa: F401  they register their queries
from loamworks.plans.registry import ORACLE, QUERIES  # noqa: F401
