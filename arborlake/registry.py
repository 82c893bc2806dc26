"""All queries of the analytics operators, with the SQL that restates them."""

from __future__ import annotations

from arborlake.plans import compared, content, heat, more, rank, relational
from arborlake.plans.core import Query

CATALOGS = [heat.catalog, rank.catalog, relational.catalog, content.catalog, more.catalog, compared.catalog]
QUERIES: dict[str, Query] = {name: query for c in CATALOGS for name, query in c.queries.items()}
ORACLES: dict[str, str] = {name: sql for c in CATALOGS for name, sql in c.oracles.items()}
