"""The registered queries of the element and drawing engine, each with its SQL counterpart."""

from __future__ import annotations

from . import cropgrids, drawings, halls, intents, isolations, layouts, models, regions, resolution, rollups, scalars, searches, specs, texts

MODULES = (rollups, searches, drawings, resolution, models, texts, layouts, regions, specs, isolations, intents, halls, cropgrids, scalars)


def queries() -> dict:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
