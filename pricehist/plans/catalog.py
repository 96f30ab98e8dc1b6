"""All registered queries of the price-history library, by module."""

from __future__ import annotations

from pricehist.plans import context, evaluation, forest, marts, models, names, panel, vintages

FLAGSHIP = "o1_catalog_page"
MODULES = (panel, context, names, marts, vintages, evaluation, models, forest)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
