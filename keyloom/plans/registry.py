"""All registered queries of the engine's own operators."""

from __future__ import annotations

from . import collections, documents, live, ranked, strings

PLANS = {name: plan for module in (strings, collections, ranked, documents, live) for name, plan in module.PLANS.items()}


def queries() -> dict:
    return {name: plan.run for name, plan in PLANS.items()}


def oracle_sql() -> dict:
    return {name: plan.sql for name, plan in PLANS.items() if plan.sql}
