"""Queries by name, and the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agora.sources.civic import Civic, sql_with

Plan = Callable[[Civic], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan over civic tables; ``sql`` names tables in braces."""

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = plan
        if sql:
            SQL[name] = sql_with(sql.strip())
        return plan

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from agora.plans import load

    load()
    return {name: (lambda spark, sf_dir, plan=plan: plan(Civic(spark, sf_dir))) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    from agora.plans import load

    load()
    return dict(SQL)
