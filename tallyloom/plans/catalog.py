"""All queries of the core with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators import history
from tallyloom.plans import domain, guard_queries, star, upkeep_queries
from tallyloom.plans.roles import Roles

Query = Callable[[SparkSession, str], DataFrame]


def _over_roles(f: Callable[[Roles], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Roles(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {"p7_found": history.p7_found} | {k: _over_roles(f) for k, f in (star.QUERIES | domain.QUERIES | upkeep_queries.QUERIES | guard_queries.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": history.P7_SQL} | star.SQL | domain.SQL | upkeep_queries.SQL | guard_queries.SQL
