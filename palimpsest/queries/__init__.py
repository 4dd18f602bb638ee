"""The registered queries, each with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL of the derived tables in ``views``, for WITH clauses.
INF = "TIMESTAMP '9999-12-01 23:59:00'"
TEXT = "'%Y%m%d%H%M%S%g'"
USER_STATE = f"user_state AS (SELECT user_id, event_id, event_type, value, date_trunc('millisecond', ts) AS IN_Z, coalesce(lead(date_trunc('millisecond', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), {INF}) AS OUT_Z FROM events)"
CUST_PRIORITY = f"cust_priority AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, o_orderdate AS FROM_Z, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), {INF}) AS THRU_Z FROM orders)"
BELIEF_LINE = f"belief_line AS (SELECT l_orderkey, l_linenumber, o_custkey, l_quantity, l_shipdate AS FROM_Z, l_shipdate + INTERVAL 180 DAY AS THRU_Z, o_orderdate AS IN_Z, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN {INF} ELSE o_orderdate + INTERVAL 365 DAY END AS OUT_Z FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def belief_log(kind: str) -> str:
    bounded = "o_orderkey % 5 = 0"
    op = f"CASE WHEN {bounded} THEN 'increment_until' ELSE 'increment' END" if kind == "increments" else f"CASE WHEN {bounded} THEN 'update_until' ELSE 'update' END"
    if kind == "ends":
        op = f"CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN {bounded} THEN 'terminate_until' ELSE 'terminate' END ELSE {op} END"
    return f"""log AS (
      SELECT o_custkey, {op} AS op, o_orderdate AS b, CASE WHEN {bounded} THEN o_orderdate + INTERVAL 90 DAY ELSE {INF} END AS u,
             o_orderdate + to_days(CAST((o_orderkey * 37) % 120 AS INTEGER)) + to_seconds(CAST(o_orderkey % 86400 AS INTEGER)) AS p, o_orderkey AS seq, o_totalprice AS value FROM orders
      UNION ALL SELECT DISTINCT o_custkey, 'insert', TIMESTAMP '1990-01-01', {INF}, TIMESTAMP '1990-01-01', 0, 0.0 FROM orders)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir); the session zone is fixed first."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from palimpsest.queries import access, mutations, predicates, quality, relations, temporal  # noqa: F401
