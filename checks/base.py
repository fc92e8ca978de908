"""Registry of checked queries and the SQL building blocks of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Float results differ in the last bits between engines; round them before hashing. -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def sql_round(inner: str, cols: str, doubles: str, digits: int = 6) -> str:
    """SELECT cols (kept) and doubles (rounded) FROM (inner); name lists are comma-separated."""
    kept = [c.strip() for c in cols.split(",") if c.strip()]
    nums = [f"round({c.strip()}, {digits}) + 0.0::DOUBLE AS {c.strip()}" for c in doubles.split(",") if c.strip()]
    return f"{inner_with(inner)} SELECT {', '.join(kept + nums)} FROM _result"


def inner_with(inner: str) -> str:
    """Turn 'WITH a AS (..) SELECT ..' into a WITH list that ends in _result."""
    text = inner.strip()
    if text.upper().startswith("WITH "):
        marker = "\n--result\n"
        head, tail = text.split(marker.strip(), 1)
        return f"{head.rstrip().rstrip(',')}, _result AS ({tail})"
    return f"WITH _result AS ({text})"


TELEMETRY_RAW = """telemetry_raw AS (
  SELECT concat('A-', CAST(l_suppkey AS VARCHAR)) AS asset_id, l_shipdate AS timestamp, l_quantity AS production,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('src-', l_linestatus) END AS source,
    CASE l_returnflag WHEN 'R' THEN 'REAL' WHEN 'A' THEN 'SYNTHETIC' ELSE 'DERIVED' END AS source_type,
    CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 65 END AS pressure,
    nullif(l_discount, 0) * 1000 AS temperature, l_quantity * (1 + l_tax) AS flow_rate,
    CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS valve_status,
    l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem)"""

MONTHLY = """monthly AS (
  SELECT asset_id, period, t, actual,
    avg(actual) OVER (PARTITION BY asset_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS expected
  FROM (SELECT asset_id, period, actual,
               CAST(row_number() OVER (PARTITION BY asset_id ORDER BY period) - 1 AS INTEGER) AS t
        FROM (SELECT concat('A-', CAST(l_suppkey AS VARCHAR)) AS asset_id,
                     CAST(date_trunc('month', l_shipdate) AS DATE) AS period, sum(l_quantity) AS actual
              FROM lineitem GROUP BY 1, 2) m) r)"""

ASSETS = """assets AS (
  SELECT concat('A-', CAST(s_suppkey AS VARCHAR)) AS asset_id, n_name AS field_name, r_name AS basin,
    CASE WHEN s_suppkey % 12 = 10 THEN 'DORMANT' ELSE 'ACTIVE' END AS status,
    CAST(1985 + s_suppkey % 30 AS INTEGER) AS onstream_year,
    CAST(0.5 + (s_suppkey % 14)::DOUBLE / 10.0::DOUBLE AS DOUBLE) AS intervention_cost,
    CAST(250 + s_suppkey % 50 AS DOUBLE) AS qi,
    0.001::DOUBLE + (s_suppkey % 5)::DOUBLE / 1000.0::DOUBLE AS di,
    0.45::DOUBLE + (s_suppkey % 30)::DOUBLE / 100.0::DOUBLE AS b
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

EVENTS = """events_telemetry AS (
  SELECT concat('U-', CAST(user_id AS VARCHAR)) AS asset_id, ts AS timestamp, value AS production, event_type AS source,
    CASE user_id % 3 WHEN 0 THEN 'REAL' WHEN 1 THEN 'SYNTHETIC' ELSE 'DERIVED' END AS source_type,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE value * 2 END AS pressure,
    NULL::DOUBLE AS temperature, NULL::DOUBLE AS flow_rate, NULL::VARCHAR AS valve_status, props, event_id
  FROM events)"""

LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"
LINE_ORDER_DESC = ", ".join(f"{c.strip()} DESC" for c in LINE_ORDER.split(","))


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)
