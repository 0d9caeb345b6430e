"""The driver tables as tables of the visit-planning domain.

Each view is one SQL text that Spark and DuckDB evaluate alike (integer arithmetic, double literals), so that
queries and their twins share their input. Views may use earlier views.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task gets when a table is dealt by key.
ROWS_A_TASK = 1 << 17
#: Rows that it gets at most where it does no more than sort them and gather them by key.
ROWS_A_LIGHT_TASK = 1 << 21

TABLES = "region nation customer supplier part orders lineitem events".split()

VIEWS: dict[str, str] = {
    "points": """
SELECT c_nationkey AS organization_id, c_custkey AS point_id,
  CASE WHEN c_custkey % 2 = 0 THEN -2.9348e0 + ((c_custkey * 7919 % 397) - 198) / 1e4 ELSE -3.6e0 + (c_custkey * 7919 % 17000) / 1e4 END AS longitude,
  CASE WHEN c_custkey % 2 = 0 THEN 43.2630e0 + ((c_custkey * 104729 % 389) - 194) / 1e4 ELSE 42.85e0 + (c_custkey * 104729 % 7000) / 1e4 END AS latitude,
  'Muni ' || CAST(c_custkey % 40 AS STRING) AS municipality, CAST(48000 + c_custkey % 100 AS STRING) AS postal_code,
  CASE WHEN c_custkey % 11 = 0 THEN 'urban' WHEN c_custkey % 13 = 0 THEN 'rural' END AS municipality_kind
FROM customer""",
    "patients": """
SELECT c_custkey AS patient_id, c_nationkey AS organization_id, 'PAC-' || CAST(c_custkey AS STRING) AS external_ref,
  c_name AS display_ref, CASE WHEN c_custkey % 20 = 0 THEN 'inactive' ELSE 'active' END AS status,
  c_custkey % 9 AS source_batch_id
FROM customer""",
    "addresses": """
SELECT c_custkey * 10 + v.version AS address_id, c_custkey AS patient_id, c_nationkey AS organization_id, CAST(v.version AS INT) AS version,
  v.version = 1 + (CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) AS is_active,
  CASE c_custkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'not_found' WHEN 3 THEN 'manual' ELSE 'matched' END AS geocode_status,
  CASE WHEN c_custkey % 10 > 2 THEN p.longitude END AS longitude, CASE WHEN c_custkey % 10 > 2 THEN p.latitude END AS latitude,
  CASE c_custkey % 4 WHEN 0 THEN 'C/ ' WHEN 1 THEN 'Avda. ' WHEN 2 THEN 'Pl. ' ELSE 'Calle ' END || 'Señorío ' || CAST(c_custkey % 50 AS STRING) || 'a'
    || CASE WHEN c_custkey % 3 = 0 THEN ' ,  3º Izq' ELSE '' END AS address,
  p.municipality, p.postal_code, 'Bizkaia' AS province
FROM customer JOIN points p ON p.point_id = c_custkey JOIN (VALUES (1), (2)) AS v(version) ON v.version <= 1 + (CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END)""",
    "zone_history": """
SELECT o.o_custkey AS patient_id, c.c_nationkey AS organization_id, o_orderpriority AS zone_id, o_orderdate AS valid_from,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to,
  CASE WHEN o_orderkey % 17 = 0 THEN 'manual' ELSE 'cluster' END AS source
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "zones": """
SELECT c.c_nationkey AS organization_id, o_orderpriority AS zone_id, o_orderpriority AS name, CAST(2 + c.c_nationkey % 15 AS INT) AS max_visits,
  CASE c.c_nationkey % 3 WHEN 0 THEN 'urban' WHEN 1 THEN 'rural' ELSE 'mixed' END AS kind, CAST(1 AS INT) AS version
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey, o_orderpriority""",
    "import_rows": """
SELECT c.c_nationkey AS organization_id, substr(CAST(o_orderdate AS STRING), 1, 7) AS period,
  substr(CAST(o_orderdate AS STRING), 1, 7) || '/' || o_orderpriority || '/' || CAST(c.c_nationkey AS STRING) AS batch_id,
  CAST(row_number() OVER (PARTITION BY substr(CAST(o_orderdate AS STRING), 1, 7), o_orderpriority, c.c_nationkey ORDER BY o_orderkey) AS INT) AS row_number,
  CASE WHEN o_orderkey % 97 = 0 THEN '  ' WHEN o_orderkey % 3 = 0 THEN ' pac-' || CAST(o_custkey AS STRING) || ' ' ELSE 'PAC-' || CAST(o_custkey AS STRING) END AS external_ref,
  'Ref ' || CAST(o_custkey AS STRING) AS display_ref,
  CASE WHEN o_orderkey % 41 = 0 THEN '=1+2' WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN repeat('x', 301) ELSE 'Calle Mayor ' || CAST(o_orderkey % 60 AS STRING) END AS address,
  CASE WHEN o_orderkey % 31 = 0 THEN '4800' ELSE CAST(48000 + o_custkey % 100 AS STRING) END AS postal_code,
  'Muni ' || CAST(o_custkey % 40 AS STRING) AS municipality, CASE WHEN o_orderkey % 53 = 0 THEN chr(9) || 'Bizkaia' ELSE 'Bizkaia' END AS province,
  o_orderstatus = 'P' AS cancelled
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "gazetteer": """
SELECT p_partkey AS point_no, p_name AS street, CAST(p_size AS STRING) AS house_number, 'Muni ' || CAST(p_partkey % 40 AS STRING) AS municipality,
  CAST(48000 + p_partkey % 100 AS STRING) AS postal_code, 43.2e0 + (p_partkey % 1000) / 1e4 AS latitude, -2.9e0 - (p_partkey % 777) / 1e4 AS longitude,
  CASE WHEN p_partkey % 5 = 0 THEN 'Calle ' || p_brand ELSE '' END AS aliases
FROM part""",
    "candidates": """
SELECT c_custkey AS address_id, CAST(o.ordinal AS INT) AS ordinal, 43.2e0 + ((c_custkey * 31 + o.ordinal * o.ordinal * 7) % 200) / 1e4 AS latitude, -2.9e0 - ((c_custkey * 17 + o.ordinal * 3) % 150) / 1e4 AS longitude,
  'Calle ' || CAST(c_custkey % 30 AS STRING) || ' Muni ' || CAST((c_custkey + o.ordinal % 2) % 40 AS STRING) AS display_label,
  ((c_custkey * o.ordinal * 37) % 101) / 1e2 AS importance,
  CASE (c_custkey + o.ordinal) % 4 WHEN 0 THEN 'house' WHEN 1 THEN 'building' WHEN 2 THEN 'road' ELSE 'place' END AS place_class,
  CASE WHEN (c_custkey + o.ordinal) % 3 <> 0 THEN CAST(48000 + c_custkey % 100 AS STRING) END AS candidate_postal_code,
  'Muni ' || CAST((c_custkey + o.ordinal % 3) % 40 AS STRING) AS candidate_municipality,
  CASE WHEN o.ordinal % 2 = 1 THEN CAST(c_custkey % 30 AS STRING) END AS house_number
FROM customer JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS o(ordinal) ON o.ordinal <= c_custkey % 7""",
    "stops": """
SELECT l_orderkey AS revision_id, l_orderkey AS route_id, c.c_nationkey AS organization_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS INT) AS sequence,
  l_partkey AS patient_id, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status,
  CAST(l_quantity AS INT) AS service_minutes, l_shipdate AS shipped, o.o_orderdate AS service_date, o.o_orderstatus AS order_status,
  CASE WHEN l_partkey % 50 <> 0 THEN -2.9348e0 + ((l_partkey * 7919 % 397) - 198) / 1e4 END AS longitude,
  CASE WHEN l_partkey % 50 <> 0 THEN 43.2630e0 + ((l_partkey * 104729 % 389) - 194) / 1e4 END AS latitude
FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey""",
    "arcs": """
SELECT a.route_id, CAST(a.sequence AS INT) AS i, CAST(b.sequence AS INT) AS j, CAST(60 + (a.patient_id * 13 + b.patient_id * 29) % 900 AS DOUBLE) AS duration_s,
  CAST(100 + (a.patient_id * 31 + b.patient_id * 17) % 9000 AS DOUBLE) AS distance_m
FROM stops a JOIN stops b ON a.route_id = b.route_id AND a.sequence <> b.sequence""",
    "visits": """
SELECT c_nationkey AS plan_id, c_custkey AS patient_id, o.zone_id, CASE WHEN c_custkey % 4 = 0 THEN 'rural' ELSE 'urban' END AS kind,
  c_custkey % 19 <> 0 AS geocode_confirmed, CAST(30 + 15 * (c_custkey % 4) AS INT) AS service_minutes,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(480 + 60 * (c_custkey % 5) AS INT) END AS window_start,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(600 + 60 * (c_custkey % 7) AS INT) END AS window_end
FROM customer JOIN (SELECT o_custkey, max(o_orderpriority) AS zone_id FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey""",
    "constraints": """
SELECT n_nationkey AS plan_id, '2026-' || lpad(CAST(1 + n_nationkey % 12 AS STRING), 2, '0') AS period, CAST(n_nationkey % 6 AS INT) AS off_weekday,
  CAST(300 + 30 * (n_nationkey % 7) AS INT) AS workday_minutes, CAST(45 AS INT) AS service_minutes, CAST(6 + n_nationkey % 5 AS INT) AS max_visits,
  CASE WHEN n_nationkey % 3 = 1 THEN 'rural' ELSE 'urban' END AS zone_kind,
  CASE WHEN n_nationkey % 4 = 0 THEN CAST(480 AS INT) END AS window_start, CASE WHEN n_nationkey % 4 = 0 THEN CAST(840 AS INT) END AS window_end
FROM nation""",
    "metrics": """
SELECT o_orderkey AS revision_id, v.variant, (o_orderkey + length(v.variant)) % 23 = 0 AS stale
FROM orders JOIN (VALUES ('original'), ('optimized'), ('actual')) AS v(variant) ON (o_orderkey * 7 + length(v.variant)) % 29 <> 0""",
    "publish_requests": """
SELECT o_orderkey AS route_id,
  CASE o_orderkey % 19 WHEN 0 THEN 'published' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'ready' WHEN 3 THEN NULL ELSE 'draft' END AS route_status,
  CAST(o_orderkey % 5 AS INT) AS version, CAST(CASE WHEN o_orderkey % 37 = 0 THEN 9 ELSE o_orderkey % 5 END AS INT) AS expected_version,
  CASE WHEN o_orderkey % 41 <> 0 THEN o_orderkey END AS current_revision,
  CASE WHEN o_orderkey % 43 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS revision_id,
  CASE o_orderkey % 31 WHEN 0 THEN 'published' WHEN 1 THEN 'superseded' WHEN 2 THEN NULL ELSE 'draft' END AS revision_status,
  CASE WHEN o_orderkey % 17 = 5 THEN 'infeasible' ELSE 'feasible' END AS solver_status,
  CASE WHEN o_orderkey % 47 <> 0 THEN 'A' END AS origin, CASE WHEN o_orderkey % 53 <> 0 THEN 'B' END AS destination
FROM orders""",
    "reports": """
SELECT event_id, user_id AS stop_id, ts AS reported_at, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
  event_type, value, props FROM events""",
}


def needed(sql: str) -> list[str]:
    """Views that a SQL text uses, directly or through others, in order."""
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(VIEWS[name])

    visit(sql)
    return [n for n in VIEWS if n in seen]


def dealt(df: DataFrame, key: str, light: bool = False) -> DataFrame:
    """``df`` dealt by key to as many tasks as its rows ask for, so that what a task sorts stays the same however many rows there are.

    Left to itself, Spark puts together what falls under its advisory size, which grows with the table up to 64 MB of packed columns, some 2 million rows a sort.
    With more tasks than ``spark.shuffle.sort.bypassMergeThreshold``, those that write the shuffle hold all rows of their split; so ``light`` work, which takes
    little more memory for more rows, first fills that number of tasks up to ``ROWS_A_LIGHT_TASK``.
    """
    rows = df.count()
    tasks = math.ceil(rows / ROWS_A_TASK)
    if light:
        unheld = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
        tasks = min(tasks, max(unheld, math.ceil(rows / ROWS_A_LIGHT_TASK)))
    return df.repartition(max(1, tasks), key)


#: The same inner joins, for Spark: an order meets its customer before its stops do, which stay dealt by route where customers are too many to be broadcast.
ORDERS_FIRST = (
    "FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey",
    "FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem ON o.o_orderkey = l_orderkey",
)


def view(spark: SparkSession, sf_dir: str, name: str, light: bool = False) -> DataFrame:
    """A domain view, or a driver table, as a DataFrame; ``light`` says that the stops are only gathered by route (see :func:`dealt`)."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in [*TABLES, *VIEWS] if n != name and re.search(rf"(?:FROM|JOIN) {n}\b", sql)}
    if name == "stops":
        parts["lineitem"] = dealt(parts["lineitem"], "l_orderkey", light).hint("merge")  # else the planner, which takes joined orders for more, broadcasts few stops
        sql = sql.replace(*ORDERS_FIRST)
    for n in parts:
        sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}} AS {n}" if not re.search(rf"(?:FROM|JOIN) {n} \w\b(?! *=)", sql) else rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **parts)


def with_views(sql: str) -> str:
    """A DuckDB query over the driver tables, with the views it uses put before it."""
    views = needed(sql)
    if not views:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in views)
    body = sql.strip()
    start = re.match(r"WITH( RECURSIVE)?\b", body)
    if not start:
        return f"WITH {head}\n{body}"
    return f"{start[0]} {head},{body[start.end():]}"
