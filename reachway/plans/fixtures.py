"""Deterministic fixtures over the driver's tables: one SQL text serves Spark and the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PLACE = "JOIN {nation} ON {key}_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
_LON = "-81e0 + CAST((c_custkey * 7919) % 12000 AS DOUBLE) / 1000e0"
_LAT = "-18e0 + CAST((c_custkey * 104729) % 17000 AS DOUBLE) / 1000e0"
FIXTURES = {
    "fx_demand": f"""
SELECT c_custkey AS cp_id, c_name AS nombre, CAST(floor(greatest(c_acctbal, 0e0)) AS BIGINT) AS poblacion,
       r_name AS departamento, n_name AS provincia, concat(n_name, '-', c_mktsegment) AS distrito, {_LON} AS lon, {_LAT} AS lat,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 4500 AS DOUBLE) END AS altitud_m
FROM {{customer}} {_PLACE.replace('{key}', 'c')}""",
    "fx_demand_raw": f"""
WITH fx_b AS (
  SELECT c_custkey AS k, c_name, c_acctbal, c_mktsegment, n_name, r_name, {_LON} AS lon0, {_LAT} AS lat0 FROM {{customer}} {_PLACE.replace('{key}', 'c')}
), fx_d AS (
  SELECT k AS cp_id, c_name AS nombre, CAST(floor(greatest(c_acctbal, 0e0)) AS BIGINT) AS poblacion,
         r_name AS departamento, n_name AS provincia, concat(n_name, '-', c_mktsegment) AS distrito,
         CASE k % 25 WHEN 0 THEN 0e0 WHEN 1 THEN lat0 WHEN 2 THEN 10e0 WHEN 3 THEN NULL ELSE lon0 END AS lon,
         CASE k % 25 WHEN 0 THEN 0e0 WHEN 1 THEN lon0 WHEN 2 THEN 10e0 ELSE lat0 END AS lat
  FROM fx_b
)
SELECT * FROM fx_d
UNION ALL
SELECT cp_id, CAST(NULL AS STRING), poblacion, departamento, provincia, distrito, lon, lat FROM fx_d WHERE cp_id % 30 = 7""",
    "fx_facility": f"""
SELECT s_suppkey AS facility_id, s_name AS nombre,
       CASE s_suppkey % 12 WHEN 0 THEN 'I-1' WHEN 1 THEN 'I-2' WHEN 2 THEN 'I-3' WHEN 3 THEN 'I-4' WHEN 4 THEN 'II-1' WHEN 5 THEN 'II-2'
            WHEN 6 THEN 'II-E' WHEN 7 THEN 'III-1' WHEN 8 THEN 'ii-1' WHEN 9 THEN ' II-1 ' WHEN 10 THEN 'II_1' ELSE 'III-E' END AS categoria,
       CASE s_suppkey % 3 WHEN 0 THEN 'MINSA' WHEN 1 THEN 'ESSALUD' ELSE 'PRIVADO' END AS institucion,
       s_suppkey % 4 <> 0 AS activo, CAST(1 + s_suppkey % 19 AS BIGINT) AS capacidad, r_name AS departamento,
       -81e0 + CAST((s_suppkey * 6113) % 12000 AS DOUBLE) / 1000e0 AS lon, -18e0 + CAST((s_suppkey * 3571) % 17000 AS DOUBLE) / 1000e0 AS lat
FROM {{supplier}} {_PLACE.replace('{key}', 's')}""",
    "fx_matrix": """
WITH fx_m AS (
  SELECT o_custkey AS cp_id, l_suppkey AS facility_id, min(l_extendedprice) / 500e0 + CAST(((o_custkey * 7) % 5) * 35 AS DOUBLE) AS t
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey
)
SELECT 'drive' AS profile, cp_id, facility_id, CASE WHEN facility_id % 9 = 0 OR cp_id % 20 = 0 THEN NULL ELSE t END AS t_min FROM fx_m
UNION ALL
SELECT 'walk', cp_id, facility_id, CASE WHEN facility_id % 7 = 0 OR cp_id % 15 = 0 THEN NULL ELSE t * 10e0 + CAST((cp_id * 13 + facility_id * 29) % 97 AS DOUBLE) END FROM fx_m
UNION ALL
SELECT 'bike', cp_id, facility_id, CASE WHEN facility_id % 9 = 0 OR cp_id % 20 = 0 THEN NULL ELSE t * 3e0 + CAST((cp_id * 11 + facility_id * 17) % 31 AS DOUBLE) END FROM fx_m""",
    "fx_edges": """
WITH fx_n AS (SELECT p_partkey AS id, p_partkey % 20 AS x, (SELECT count(*) FROM {part}) AS c FROM {part})
SELECT id AS src, id + 1 AS dst, 60e0 AS travel_time FROM fx_n WHERE x < 19 AND id + 1 < c
UNION ALL SELECT id, id - 1, 90e0 FROM fx_n WHERE x > 0
UNION ALL SELECT id, id + 20, 60e0 FROM fx_n WHERE id + 20 < c
UNION ALL SELECT id, id - 20, 90e0 FROM fx_n WHERE id >= 20""",
    "fx_nodes": """
SELECT p_partkey AS node_id, -81e0 + CAST(p_partkey % 20 AS DOUBLE) * 0.6e0 AS x, -18e0 + CAST(floor(p_partkey / 20e0) AS DOUBLE) * 0.17e0 AS y FROM {part}""",
    "fx_polygon": """
SELECT n_name AS provincia, -81e0 + 0.25e0 * CAST(n_nationkey AS DOUBLE) AS x0, -75e0 + 0.25e0 * CAST(n_nationkey AS DOUBLE) AS x1, -18e0 AS y0, -2e0 AS y1 FROM {nation}""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture over the tables of sf_dir."""
    text = FIXTURES[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{(\w+)}", text))}
    return spark.sql(text, **tables)


def with_fixtures(body: str, *names: str) -> str:
    """An oracle text: the fixtures as common table expressions before the body, which is a SELECT or goes on with ', name AS (..) SELECT'."""
    parts = ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', FIXTURES[n])})" for n in names)
    return f"WITH {parts}{body if body.lstrip().startswith(',') else ' ' + body}"
