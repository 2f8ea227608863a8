"""Parcel layers, points and logs derived from the driver's tables.

The definitions are plain SQL that Spark and other engines read alike (`//` is written {div}),
so a layer is the same rows wherever it is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LAYERS = {
    "source_parcel": f"""
SELECT concat('L-', k) AS parcel_id, k, x0 + dx AS xmin, y0 + dy AS ymin, x0 + dx + 40 AS xmax, y0 + dy + 30 AS ymax, survey_no, owner_name, land_use, revenue_area, CAST(0.25 AS DOUBLE) AS sigma
FROM (SELECT c_custkey AS k, 500000 + 41 * (c_custkey % 50) AS x0, 3000000 + 31 * (c_custkey {{div}} 50) AS y0,
  ((7 * c_custkey) % 17 - 8) / 16 + CASE WHEN c_custkey % 40 = 13 THEN 100000 ELSE 0 END AS dx, ((11 * c_custkey) % 13 - 6) / 16 AS dy,
  CASE WHEN c_custkey % 29 = 3 THEN 'SN-AMBIG' WHEN c_custkey % 23 = 5 THEN concat('SN-', c_custkey, '_X') ELSE concat('SN-', c_custkey) END AS survey_no,
  CASE WHEN c_custkey % 37 = 9 THEN 'UNKNOWN' ELSE c_name END AS owner_name, c_mktsegment AS land_use,
  CAST(CASE WHEN c_custkey % 31 = 4 THEN 1425 ELSE 1200 END AS DOUBLE) AS revenue_area FROM customer) s""",
    "target_parcel": """
SELECT concat('S-', k, tail) AS parcel_id, k, CAST(x0 + a AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, CAST(x0 + b AS DOUBLE) AS xmax, CAST(y0 + 30 AS DOUBLE) AS ymax,
  concat('SN-', k) AS survey_no, owner_name, land_use, CAST((b - a) * 30 AS DOUBLE) AS revenue_area, CAST(0.25 AS DOUBLE) AS sigma
FROM (
  SELECT c.*, p.tail, p.a, p.b, 500000 + 41 * (k % 50) AS x0, 3000000 + 31 * (k {div} 50) AS y0 FROM (
    SELECT c_custkey AS k, c_name AS owner_name, c_mktsegment AS land_use,
      CASE WHEN c_custkey % 61 = 20 AND c_custkey % 50 < 49 AND c_custkey % 40 NOT IN (12, 13) AND c_custkey < top THEN 'm'
           WHEN (c_custkey - 1) % 61 = 20 AND (c_custkey - 1) % 50 < 49 AND (c_custkey - 1) % 40 NOT IN (12, 13) AND c_custkey > 1 THEN 'gone'
           WHEN c_custkey % 53 = 7 THEN 's' WHEN c_custkey % 40 = 13 THEN 'gone' ELSE 'one' END AS kind
    FROM customer, (SELECT max(c_custkey) AS top FROM customer) t) c
  JOIN (SELECT 'one' AS kind, '' AS tail, 0 AS a, 40 AS b UNION ALL SELECT 's', '-a', 0, 20 UNION ALL SELECT 's', '-b', 20, 40 UNION ALL SELECT 'm', '-m', 0, 81) p ON p.kind = c.kind) t""",
    "survey_point": """
SELECT concat('G-', o) AS point_id, 500000 + 41 * (k % 50) + CASE WHEN o % 4 IN (1, 2) THEN 40 ELSE 0 END + ((5 * o) % 9 - 4) / 16 AS x,
  CAST(3000000 + 31 * (k {div} 50) + CASE WHEN o % 4 IN (2, 3) THEN 30 ELSE 0 END AS DOUBLE) AS y
FROM (SELECT o_orderkey AS o, o_custkey AS k FROM orders) q""",
    "observation": """
SELECT concat('O-', k) AS obs_id, CASE k % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'WALL' WHEN 2 THEN 'BUILDING_EDGE' WHEN 3 THEN 'FENCE' ELSE 'ROAD_EDGE' END AS type,
  CAST(500005 + 41 * (k % 50) AS DOUBLE) AS xmin, CAST(3000005 + 31 * (k {div} 50) AS DOUBLE) AS ymin, 500009 + 41 * (k % 50) + p_size / 2 AS xmax, CAST(3000013 + 31 * (k {div} 50) AS DOUBLE) AS ymax,
  CAST(0.75 AS DOUBLE) + p_size / 256 AS confidence
FROM (SELECT p_partkey AS k, p_size FROM part) q""",
    "parcel_version": """
SELECT concat('P-', o_custkey) AS parcel_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
  CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'OBSERVED' ELSE 'CANDIDATE' END AS status,
  concat('D', substr(o_orderpriority, 1, 1)) AS dataset_id, o_totalprice AS area, o_orderdate AS created_at, o_orderkey AS row_id FROM orders""",
    "control_point": """
SELECT k AS point_id, CAST(41 * (k % 50) AS DOUBLE) AS sx, CAST(31 * (k {div} 50) AS DOUBLE) AS sy,
  CAST(1.0078125 AS DOUBLE) * (41 * (k % 50)) - CAST(0.015625 AS DOUBLE) * (31 * (k {div} 50)) + CAST(1.25 AS DOUBLE) + ((3 * k) % 7 - 3) / 64 AS tx,
  CAST(0.015625 AS DOUBLE) * (41 * (k % 50)) + CAST(1.0078125 AS DOUBLE) * (31 * (k {div} 50)) - CAST(0.75 AS DOUBLE) + ((5 * k) % 11 - 5) / 64 AS ty
FROM (SELECT s_suppkey AS k FROM supplier) q""",
    "control_point_sheared": "SELECT point_id, sx, sy, tx + CAST(0.0625 AS DOUBLE) * sy AS tx, ty FROM ({control_point}) c",
    "control_point_bent": "SELECT point_id, sx, sy, tx + CAST(4 AS DOUBLE) * sin(sx / 300) AS tx, ty FROM ({control_point}) c",
    "control_point_outliers": "SELECT point_id, sx, sy, tx + CASE WHEN point_id % 9 = 4 THEN 25 + point_id % 7 ELSE 0 END AS tx, ty FROM ({control_point}) c",
    "scored_label": """
SELECT event_id, least(value / 512, CAST(1 AS DOUBLE)) AS p, CASE WHEN event_id % 7 < 3 THEN 1 ELSE 0 END AS y FROM events WHERE value IS NOT NULL""",
    "source_ring": """
SELECT concat('L-', k) AS parcel_id, k,
  500000 + 41 * (k % 50) + 0 + ((7 * k + 3 * 0) % 17 - 8) / 16 + 0.03125e0 AS x0, 3000000 + 31 * (k {div} 50) + 0 + ((11 * k + 5 * 0) % 13 - 6) / 16 + 0.03125e0 AS y0,
  500000 + 41 * (k % 50) + 40 + ((7 * k + 3 * 1) % 17 - 8) / 16 + 0.03125e0 AS x1, 3000000 + 31 * (k {div} 50) + 0 + ((11 * k + 5 * 1) % 13 - 6) / 16 + 0.03125e0 AS y1,
  500000 + 41 * (k % 50) + 40 + ((7 * k + 3 * 2) % 17 - 8) / 16 + 0.03125e0 AS x2, 3000000 + 31 * (k {div} 50) + 30 + ((11 * k + 5 * 2) % 13 - 6) / 16 + 0.03125e0 AS y2,
  500000 + 41 * (k % 50) + 0 + ((7 * k + 3 * 3) % 17 - 8) / 16 + 0.03125e0 AS x3, 3000000 + 31 * (k {div} 50) + 30 + ((11 * k + 5 * 3) % 13 - 6) / 16 + 0.03125e0 AS y3
FROM (SELECT c_custkey AS k FROM customer) q""",
    "target_ring": """
SELECT concat('S-', k) AS parcel_id, k,
  500000 + 41 * (k % 50) + 0 + ((5 * k + 7 * 0) % 9 - 4) / 16 AS x0, 3000000 + 31 * (k {div} 50) + 0 + ((3 * k + 4 * 0) % 7 - 3) / 16 AS y0,
  500000 + 41 * (k % 50) + 40 + ((5 * k + 7 * 1) % 9 - 4) / 16 AS x1, 3000000 + 31 * (k {div} 50) + 0 + ((3 * k + 4 * 1) % 7 - 3) / 16 AS y1,
  500000 + 41 * (k % 50) + 40 + ((5 * k + 7 * 2) % 9 - 4) / 16 AS x2, 3000000 + 31 * (k {div} 50) + 30 + ((3 * k + 4 * 2) % 7 - 3) / 16 AS y2,
  500000 + 41 * (k % 50) + 0 + ((5 * k + 7 * 3) % 9 - 4) / 16 AS x3, 3000000 + 31 * (k {div} 50) + 30 + ((3 * k + 4 * 3) % 7 - 3) / 16 AS y3
FROM (SELECT c_custkey AS k FROM customer) q""",
    "half_parcel": """
SELECT concat('H-', k) AS parcel_id, k, CAST(500000 + 50 * (k {div} 2 % 40) + 20 * (k % 2) AS DOUBLE) AS xmin, CAST(3000000 + 40 * (k {div} 80) AS DOUBLE) AS ymin,
  CAST(500020 + 50 * (k {div} 2 % 40) + 20 * (k % 2) AS DOUBLE) AS xmax, CAST(3000030 + 40 * (k {div} 80) AS DOUBLE) AS ymax,
  concat('SN-', k {div} 2) AS survey_no, 'owner' AS owner_name, 'residential' AS land_use, CAST(600 AS DOUBLE) AS revenue_area, CAST(0.25 AS DOUBLE) AS sigma FROM (SELECT c_custkey AS k FROM customer) q""",
    "joint_parcel": """
SELECT concat('J-', j) AS parcel_id, j AS k, CAST(500000 + 50 * (j % 40) AS DOUBLE) AS xmin, CAST(3000000 + 40 * (j {div} 40) AS DOUBLE) AS ymin,
  CAST(500040 + 50 * (j % 40) AS DOUBLE) AS xmax, CAST(3000030 + 40 * (j {div} 40) AS DOUBLE) AS ymax,
  concat('SN-', j) AS survey_no, 'owner' AS owner_name, 'residential' AS land_use, CAST(1200 AS DOUBLE) AS revenue_area, CAST(0.25 AS DOUBLE) AS sigma FROM (SELECT DISTINCT c_custkey {div} 2 AS j FROM customer) q""",
    "crowded_parcel": """
SELECT concat('C-', k) AS parcel_id, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, CAST(x0 + 40 AS DOUBLE) AS xmax, CAST(y0 + 30 AS DOUBLE) AS ymax
FROM (SELECT c_custkey AS k, 500000 + 41 * (c_custkey % 50) + CASE WHEN c_custkey % 5 = 2 THEN 4 ELSE 0 END AS x0, 3000000 + 31 * (c_custkey {div} 50) AS y0 FROM customer) q""",
    "slanted_source": """
SELECT concat('L-', k, tail) AS parcel_id, k, kind, CAST(x0 + a AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, CAST(x0 + b AS DOUBLE) AS xmax, CAST(y0 + 30 AS DOUBLE) AS ymax,
  concat('SN-', k) AS survey_no, 'owner' AS owner_name, 'residential' AS land_use, CAST((b - a) * 30 AS DOUBLE) AS revenue_area, CAST(0.25 AS DOUBLE) AS sigma
FROM (SELECT c_custkey AS k, c_custkey % 8 AS kind, 500000 + 70 * (c_custkey % 50) AS x0, 3000000 + 40 * (c_custkey {div} 50) AS y0 FROM customer) c
JOIN (SELECT 0 AS pk, '' AS tail, 0 AS a, 40 AS b UNION ALL SELECT 1, '', 0, 40 UNION ALL SELECT 2, '', 0, 40 UNION ALL SELECT 3, '', 0, 40 UNION ALL SELECT 4, '', 0, 40 UNION ALL SELECT 5, '', 0, 40 UNION ALL SELECT 6, '', 0, 40
  UNION ALL SELECT 7, '-a', 0, 21 UNION ALL SELECT 7, '-b', 20, 40) q ON pk = kind""",
    "slanted_target": """
SELECT concat('S-', k, tail) AS parcel_id, k, CAST(x0 + a AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, CAST(x0 + b AS DOUBLE) AS xmax, CAST(y0 + 30 AS DOUBLE) AS ymax,
  concat('SN-', k) AS survey_no, 'owner' AS owner_name, 'residential' AS land_use, CAST((b - a) * 30 AS DOUBLE) AS revenue_area, CAST(0.25 AS DOUBLE) AS sigma
FROM (SELECT c_custkey AS k, c_custkey % 8 AS kind, 500000 + 70 * (c_custkey % 50) AS x0, 3000000 + 40 * (c_custkey {div} 50) AS y0 FROM customer) c
JOIN (SELECT 0 AS pk, '-a' AS tail, 0 AS a, 20 AS b UNION ALL SELECT 0, '-b', 20, 40 UNION ALL SELECT 1, '-a', 0, 21 UNION ALL SELECT 1, '-b', 19, 40 UNION ALL SELECT 2, '-a', 0, 17.5e0 UNION ALL SELECT 2, '-b', 16, 33.5e0
  UNION ALL SELECT 3, '-a', 0, 14 UNION ALL SELECT 3, '-b', 13, 27 UNION ALL SELECT 3, '-c', 26, 40 UNION ALL SELECT 4, '', 1, 41 UNION ALL SELECT 6, '-a', 0, 26 UNION ALL SELECT 6, '-b', 14, 40 UNION ALL SELECT 7, '', 0, 40) q ON pk = kind""",
    "raw_ring": """
SELECT concat('W-', k) AS parcel_id, k, k % 5 AS kind, CAST(500000 + 70 * (k % 50) AS DOUBLE) AS x, CAST(3000000 + 40 * (k {div} 50) AS DOUBLE) AS y, CAST(8 + k % 11 AS DOUBLE) AS w, CAST(6 + k % 7 AS DOUBLE) AS h FROM (SELECT c_custkey AS k FROM customer) q""",
    "district_or_parcel": """
SELECT concat('N-', c_nationkey) AS id, CAST(min(500000 + 41 * (c_custkey % 50)) AS DOUBLE) AS xmin, CAST(min(3000000 + 31 * (c_custkey {div} 50)) AS DOUBLE) AS ymin,
  CAST(max(500040 + 41 * (c_custkey % 50)) AS DOUBLE) AS xmax, CAST(max(3000030 + 31 * (c_custkey {div} 50)) AS DOUBLE) AS ymax FROM customer GROUP BY c_nationkey
UNION ALL
SELECT concat('L-', k), CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE), CAST(x0 + 40 AS DOUBLE), CAST(y0 + 30 AS DOUBLE) FROM (SELECT c_custkey AS k, 500000 + 41 * (c_custkey % 50) AS x0, 3000000 + 31 * (c_custkey {div} 50) AS y0 FROM customer) q""",
    "shed_in_one_block": """
SELECT concat('B-', o) AS id, 500100 + CAST((7 * o) % 1024 AS DOUBLE) / 16 AS xmin, 3000040 + CAST((11 * o) % 512 AS DOUBLE) / 16 AS ymin,
  500100 + CAST((7 * o) % 1024 + 4 AS DOUBLE) / 16 AS xmax, 3000040 + CAST((11 * o) % 512 + 4 AS DOUBLE) / 16 AS ymax FROM (SELECT o_orderkey AS o FROM orders) q""",
    "evidence_request": """
SELECT concat('E-', k) AS dataset_id, k % 2 = 0 AS with_height, CAST(500000 + 41 * (5 * k % 50) AS DOUBLE) AS xmin, CAST(3000000 + 31 * (k {div} 10) AS DOUBLE) AS ymin,
  CAST(500120 + 41 * (5 * k % 50) AS DOUBLE) AS xmax, CAST(3000080 + 31 * (k {div} 10) AS DOUBLE) AS ymax FROM (SELECT s_suppkey AS k FROM supplier) q""",
    "evidence_asset": """
SELECT concat('A-', s_suppkey) AS asset_id, concat('E-', s_suppkey {div} 2) AS dataset_id, CASE s_suppkey % 3 WHEN 0 THEN 'ORI' WHEN 1 THEN 'DSM' ELSE 'DTM' END AS type, concat('tiles/', s_name, '.tif') AS path, s_suppkey AS row_id FROM supplier""",
    "extracted_feature": """
SELECT concat('A-', 2 * (p_partkey % 40)) AS asset_id, concat('X-', p_partkey) AS obs_id, CASE p_partkey % 3 WHEN 0 THEN 'WALL' ELSE 'BUILDING' END AS type, CAST(0.5 AS DOUBLE) + p_size / 256 AS confidence,
  CAST(0.25 AS DOUBLE) AS uncertainty, CAST(3 + p_size % 9 AS DOUBLE) AS height, CAST(500000 + 41 * (p_partkey % 50) AS DOUBLE) AS x, CAST(3000000 + 31 * (p_partkey {div} 50) AS DOUBLE) AS y, CAST(4 + p_size % 5 AS DOUBLE) AS side FROM part""",
    "parcel_box_version": """
SELECT concat('L-', k) AS parcel_id, version, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, x0 + w AS xmax, y0 + h AS ymax
FROM (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, 500000 + 41 * (o_custkey % 50) AS x0, 3000000 + 31 * (o_custkey {div} 50) AS y0,
  CAST(CASE WHEN o_orderkey % 7 = 3 THEN 8 WHEN o_orderkey % 7 = 4 THEN 9 ELSE 32 + o_orderkey % 9 END AS DOUBLE) AS w, CAST(CASE WHEN o_orderkey % 11 = 5 THEN 1.5e0 ELSE 12 + o_orderkey % 19 END AS DOUBLE) AS h FROM orders) q""",
    "parcel_edition": """
SELECT concat('P-', k) AS parcel_id, k, version, status, concat('D', k % 3) AS dataset_1, concat('D', o % 4) AS dataset_2, concat('U-', o % 5) AS land_use, concat('H-', o % 97) AS holder, concat('R-', o % 11) AS run_id,
  CAST(500000 + 41 * (k % 50) AS DOUBLE) AS x, CAST(3000000 + 31 * (k {div} 50) AS DOUBLE) AS y, CAST(30 + o % 11 AS DOUBLE) AS w, CAST(20 + o % 7 AS DOUBLE) AS h
FROM (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'OBSERVED' ELSE 'CANDIDATE' END AS status FROM orders) q""",
    "version_request": """
SELECT event_id AS request_id, concat('P-', 10 * user_id + event_id % 12) AS parcel_id, CASE event_type WHEN 'view' THEN 'CANDIDATE' WHEN 'click' THEN 'VALIDATED' WHEN 'error' THEN 'REJECTED' WHEN 'purchase' THEN 'APPROVED' ELSE 'PUBLISHED' END AS status,
  CASE event_type WHEN 'view' THEN 'EDIT' WHEN 'click' THEN 'APPROVE' WHEN 'error' THEN 'REJECT' WHEN 'purchase' THEN 'FIELD_VERIFY' ELSE 'COMMENT' END AS action,
  CASE event_id % 3 WHEN 0 THEN 'AI_SERVICE' WHEN 1 THEN 'REVIEWER' ELSE 'SYSTEM' END AS role, concat('R-', event_id % 11) AS run_id,
  CASE WHEN event_id % 5 < 3 THEN concat('U-', event_id) END AS land_use, CASE WHEN event_id % 4 = 1 THEN concat('H-', event_id) END AS holder,
  CASE WHEN event_id % 2 = 0 THEN 4 + event_id % 7 END AS arm, 500000 + event_id % 100 AS x, 3000000 + event_id % 90 AS y FROM events""",
    "pipeline_run": """
SELECT concat('R-', o_orderkey) AS run_id, concat('D', substr(o_orderpriority, 1, 1)) AS source_dataset, concat('D', CAST(o_custkey % 3 AS VARCHAR(9))) AS reference_dataset,
  CASE o_orderstatus WHEN 'F' THEN 'PASSED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status, o_totalprice AS rmse, o_orderdate AS created_at, o_orderkey AS row_id FROM orders""",
    "asset": """
SELECT concat('A-', s_suppkey) AS asset_id, CASE s_suppkey % 3 WHEN 0 THEN 'ORI' WHEN 1 THEN 'DSM' ELSE 'DTM' END AS type, concat('tiles/', s_name, '.tif') AS path, s_suppkey AS row_id FROM supplier""",
    "truth_box": """
SELECT concat('T-', k) AS parcel_id, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin, CAST(x0 + 40 AS DOUBLE) AS xmax, CAST(y0 + 30 AS DOUBLE) AS ymax
FROM (SELECT c_custkey AS k, 500000 + 41 * (c_custkey % 50) AS x0, 3000000 + 31 * (c_custkey {div} 50) AS y0 FROM customer) q""",
    "legacy_box": """
SELECT concat('L-', k) AS parcel_id, x0 AS xmin, y0 AS ymin, x0 + 40 AS xmax, y0 + 30 AS ymax
FROM (SELECT c_custkey AS k, 500001 + 41 * (c_custkey % 50) + ((7 * c_custkey) % 17 - 8) / 16 AS x0, 2999999 + 31 * (c_custkey {div} 50) + ((11 * c_custkey) % 13 - 6) / 16 AS y0 FROM customer) q""",
}
TABLES = ("customer", "orders", "part", "supplier", "events")


def _text(name: str) -> str:
    return LAYERS[name].replace("{control_point}", LAYERS["control_point"])


def sql(name: str, div: str) -> str:
    return _text(name).replace("{div}", div)


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived layer; its tables are bound by name for this plan only."""
    bound = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in _text(name)}
    text = sql(name, "div")
    for t in bound:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **bound)
