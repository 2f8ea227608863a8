"""A synthetic cadastre: true parcels, a survey, a distorted legacy map, points and the known answers.

Every table is plain SQL over a range of parcel numbers, so it is the same rows wherever and however
often it is built. Noise comes from parcel and vertex numbers and is uniform with the spread named.
Rings are four vertices in the columns x0, y0 to x3, y3, counter-clockwise from the south-west.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the scenario.
EAST, NORTH, WIDTH, HEIGHT, ROAD, ROWS, COLS = 500000, 3000000, 40, 30, 5, 5, 6
SHIFT, TURN, STRETCH, LEGACY_NOISE, SURVEY_NOISE, WARP = (1.2, -0.7), 0.8, 1.002, 0.15, 0.05, (0.3, 1.5)
SPLIT, CHILDREN, MERGED, MERGE_CHILD = "P-104", ("P-202", "P-203"), ("P-020", "P-021"), "P-230"
ATTRIBUTE, MOVED, GAP, OVERLAP, MISSING = "P-103", "P-015", "P-008", "P-001", "P-026"
V = range(4)
XY = ", ".join(f"x{v}, y{v}" for v in V)


def _unit(salt: int, v: int = 0) -> str:
    """A number from -0.5 to 0.5 of the parcel's number, a vertex and a salt."""
    return f"((pid * pid * 13 + pid * 7919 + {v * 10429 + salt * 3571}) % 1009 / 1008e0 - 0.5e0)"


def _noise(spread: float, salt: int, v: int) -> str:
    return f"{spread * math.sqrt(12):.12e} * {_unit(salt, v)}"


def _cross(v: int) -> str:
    w = (v + 1) % 4
    return f"(x{v} * y{w} - x{w} * y{v})"


AREA = f"abs({' + '.join(_cross(v) for v in V)}) / 2e0"


def _all(expr: str) -> str:
    """The expression of every vertex; {x}, {y} and {v} stand for its columns and number."""
    return ", ".join(expr.format(x=f"x{v}", y=f"y{v}", v=v) for v in V)


def _tables(rows: int, cols: int) -> dict[str, str]:
    """CTEs in order of use; coordinates are from the scenario's corner until the last."""
    grid = ", ".join(
        f"(pid - 1) % {cols} * {WIDTH + ROAD}e0 + {WIDTH * (v in (1, 2))} + {_unit(1, v)} AS x{v}, floor((pid - 1) / {cols}) * {HEIGHT + ROAD}e0 + {HEIGHT * (v > 1)} + {_unit(2, v)} AS y{v}" for v in V
    )
    c, s = STRETCH * math.cos(math.radians(TURN)), STRETCH * math.sin(math.radians(TURN))
    px, py = "({x} + " + f"{SHIFT[0]:.6e} - ox)", "({y} + " + f"({SHIFT[1]:.6e}) - oy)"
    turned = f"ox + {c:.17e} * {px} - {s:.17e} * {py} AS {{x}}, oy + {s:.17e} * {px} + {c:.17e} * {py} AS {{y}}"
    nx, ny = "(({x} - bx0) / (bx1 - bx0))", "(({y} - by0) / (by1 - by0))"
    amp = f"({WARP[0]:.3e} + {WARP[1] - WARP[0]:.3e} * ({nx} + 1 - {ny}) / 2)"
    warped = f"{{x}} + {amp} * sin({3 * math.pi:.17e} * {nx}) AS {{x}}, {{y}} + {amp} * cos({2.4 * math.pi:.17e} * {ny}) AS {{y}}"
    moves = ", ".join(
        f"x{v} + {_noise(LEGACY_NOISE, 3, v)} + CASE parcel_id WHEN '{MOVED}' THEN 4e0 WHEN '{OVERLAP}' THEN 5e0 WHEN '{GAP}' THEN {2 if v in (0, 3) else -2}e0 ELSE 0e0 END AS x{v}, "
        f"y{v} + {_noise(LEGACY_NOISE, 4, v)} + CASE parcel_id WHEN '{GAP}' THEN {2 if v < 2 else -2}e0 ELSE 0e0 END AS y{v}"
        for v in V
    )
    mid = "(least(x0, x3) + greatest(x1, x2)) / 2e0"
    low, high = "y0 + (mid - x0) / (x1 - x0) * (y1 - y0)", "y3 + (mid - x3) / (x2 - x3) * (y2 - y3)"
    attrs = "survey_no, owner_name, land_use"
    noisy = ", ".join(f"round({EAST} + x{v} + {_noise(SURVEY_NOISE, 5, v)}, 6) AS x{v}, round({NORTH} + y{v} + {_noise(SURVEY_NOISE, 6, v)}, 6) AS y{v}" for v in V)
    placed = ", ".join(f"round({EAST} + x{v}, 6) AS x{v}, round({NORTH} + y{v}, 6) AS y{v}" for v in V)
    number = "CASE pid WHEN 13 THEN 103 WHEN 14 THEN 104 ELSE pid END"
    name = "CASE WHEN num < 1000 THEN lpad(CAST(num AS STRING), 3, '0') ELSE CAST(num AS STRING) END"
    children = f"'{CHILDREN[0]}' AS parcel_id, 'SN-{CHILDREN[0][2:]}' AS survey_no", f"'{CHILDREN[1]}' AS parcel_id, 'SN-{CHILDREN[1][2:]}' AS survey_no"
    corner = " UNION ALL ".join(f"SELECT pid, parcel_id, {v} AS v, x{v} AS x, y{v} AS y, w.x{v} AS wx, w.y{v} AS wy FROM t JOIN w USING (pid, parcel_id) WHERE parcel_id <> '{MISSING}'".replace(f" x{v} AS x", f" t.x{v} AS x").replace(f" y{v} AS y", f" t.y{v} AS y") for v in V)
    gnss = " UNION ALL ".join(f"SELECT pid, parcel_id, {v} AS v, x{v} + {_noise(0.05, 7, v)} AS x, y{v} + {_noise(0.05, 8, v)} AS y FROM survey" for v in V)
    return {
        "n": f"SELECT pid, {number} AS num FROM {{ids}}",
        "t": f"SELECT pid, concat('P-', {name}) AS parcel_id, concat('SN-', num + 100) AS survey_no, concat('Owner_', pid) AS owner_name, CASE pid * 7919 % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'mixed' ELSE 'agricultural' END AS land_use, {grid} FROM n",
        "truth": f"SELECT pid, parcel_id, {attrs}, round({AREA}, 2) AS revenue_area, {placed} FROM t",
        "o": f"SELECT sum({' + '.join(f'(x{v} + x{(v + 1) % 4}) * {_cross(v)}' for v in V)}) / (6 * sum({AREA})) AS ox, sum({' + '.join(f'(y{v} + y{(v + 1) % 4}) * {_cross(v)}' for v in V)}) / (6 * sum({AREA})) AS oy FROM t",
        "a": f"SELECT pid, parcel_id, {attrs}, {AREA} AS area, {_all(turned)} FROM t CROSS JOIN o",
        "b": f"SELECT min(least({', '.join(f'x{v}' for v in V)})) AS bx0, max(greatest({', '.join(f'x{v}' for v in V)})) AS bx1, min(least({', '.join(f'y{v}' for v in V)})) AS by0, max(greatest({', '.join(f'y{v}' for v in V)})) AS by1 FROM a",
        "w": f"SELECT pid, parcel_id, {attrs}, area, {_all(warped)} FROM a CROSS JOIN b",
        "m": f"SELECT pid, parcel_id, {attrs}, area, {moves} FROM w WHERE parcel_id <> '{MISSING}'",
        "legacy": f"""SELECT pid, concat('L-', parcel_id) AS parcel_id, CASE WHEN parcel_id = '{ATTRIBUTE}' THEN 'SN-AMBIG' WHEN {_unit(9)} < -0.35e0 THEN concat(survey_no, '_X') ELSE survey_no END AS survey_no,
  CASE WHEN parcel_id <> '{ATTRIBUTE}' AND {_unit(10)} < -0.4e0 THEN 'UNKNOWN' ELSE owner_name END AS owner_name, land_use,
  round(area * CASE WHEN parcel_id = '{ATTRIBUTE}' THEN 1.19e0 WHEN {_unit(11)} < -0.25e0 THEN 1 + 0.6e0 * {_unit(12)} ELSE 1e0 END, 2) AS revenue_area, {placed} FROM m""",
        "h": f"SELECT *, {mid} AS mid FROM t WHERE parcel_id = '{SPLIT}'",
        "p": f"""SELECT pid, parcel_id, {attrs}, {XY} FROM t WHERE parcel_id NOT IN ('{SPLIT}', '{MERGED[0]}', '{MERGED[1]}')
  UNION ALL SELECT pid, {children[0]}, owner_name, land_use, x0, y0, mid, {low}, mid, {high}, x3, y3 FROM h
  UNION ALL SELECT pid, {children[1]}, owner_name, land_use, mid, {low}, x1, y1, x2, y2, mid, {high} FROM h
  UNION ALL SELECT pid, '{MERGE_CHILD}', 'SN-{MERGE_CHILD[2:]}', owner_name, land_use, {XY} FROM (SELECT *, row_number() OVER (ORDER BY {AREA} DESC, pid) AS r FROM t WHERE parcel_id IN ('{MERGED[0]}', '{MERGED[1]}')) q WHERE r = 1""",
        "survey": f"SELECT pid, concat('S-', substr(parcel_id, 3)) AS parcel_id, {attrs}, round({AREA}, 2) AS revenue_area, {noisy} FROM p",
        "correspondence": f"""SELECT pid, parcel_id AS legacy_id, CASE parcel_id WHEN '{SPLIT}' THEN 'SPLIT' WHEN '{MERGED[0]}' THEN 'MERGE' WHEN '{MERGED[1]}' THEN 'MERGE' WHEN '{MISSING}' THEN 'NO_MATCH' ELSE 'ONE_TO_ONE' END AS relation_type,
  CASE parcel_id WHEN '{SPLIT}' THEN 'S-{CHILDREN[0][2:]},S-{CHILDREN[1][2:]}' WHEN '{MERGED[0]}' THEN 'S-{MERGE_CHILD[2:]}' WHEN '{MERGED[1]}' THEN 'S-{MERGE_CHILD[2:]}' ELSE concat('S-', substr(parcel_id, 3)) END AS reference_ids FROM t""",
        "conflict": f"SELECT pid, parcel_id, CASE parcel_id WHEN '{ATTRIBUTE}' THEN 'CASE_B_ATTRIBUTE' WHEN '{MOVED}' THEN 'CASE_A_DISPLACEMENT' WHEN '{GAP}' THEN 'GAP' WHEN '{OVERLAP}' THEN 'OVERLAP' ELSE 'NO_MATCH' END AS conflict_type FROM t WHERE parcel_id IN ('{ATTRIBUTE}', '{MOVED}', '{GAP}', '{OVERLAP}', '{MISSING}')",
        "gnss": f"SELECT concat('GNSS-', parcel_id, '-', v) AS point_id, parcel_id, 0.05e0 AS uncertainty, round(x, 6) AS x, round(y, 6) AS y FROM ({gnss}) q",
        "corner": corner,
        "mid_point": "SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM corner",
        "control": f"SELECT concat('CP-', lpad(CAST(r AS STRING), 2, '0')) AS point_id, concat(CASE WHEN y >= my THEN 'N' ELSE 'S' END, CASE WHEN x >= mx THEN 'E' ELSE 'W' END) AS region, round({EAST} + wx, 6) AS sx, round({NORTH} + wy, 6) AS sy, round({EAST} + x, 6) AS tx, round({NORTH} + y, 6) AS ty FROM (SELECT *, row_number() OVER (ORDER BY (pid * 7919 + v * 10429) % 1009, pid, v) AS r FROM corner) q CROSS JOIN mid_point WHERE r <= 16",
    }


NAMES = ("truth", "survey", "legacy", "correspondence", "conflict", "gnss", "control")


def sql(name: str, ids: str, rows: int = ROWS, cols: int = COLS) -> str:
    tables = _tables(rows, cols)
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in tables.items()).replace("{ids}", ids)
    return f"WITH {ctes}\nSELECT * FROM {name}"


def scenario(spark: SparkSession, name: str, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """One of NAMES, for a grid of rows x cols parcels."""
    return spark.sql(sql(name, f"(SELECT id AS pid FROM range(1, {rows * cols + 1}))", rows, cols))


def oracle(name: str) -> str:
    return sql(name, f"(SELECT r AS pid FROM range(1, {ROWS * COLS + 1}) g(r))")
