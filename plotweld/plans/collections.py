"""Registered feature collections as a map client gets them: degrees, newest versions, merged properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import projection
from ..operators import conflicts, features, registration, versions
from ..operators.corners import box_ring
from .polygons import CROWD
from .queries import FIT, LATEST, Plan, query
from .records import CASES, Desk

NEWEST = 200


def _degrees(x: str, y: str) -> str:
    lon, lat = projection.to_wgs84(x, y)
    at = lambda e: f"CAST(CAST({e} AS DECIMAL(18, 7)) AS VARCHAR)"
    return f"'[' || {at(lon)} || ',' || {at(lat)} || ']'"


def _box(x0: str = "xmin", y0: str = "ymin", x1: str = "xmax", y1: str = "ymax") -> str:
    return "'{\"type\":\"Polygon\",\"coordinates\":[[' || " + " || ',' || ".join(_degrees(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))) + " || ']]}'"


def _boxed(rows: DataFrame, *keep: str) -> DataFrame:
    return features.in_degrees(rows.withColumn("ring", box_ring())).select(*keep, features.geometry(F.col("ring"), "Polygon").alias("geometry"))


_VERSIONED = f"""SELECT l.parcel_id, l.version, l.status, s.* EXCLUDE (parcel_id), s.k % 7 = 0 AS disputed FROM (SELECT * FROM ({LATEST} log WHERE dataset_id = 'D1') WHERE n = 1) l JOIN src s ON concat('P-', s.k) = l.parcel_id"""


@query(f"""SELECT parcel_id, {_box()} AS geometry, '{{"land_use":"' || land_use || '","parcel_id":"' || parcel_id || '","status":"' || CASE WHEN disputed THEN 'DISPUTED' ELSE status END || '","version":' || version || '}}' AS properties FROM ({_VERSIONED}) q""")
def parcels_geojson(p: Plan) -> DataFrame:
    """The newest version of every parcel of a dataset; attributes of the version replace its own properties of the same name."""
    newest = versions.latest_in_dataset(p.layer("parcel_version"), "D1").select("parcel_id", "version", "status")
    shapes = p.layer("source_parcel").drop("parcel_id")
    rows = newest.join(shapes, F.col("parcel_id") == F.concat(F.lit("P-"), F.col("k").cast("string")))
    attributes = F.to_json(F.struct("land_use", F.when(F.col("k") % 7 == 0, "DISPUTED").alias("status")))
    extra = F.from_json(attributes, "map<string,string>")
    return _boxed(rows.withColumn("properties", features.properties(extra, parcel_id=F.col("parcel_id"), version=F.col("version"), status=F.col("status"))), "parcel_id", "properties")


@query(f"""SELECT obs_id, {_box()} AS geometry, '{{"confidence":' || CAST(CAST(confidence AS DECIMAL(9, 6)) AS VARCHAR) || ',"id":"' || obs_id || '","type":"' || type || '","uncertainty_m":' || CAST(CAST(2 * (1 - confidence) AS DECIMAL(9, 6)) AS VARCHAR) || '}}' AS properties FROM obs""")
def observations_geojson(p: Plan) -> DataFrame:
    own = features.properties(id=F.col("obs_id"), type=F.col("type"), confidence=F.col("confidence").cast("decimal(9,6)"), uncertainty_m=(2 * (1 - F.col("confidence"))).cast("decimal(9,6)"))
    return _boxed(p.layer("observation").withColumn("properties", own), "obs_id", "properties")


_SPOT = _degrees("x", "y")


@query(f"""SELECT point_id, '{{"type":"Point","coordinates":' || {_SPOT} || '}}' AS geometry, '{{"id":"' || point_id || '","point_type":"' || CASE WHEN o % 3 = 0 THEN 'monument' ELSE 'GNSS' END || CASE WHEN o % 3 <> 2 THEN '","station":"ST-' || (o % 10) ELSE '' END || '"}}' AS properties FROM (SELECT *, CAST(substr(point_id, 3) AS BIGINT) AS o FROM pts) q""")
def survey_points_geojson(p: Plan) -> DataFrame:
    """Points with the properties kept as JSON beside them; those replace the point's own."""
    o = F.substring("point_id", 3, 20).cast("bigint")
    kept = F.when(o % 3 != 2, F.to_json(F.struct(F.concat(F.lit("ST-"), (o % 10).cast("string")).alias("station"), F.when(o % 3 == 0, "monument").alias("point_type"))))
    rows = p.layer("survey_point").withColumns({"ring": F.array(F.struct("x", "y")), "properties": features.properties(F.from_json(kept, "map<string,string>"), id=F.col("point_id"), point_type=F.lit("GNSS"))})
    return features.in_degrees(rows).select("point_id", features.geometry(F.col("ring"), "Point").alias("geometry"), "properties")


_MID = _degrees("(xmin + xmax) / 2", "(ymin + ymax) / 2") + " || ',' || " + _degrees("(tx0 + tx1) / 2", "(ty0 + ty1) / 2")


@query(f"""SELECT match_id, target, '{{"type":"LineString","coordinates":[' || {_MID} || ']}}' AS geometry, '{{"match_id":"' || match_id || '","relation":"' || relation || '","source":"' || source_id || '","target":"' || target || '"}}' AS properties FROM (
  SELECT m.match_id, m.relation, m.source_id, m.target, s.xmin, s.ymin, s.xmax, s.ymax, t.xmin AS tx0, t.ymin AS ty0, t.xmax AS tx1, t.ymax AS ty1 FROM (SELECT match_id, relation, source_id, unnest(targets) AS target FROM (SELECT * FROM mt ORDER BY match_id DESC LIMIT {NEWEST}) n) m JOIN src s ON s.parcel_id = m.source_id JOIN tgt t ON t.parcel_id = m.target) q""", CASES)
def matches_geojson(p: Plan) -> DataFrame:
    """Lines from the source's middle to each target's, of the newest matches."""
    newest = features.newest(Desk(p).matches, NEWEST, F.col("match_id").desc()).select("match_id", "relation", "source_id", F.explode("targets").alias("target"))
    middle = lambda layer, name, at: p.layer(layer).select(F.col("parcel_id").alias(name), F.struct(*(c.alias(n) for c, n in zip(g.centroid(g.box()), "xy", strict=True))).alias(at))
    rows = newest.join(middle("source_parcel", "source_id", "a"), "source_id").join(middle("target_parcel", "target", "b"), "target").withColumn("ring", F.array("a", "b"))
    own = features.properties(match_id=F.col("match_id"), source=F.col("source_id"), target=F.col("target"), relation=F.col("relation"))
    return features.in_degrees(rows).select("match_id", "target", features.geometry(F.col("ring"), "LineString").alias("geometry"), own.alias("properties"))


_COMMON = f"SELECT a.parcel_id AS a, b.parcel_id AS b, greatest(a.xmin, b.xmin) AS xmin, greatest(a.ymin, b.ymin) AS ymin, least(a.xmax, b.xmax) AS xmax, least(a.ymax, b.ymax) AS ymax FROM cr a JOIN cr b ON a.parcel_id < b.parcel_id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax"


@query(f"""SELECT id, parcel_id, {_box()} AS geometry, '{{"conflict_id":"' || id || '"' || COALESCE(',"parcel_id":"' || parcel_id || '"', '') || ',"type":"' || kind || '"}}' AS properties FROM (
  SELECT 'OV-' || a || '-' || b AS id, NULL AS parcel_id, 'PARCEL_OVERLAP' AS kind, xmin, ymin, xmax, ymax FROM ({_COMMON}) o WHERE (xmax - xmin) * (ymax - ymin) / 1200 >= 0.05
  UNION ALL SELECT c.conflict_id, c.id, c.conflict_type, l.xmin, l.ymin, l.xmax, l.ymax FROM (SELECT conflict_id, conflict_type, unnest(parcel_ids) AS id FROM cf) c JOIN (SELECT parcel_id, xmin, ymin, xmax, ymax FROM src UNION ALL SELECT parcel_id, xmin, ymin, xmax, ymax FROM tgt) l ON l.parcel_id = c.id) q""", CASES + CROWD)
def conflicts_geojson(p: Plan) -> DataFrame:
    """Conflicts with a geometry of their own, such as overlaps, show it; the others a feature for each parcel that they name."""
    found = conflicts_of(p)
    cols = ("xmin", "ymin", "xmax", "ymax")
    shapes = p.layer("source_parcel").select("parcel_id", *cols).unionByName(p.layer("target_parcel").select("parcel_id", *cols))
    named = Desk(p).conflicts.select(F.col("conflict_id").alias("id"), F.explode("parcel_ids").alias("parcel_id"), F.col("conflict_type").alias("kind")).join(shapes, "parcel_id")
    rows = found.unionByName(named)
    whole, part = (features.properties(conflict_id=F.col("id"), type=F.col("kind"), **more) for more in ({}, {"parcel_id": F.col("parcel_id")}))
    return _boxed(rows.withColumn("properties", F.when(F.col("parcel_id").isNull(), whole).otherwise(part)), "id", "parcel_id", "properties")


def conflicts_of(p: Plan) -> DataFrame:
    """Overlaps of a layer as conflicts with the common box as their geometry."""
    i = g.intersection(g.box("a_"), g.box("b_"))
    return conflicts.overlaps(p.layer("crowded_parcel")).select(F.concat_ws("-", F.lit("OV"), "a_parcel_id", "b_parcel_id").alias("id"), F.lit(None).cast("string").alias("parcel_id"), F.lit("PARCEL_OVERLAP").alias("kind"), *(c.alias(n) for c, n in zip(i, ("xmin", "ymin", "xmax", "ymax"), strict=True)))


_CELL = _box("500000 + x0 + (x1 - x0) * col / 3", "3000000 + y0 + (y1 - y0) * row / 3", "500000 + x0 + (x1 - x0) * (col + 1) / 3", "3000000 + y0 + (y1 - y0) * (row + 1) / 3")


@query(f"""SELECT row, col, {_CELL} AS geometry, '{{"n":' || n || ',"p95":' || CAST(CAST(p95 AS DECIMAL(9, 5)) AS VARCHAR) || '}}' AS properties FROM (SELECT row, col, count(*) AS n, quantile_cont(r, 0.95) AS p95, min(x0) AS x0, min(x1) AS x1, min(y0) AS y0, min(y1) AS y1 FROM reg GROUP BY 1, 2) q, (SELECT 1) one""".replace("FROM reg GROUP", "FROM (SELECT reg.row, reg.col, reg.r, ext.* FROM reg, ext) g GROUP"), FIT)
def heatmap_geojson(p: Plan) -> DataFrame:
    """The heat map's cells that hold points."""
    points = p.layer("control_point")
    cells = registration.heatmap_cells(registration.with_region(registration.with_residual(registration.apply_affine(points, registration.affine(points)))))
    moved = cells.withColumns({c: F.col(c) + (500000.0 if c[0] == "x" else 3000000.0) for c in ("xmin", "ymin", "xmax", "ymax")})
    return _boxed(moved.withColumn("properties", features.properties(n=F.col("n"), p95=F.col("p95").cast("decimal(9,5)"))), "row", "col", "properties")
