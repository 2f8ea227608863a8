"""Registered queries on parcels of any shape: decisions, merges, support, valid rings, insets.

The parcels of the decisions are slanted boxes: every ring is a box whose x grows by a quarter of the height above its base.
A slant keeps areas, so the SQL measures upright boxes, adds up unions from sorted intervals, and shares no method with the
rings. Shapes that are not convex are checked by counting unit cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rings
from ..operators import conflate
from ..operators.lineage import cut
from ..operators.spatial_join import distance_join, prefixed
from ..sources import fixtures
from .polygons import RINGS, ring_layer, with_ring_features
from .queries import Plan, query

SLANT = 0.25


def slanted(p: Plan, name: str) -> DataFrame:
    """A layer of upright boxes as slanted rings, with the boxes of the rings; dealt out by id."""
    b = g.box()
    lean = (b[3] - b[1]) * SLANT
    layer = p.layer(name)
    rows = layer.repartition(layer.columns[0]).withColumn("ring", rings.ring((b[0], b[1]), (b[2], b[1]), (b[2] + lean, b[3]), (b[0] + lean, b[3])))
    return rows.withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), rings.bounds(F.col("ring")), strict=True)))


def containment_probability(pairs: DataFrame) -> DataFrame:
    """A score that also counts how much of the target lies in the source, so that children of a split score well."""
    share = g.safe_ratio(F.col("common"), F.col("t_area"))
    rows = pairs.withColumns({"attribute_similarity": g.attribute_similarity("s_", "t_"), "identity": g.identity(F.col("s_survey_no"), F.col("t_survey_no"))})
    return rows.withColumn("p", F.round(0.4 * F.col("iou") + 0.4 * share + 0.1 * F.col("attribute_similarity") + 0.1 * F.col("identity"), 4))


def _decided(p: Plan) -> DataFrame:
    sources, targets = slanted(p, "slanted_source"), slanted(p, "slanted_target")
    pairs = rings.where(distance_join(prefixed(sources, "s_"), prefixed(targets, "t_"), "s_", "t_"), rings.meets(F.col("s_ring"), F.col("t_ring")))
    return conflate.decide(sources, conflate.with_own_evidence(containment_probability(with_ring_features(pairs))), conflate.RINGS)


DECIDED = f""",
sa AS ({fixtures.sql("slanted_source", "//")}), sb AS ({fixtures.sql("slanted_target", "//")}),
pr0 AS (SELECT s.parcel_id AS s, t.parcel_id AS t, s.xmin AS s0, s.xmax AS s1, t.xmin AS t0, t.xmax AS t1, greatest(0, least(s.xmax, t.xmax) - greatest(s.xmin, t.xmin)) AS com, s.xmax - s.xmin AS sw, t.xmax - t.xmin AS tw FROM sa s JOIN sb t ON s.ymin = t.ymin AND s.xmin <= t.xmax AND t.xmin <= s.xmax),
pr AS (SELECT *, com / (sw + tw - com) AS iou, abs(s0 + s1 - t0 - t1) / 2 AS cd, round(0.4::DOUBLE * (com / (sw + tw - com)) + 0.4::DOUBLE * (com / tw) + 0.1::DOUBLE * ((3 + 1 - abs(sw - tw) / greatest(sw, tw)) / 4) + 0.1::DOUBLE, 4) AS p FROM pr0),
rk AS (SELECT *, row_number() OVER w AS r, COALESCE(lead(p) OVER w, 0) AS second FROM pr WINDOW w AS (PARTITION BY s ORDER BY p DESC, t)),
hi AS (SELECT * FROM rk WHERE r <= 4 AND p >= 0.6),
un AS (SELECT s, sum(greatest(0, b - greatest(a, COALESCE(e, a)))) AS cover FROM (SELECT s, greatest(s0, t0) AS a, least(s1, t1) AS b, max(least(s1, t1)) OVER (PARTITION BY s ORDER BY greatest(s0, t0), t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM hi) q GROUP BY 1),
ov AS (SELECT a.s, max(greatest(0, least(a.t1, b.t1) - greatest(a.t0, b.t0)) / least(a.tw, b.tw)) AS worst FROM hi a JOIN hi b ON a.s = b.s AND a.r < b.r GROUP BY 1),
hh AS (SELECT s, count(*) AS n, list(t ORDER BY r) AS ids, avg(p) AS mean_p, bool_and(com / tw >= 0.5) AS child, abs(1 - sum(tw) / min(sw)) AS off FROM hi GROUP BY 1),
dd AS (SELECT sa.parcel_id AS source_id, rk.*, ids, mean_p, COALESCE(hh.n, 0) >= 2 AND NOT (p >= 0.7 AND p - second >= 0.08::DOUBLE) AS contested, child AND cover / sw >= 0.85 AND worst <= 0.1 AND off <= 0.15 AS split, iou >= 0.7 AND cd <= 5 AND abs(sw - tw) / greatest(sw, tw) < 0.25 AS adj
  FROM sa LEFT JOIN rk ON rk.s = sa.parcel_id AND r = 1 LEFT JOIN hh ON hh.s = sa.parcel_id LEFT JOIN un ON un.s = sa.parcel_id LEFT JOIN ov ON ov.s = sa.parcel_id),
de2 AS (SELECT *, CASE WHEN p IS NULL THEN 'NO_MATCH' WHEN contested AND split THEN 'SPLIT' WHEN contested AND p >= 0.75 AND iou >= 0.55 THEN CASE WHEN adj THEN 'BOUNDARY_ADJUSTMENT' ELSE 'ONE_TO_ONE' END
  WHEN contested THEN 'AMBIGUOUS' WHEN adj AND p >= 0.7 THEN 'BOUNDARY_ADJUSTMENT' WHEN p < 0.45 THEN 'NO_MATCH' ELSE 'ONE_TO_ONE' END AS relation FROM dd),
dr AS (SELECT *, CASE relation WHEN 'SPLIT' THEN ids WHEN 'AMBIGUOUS' THEN ids[1:3] WHEN 'NO_MATCH' THEN [] ELSE [t] END AS targets, CASE WHEN relation = 'SPLIT' THEN round(mean_p, 4) ELSE COALESCE(p, 0) END AS probability FROM de2),
mg AS (SELECT t AS target_id, list(source_id ORDER BY source_id) AS sources, round((max(s1) - min(s0)) / min(tw), 6) AS coverage FROM dr WHERE relation IN ('ONE_TO_ONE', 'BOUNDARY_ADJUSTMENT') GROUP BY t
  HAVING count(*) = 2 AND (max(s1) - min(s0)) / min(tw) BETWEEN 0.85 AND 1.15 AND greatest(0, min(s1) - max(s0)) / min(sw) <= 0.1)"""


@query("SELECT source_id, relation, round(probability, 4) AS probability, array_to_string(targets, ',') AS targets FROM dr", DECIDED)
def decisions_ring(p: Plan) -> DataFrame:
    """Decisions on rings: splits whose children overlap, one whose children cover enough only if counted twice, merges, adjustments, none."""
    return _decided(p).select("source_id", "relation", F.round("probability", 4).alias("probability"), F.array_join("targets", ",").alias("targets"))


def _merged(p: Plan, decided: DataFrame) -> DataFrame:
    return conflate.merges(decided, slanted(p, "slanted_source"), slanted(p, "slanted_target"), conflate.RINGS)


@query("SELECT target_id, array_to_string(sources, ',') AS sources, 'MERGE' AS relation, 0.85::DOUBLE AS probability, coverage FROM mg", DECIDED)
def merges_ring(p: Plan) -> DataFrame:
    """Targets that two overlapping sources fill together."""
    return _merged(p, _decided(p)).select("target_id", F.array_join("sources", ",").alias("sources"), "relation", "probability", F.round("coverage", 6).alias("coverage"))


@query("SELECT relation, count(*) AS n FROM (SELECT relation FROM dr UNION ALL SELECT 'MERGE' FROM mg) q GROUP BY 1", DECIDED)
def relations_ring(p: Plan) -> DataFrame:
    """A whole run: the sources' own rows and a row for each merge."""
    decided = cut(_decided(p).select("source_id", "relation", "targets", "probability"))
    return conflate.with_merges(decided, _merged(p, decided)).groupBy("relation").agg(F.count("*").alias("n"))


# --- support by points and buildings ------------------------------------------------------------

ZONES = RINGS + """,
bd AS (SELECT hp.s, hp.t, px + lo * (qx - px) AS ax, py + lo * (qy - py) AS ay, px + hi * (qx - px) AS ux, py + hi * (qy - py) AS uy FROM iv hp WHERE NOT out AND lo < hi),
og AS (SELECT parcel_id, xs[1] AS zx, ys[1] AS zy FROM ra),
cz AS (SELECT bd.*, zx, zy FROM bd JOIN og ON og.parcel_id = bd.s),
nz AS (SELECT e.s, e.t, px AS ax, py AS ay, qx AS ux, qy AS uy, zx, zy FROM ed e JOIN og ON og.parcel_id = e.s JOIN cm ON cm.s = e.s AND cm.t = e.t WHERE m = 'a' AND common <= 0),
zo AS (SELECT cz.*, 1.01::DOUBLE AS radius FROM cz JOIN cm ON cm.s = cz.s AND cm.t = cz.t WHERE common > 0 UNION ALL SELECT *, 1.0::DOUBLE FROM nz),
ds AS (SELECT s, t, point_id, min(sqrt((gx - ax - w * (ux - ax)) ** 2 + (gy - ay - w * (uy - ay)) ** 2)) AS d, bool_and((ux - ax) * (gy - ay) - (uy - ay) * (gx - ax) >= 0) AS inside, min(radius) AS radius FROM (
  SELECT *, greatest(0, least(1, ((gx - ax) * (ux - ax) + (gy - ay) * (uy - ay)) / ((ux - ax) ** 2 + (uy - ay) ** 2))) AS w FROM (SELECT zo.*, point_id, x - zx AS gx, y - zy AS gy FROM zo JOIN pts ON x - zx BETWEEN -60 AND 60 AND y - zy BETWEEN -60 AND 60) q) z GROUP BY 1, 2, 3)"""


@query("SELECT s AS source_id, t AS target_id, count(*) AS n_gnss FROM ds WHERE inside OR d <= radius GROUP BY 1, 2", ZONES)
def gnss_support_ring(p: Plan) -> DataFrame:
    """Survey points within a metre of the clipped ring of a pair, or of the source's ring where there is no common area."""
    pairs = distance_join(prefixed(ring_layer(p, "source_ring"), "s_"), prefixed(ring_layer(p, "target_ring"), "t_"), "s_", "t_")
    return conflate.gnss_support_ring(pairs, p.layer("survey_point")).select(F.col("s_parcel_id").alias("source_id"), F.col("t_parcel_id").alias("target_id"), "n_gnss")


_SIDES = "unnest([1, 2, 3, 4]) AS i"
SEPARATED = RINGS + f""",
ob AS (SELECT obs_id, [xmin, xmax, xmax + {SLANT} * (ymax - ymin), xmin + {SLANT} * (ymax - ymin)] AS ox, [ymin, ymin, ymax, ymax] AS oy FROM obs WHERE type IN ('BUILDING', 'BUILDING_EDGE', 'WALL')),
nb AS (SELECT parcel_id, obs_id, list_transform(xs, lambda v: v - xs[1]) AS xs, list_transform(ys, lambda v: v - ys[1]) AS ys, list_transform(ox, lambda v: v - xs[1]) AS ox, list_transform(oy, lambda v: v - ys[1]) AS oy FROM rb JOIN ob ON list_min(xs) <= list_max(ox) AND list_max(xs) >= list_min(ox) AND list_min(ys) <= list_max(oy) AND list_max(ys) >= list_min(oy)),
ax AS (SELECT *, ys[i] - ys[i % 4 + 1] AS nx, xs[i % 4 + 1] - xs[i] AS ny FROM (SELECT *, {_SIDES} FROM nb) q UNION ALL SELECT *, oy[i] - oy[i % 4 + 1], ox[i % 4 + 1] - ox[i] FROM (SELECT *, {_SIDES} FROM nb) q),
sp AS (SELECT parcel_id, obs_id, bool_or(list_max([xs[k] * nx + ys[k] * ny for k in [1, 2, 3, 4]]) < list_min([ox[k] * nx + oy[k] * ny for k in [1, 2, 3, 4]]) OR list_min([xs[k] * nx + ys[k] * ny for k in [1, 2, 3, 4]]) > list_max([ox[k] * nx + oy[k] * ny for k in [1, 2, 3, 4]])) AS apart FROM ax GROUP BY 1, 2)"""


@query("SELECT parcel_id AS target_id, count(*) AS n_buildings FROM sp WHERE NOT apart GROUP BY 1", SEPARATED)
def building_support_ring(p: Plan) -> DataFrame:
    """Buildings and walls, as slanted rings, that share a point with the ring of a parcel; the SQL looks for a separating axis."""
    return conflate.building_support_ring(ring_layer(p, "target_ring"), slanted(p, "observation")).select(F.col("t_parcel_id").alias("target_id"), "n_buildings")


# --- shapes -------------------------------------------------------------------------------------

RAW = f""",
rw AS ({fixtures.sql("raw_ring", "//")})"""


def raw_rings(p: Plan) -> DataFrame:
    """Rings as they come: bow-ties, one of them uneven, repeated vertices, closed rings, sound ones."""
    at = lambda *vs: rings.ring(*((F.col("x") + a * F.col("w"), F.col("y") + b * F.col("h")) for a, b in vs))
    kinds = (at((0, 0), (1, 1), (1, 0), (0, 1)), at((0, 0), (1, 0), (1, 0), (1, 1), (0, 1)), at((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), at((0, 0), (1, 0), (1, 1), (0, 1)), at((0, 0), (1, 1), (1, 0), (0, 0.5)))
    ring = kinds[0]
    for k, r in enumerate(kinds[1:], 1):
        ring = F.when(F.col("kind") == k, r).otherwise(ring)
    return p.layer("raw_ring").repartition("parcel_id").withColumn("ring", ring)


@query("""SELECT parcel_id, CASE WHEN kind IN (0, 4) THEN 'make_valid,multipart_to_largest' WHEN kind IN (1, 2) THEN 'dedupe_vertices' ELSE '' END AS fixes, CASE WHEN kind IN (0, 4) THEN 'edges cross' END AS invalid, CASE WHEN kind IN (0, 4) THEN 3 ELSE 4 END AS vertices,
  round(CASE kind WHEN 0 THEN w * h / 4 WHEN 4 THEN w * h / 3 ELSE w * h END, 6) AS area FROM rw""", RAW)
def fixed_rings(p: Plan) -> DataFrame:
    """Rings made valid: of a bow-tie the larger loop stays, repeated vertices go."""
    rows = raw_rings(p).select("parcel_id", rings.validity(F.col("ring")).alias("invalid"), rings.fixed(F.col("ring")).alias("f"))
    return rows.select("parcel_id", F.array_join("f.fixes", ",").alias("fixes"), "invalid", F.size("f.ring").alias("vertices"), F.round(rings.area(F.col("f.ring")), 6).alias("area"))


@query(f"SELECT parcel_id, round(CASE WHEN w > 2 * d * sqrt(1 + {SLANT}::DOUBLE ** 2) AND h > 2 * d THEN (w - 2 * d * sqrt(1 + {SLANT}::DOUBLE ** 2)) * (h - 2 * d) ELSE 0 END, 5) AS area FROM (SELECT parcel_id, xmax - xmin AS w, ymax - ymin AS h, (2 * (k % 9))::DOUBLE AS d FROM sa) q", DECIDED)
def inset_rings(p: Plan) -> DataFrame:
    """Slanted parcels drawn in by up to 16 metres; the widest insets leave nothing."""
    rows = slanted(p, "slanted_source").withColumn("inner", rings.inset(F.col("ring"), (2 * (F.col("k") % 9)).cast("double")))
    return rows.select("parcel_id", F.round(F.when(F.size("inner") > 2, rings.area(F.col("inner"))).otherwise(0.0), 5).alias("area"))


SHAPES = RAW + """,
sq AS (SELECT rw.*, i, j, (j < floor(h / 3) OR i < floor(w / 3)) AS ell, (j < floor(h / 4) OR i < floor(w / 4) OR i >= w - floor(w / 4)) AS u FROM rw, (SELECT unnest(range(0, 30)) AS i) a, (SELECT unnest(range(0, 30)) AS j) b WHERE i < w AND j < h)"""


@query("SELECT parcel_id, count(*) FILTER (WHERE ell)::DOUBLE AS ell, count(*) FILTER (WHERE u)::DOUBLE AS u, count(*) FILTER (WHERE ell AND u)::DOUBLE AS common, round(count(*) FILTER (WHERE ell AND u) / count(*) FILTER (WHERE ell OR u), 6) AS iou FROM sq GROUP BY 1", SHAPES)
def shape_overlap(p: Plan) -> DataFrame:
    """Area and IoU of an L and a U for each parcel, neither convex; the SQL counts unit cells."""
    x, y, w, h = (F.col(c) for c in "xywh")
    a, b, c, d = F.floor(w / 3).cast("double"), F.floor(h / 3).cast("double"), F.floor(w / 4).cast("double"), F.floor(h / 4).cast("double")
    at = lambda *vs: rings.ring(*((x + u, y + v) for u, v in vs))
    zero = F.lit(0.0)
    ell = at((zero, zero), (w, zero), (w, b), (a, b), (a, h), (zero, h))
    u = at((zero, zero), (w, zero), (w, h), (w - c, h), (w - c, d), (c, d), (c, h), (zero, h))
    rows = p.layer("raw_ring").repartition("parcel_id").select("parcel_id", ell.alias("l"), u.alias("u")).select("parcel_id", F.round(rings.area(F.col("l")), 6).alias("ell"), F.round(rings.area(F.col("u")), 6).alias("u_area"), F.round(rings.overlap_area(F.col("l"), F.col("u")), 6).alias("common"))
    return rows.select("parcel_id", "ell", F.col("u_area").alias("u"), "common", F.round(F.col("common") / (F.col("ell") + F.col("u_area") - F.col("common")), 6).alias("iou"))
